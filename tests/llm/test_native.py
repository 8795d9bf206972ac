"""Mixing, quality rules, fingerprints and chat formatting against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, fingerprint, mixing, quality
from tessera.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, goal string, row string, left string, range string, mix string"
ODD = [
    (1, None, "en", "b", 0, "x", "y", "z", "w", "v"),
    (2, "", None, None, 0, None, None, None, None, None),
    (3, "one two three four", "en", "a", 18, "x", "y", "z", "w", "v"),
    (3, "one two three four", "en", "a", 18, "x", "y", "z", "w", "v"),
    (4, "é ü 😀 a b c d e f g\n\nx\nx\n \n", "de", "b", 30, "x", "y", "z", "w", "v"),
    (None, "no id here " * 30, "en", "é", 330, "x", "y", "z", "w", "v"),
    (7, "w " * 60000, "en", "a", 120000, "x", "y", "z", "w", "v"),
]


def docs_of(sf):
    return duckdb.sql(f"select doc_id, text, lang, source from read_parquet('{sf}/documents.parquet')").fetchall()


def words(t):
    return WORD.findall(t or "")


def level_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Budgets by resharing the excess over and over."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    cap = {s: most * sizes[s] for s in names}
    got, left = {}, share * sum(sizes.values())
    free = set(names)
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > cap[s]}
        if not over:
            got |= {s: left * w[s] / total for s in free}
            break
        for s in over:
            got[s] = cap[s]
        left -= sum(cap[s] for s in over)
        free -= over
    return got


def check_mix(rows, docs):
    sizes = defaultdict(int)
    for d in docs:
        sizes[d[3]] += len(words(d[1]))
    want, taken = level_targets(sizes), defaultdict(int)
    assert len(rows) == len(docs)
    assert Counter(r.doc_id for r in rows) == Counter(d[0] for d in docs)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
        assert r.taken // r.size >= int(r.target // r.source_size) if r.size else r.taken == 0
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1


def test_mixing(spark, sf001):
    docs = table(spark, sf001, "documents")
    out = mixing.mix_sources(docs).select("source", "doc_id", "mix.*")
    rows = out.collect()
    check_mix(rows, docs_of(sf001))
    again = mixing.mix_sources(docs.repartition(5)).select("source", "doc_id", "mix.*").collect()
    assert sorted(rows, key=str) == sorted(again, key=str)


def chosen(rows, goals):
    """Words taken by plain sorting: whole epochs, then documents in the order of (key, id, size) up to the budget."""
    by, out = defaultdict(list), Counter()
    for source, i, size, key in rows:
        by[source].append((key, i is not None, i, size))
    for source, docs in by.items():
        total = sum(d[3] for d in docs)
        words = math.floor(goals[source] + 0.5)
        epochs = words // total if total else 0
        left = words - epochs * total
        for key, _, i, size in sorted(docs, key=lambda d: d[:2] + ((d[2],) if d[1] else ()) + d[3:]):
            more = min(left, size)
            left -= more
            out[source, i, size, epochs * size + more] += 1
    return out


@pytest.mark.parametrize("buckets", [3, 4096])
def test_mixing_takes_what_plain_sorting_takes(spark, sf001, buckets):
    docs = table(spark, sf001, "documents").select("doc_id", "source", "text")
    docs = docs.unionByName(docs.filter("doc_id % 10 = 0")).unionByName(spark.createDataFrame([(None, "src0", "no id"), (5, None, "one"), (6, None, None)], docs.schema)).repartition(4)
    rows = mixing.measured(docs).select("source", "mix.id", "mix.size", "mix.key").collect()
    got = mixing.mix_sources(docs, buckets=buckets).select("source", "doc_id", "mix.*").collect()
    assert Counter((r.source, r.doc_id, r.size, r.taken) for r in got) == chosen([tuple(r) for r in rows], {r.source: r.target for r in got})


@pytest.mark.parametrize("tied", [1_000_000, 100])
def test_mixing_of_one_row_over_and_over(spark, monkeypatch, tied):
    monkeypatch.setattr(mixing, "TIED", tied)
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    rows = mixing.mix_sources(docs.unionByName(spark.createDataFrame([(1, "x " * 40, "s")], docs.schema)), share=0.5).select("doc_id", "mix.*").collect()
    assert len(rows) == 3001 and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert abs(sum(r.taken for r in rows) - 4520) <= (0 if tied > 100 else 90)
    assert 1400 <= sum(r.taken == 3 for r in rows) <= 1520
    assert abs(mixing.copies(mixing.mix_sources(docs, share=0.5)).count() - 1500) <= (0 if tied > 100 else 30)


def test_mixing_by_a_weight_column(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"), F.expr("if(id % 2 = 0, 1.0, if(id % 5 = 0, null, 0.0))").alias("w"))
    rows = mixing.mix_sources(docs, share=0.5, weight_col="w").select("doc_id", "mix.*").collect()
    assert all((r.taken == r.size) == (r.doc_id % 2 == 0) for r in rows)


def test_mixing_prefers_quality(spark):
    docs = spark.range(4000).select("id", F.expr("if(id % 2 = 0, 'abcdef abcdef', '### ##')").alias("text"), F.expr("if(id < 2000, 'a', 'b')").alias("source"))
    rows = mixing.mix_sources(docs, weights=(1, 1), share=0.5, id_col="id").select("id", "mix.*").collect()
    a = [r for r in rows if r.id < 2000]
    assert sum(r.taken for r in a if r.id % 2 == 0) > 1.5 * sum(r.taken for r in a if r.id % 2)


def test_mixing_odd(spark):
    df = spark.createDataFrame(ODD, DOCS)
    out = mixing.mix_sources(df)
    assert set(out.columns) == set(df.columns)
    check_mix(out.select("source", "doc_id", "mix.*").collect(), ODD)
    assert mixing.mix_sources(df.limit(0)).collect() == []
    assert mixing.copies(out).count() > 0


def brute_quality(t):
    t = t or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    seen = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for j in (i, i + 1, i + 2)}
    n = len(hit)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), n, len(w) < 50 or 100 * n > 50 * len(w)


def test_quality(spark, sf001):
    got = {r.doc_id: r for r in quality.op9_quality(spark, sf001).collect()}
    docs = docs_of(sf001)
    assert len(got) == len(docs)
    for i, t, *_ in docs:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t)
        assert not (r.kept and r.base_failed)


def test_quality_odd(spark):
    df = spark.createDataFrame(ODD, DOCS)
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.quality_filter(df, labels).collect()
    assert len(rows) == len(ODD)
    want = Counter((d[0], *brute_quality(d[1])) for d in ODD)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert quality.quality_filter(df.limit(0), labels.limit(0)).collect() == []


def test_binomial(spark):
    cases = [(0, 10, 0.01), (3, 400, 0.01), (9, 5000, 0.002), (20, 1000, 0.01), (0, 100000, 0.001)]
    for k, n, p in cases:
        got = spark.range(1).select(quality.binomial_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k < n * p else 1.0
        assert got == pytest.approx(want, rel=1e-6)


def binomial_at_most(k, n, p):
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))


def values_of(t):
    n_words, chars, symbols, dup, repeat, _ = brute_quality(t)
    n_lines = sum(1 for x in (t or "").split("\n") if words(x))
    return {"symbols_per_word": symbols / max(n_words, 1), "dup_line_share": dup / max(n_lines, 1), "repeat_share": repeat / max(n_words, 1), "long_words": chars / max(n_words, 1), "short_words": n_words / max(chars, 1)}


def plain_cutoffs(trials, alpha, delta, precision):
    """Cutoffs by stratum and rule from trials (stratum, {rule: value}, good), one test after the other."""
    strata = {s for s, *_ in trials}
    out = {}
    for s in strata:
        own = [t for t in trials if t[0] == s]
        n = sum(1 for *_, g in own if g)
        for rule, grid in quality.GRID.items():
            best = None
            for cutoff in sorted(grid, reverse=True):
                lost = sum(1 for _, v, g in own if g and v[rule] > cutoff)
                caught = sum(1 for _, v, g in own if not g and v[rule] > cutoff)
                p = alpha / len(quality.GRID)
                if lost >= n * p or binomial_at_most(lost, n, p) > delta / (len(strata) * len(quality.GRID)):
                    break
                if caught and caught >= precision * (caught + lost):
                    best = cutoff
            if best is not None:
                out.setdefault(s, {})[rule] = best
    return out


def test_quality_verdict_is_that_of_plain_tests(spark, sf001):
    alpha, delta, precision = 0.4, 0.05, 0.5
    docs = docs_of(sf001)
    labels = dict(duckdb.sql(f"select doc_id, quality from read_parquet('{sf001}/labels.parquet')").fetchall())
    by_text = {}
    for i, t, lang, _ in docs:
        if i in labels and not brute_quality(t)[-1]:
            by_text.setdefault((lang, t), []).append(labels[i])
    cutoffs = plain_cutoffs([(lang, values_of(t), min(ls) == 1) for (lang, t), ls in by_text.items()], alpha, delta, precision)
    assert cutoffs
    got = {r.doc_id: r.kept for r in quality.quality_filter(table(spark, sf001, "documents"), table(spark, sf001, "labels"), alpha=alpha, delta=delta, precision=precision).collect()}
    rejected = 0
    for i, t, lang, _ in docs:
        v, failed = values_of(t), brute_quality(t)[-1]
        want = not failed and not any(v[r] > c for r, c in cutoffs.get(lang, {}).items())
        assert got[i] == want
        rejected += not failed and not want
    assert rejected > 0


def test_false_rejection_stays_below_the_bound():
    """Good texts whose rule values exceed the cutoffs at known rates: how often the chosen ones reject too many."""
    import random

    rnd = random.Random(7)
    alpha, delta, broken = 0.25, 0.1, 0
    grid = quality.GRID["symbols_per_word"]
    for _ in range(150):
        # each cutoff is exceeded by the share of good texts that a drawn scale gives
        scale = rnd.choice([0.02, 0.05, 0.1])
        draw = lambda: rnd.expovariate(1 / scale)
        rest = dict.fromkeys(quality.GRID, 0.0)
        trials = [("s", rest | {"symbols_per_word": draw()}, True) for _ in range(300)] + [("s", rest | {"symbols_per_word": 5.0}, False)] * 300
        cutoff = plain_cutoffs(trials, alpha, delta, 0.5).get("s", {}).get("symbols_per_word")
        broken += cutoff is not None and math.exp(-cutoff / scale) > alpha / len(quality.GRID)
    assert grid and broken <= 150 * delta


def test_copies_are_one_trial(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.expr("concat(repeat(concat('word', if(id < 1000, 0, id), ' more text of some kind '), 20), if(id % 10 = 0, '#####', ''))").alias("text"), F.lit("en").alias("lang"))
    rows = quality.features(docs).withColumn("base_failed", F.lit(False))
    labels = spark.range(2000).select(F.col("id").alias("doc_id"), F.expr("int(id % 10 != 0)").alias("quality"))
    # 900 good copies of one text and 900 other good texts: enough as trials of their own, as 901 as well, as 1 + 500 not
    assert [r.cutoffs["symbols_per_word"] for r in quality.thresholds(rows, labels).collect()] == [0.02]
    assert quality.thresholds(rows.filter("doc_id < 1500"), labels).collect() == []


def test_thresholds_control_false_rejection(spark):
    rows = spark.range(40000).select(
        F.col("id").alias("doc_id"), F.expr("if(id % 2 = 0, 'en', 'de')").alias("stratum"), F.lit(100).cast("long").alias("n_words"), F.lit(600).cast("long").alias("word_chars"),
        F.expr("if(id % 10 = 3, 70, if(id % 1000 = 0, 70, 3))").cast("long").alias("n_symbols"), F.lit(0).cast("long").alias("n_dup_lines"),
        F.lit(0).cast("long").alias("n_repeat_words"), F.lit(5).cast("long").alias("n_lines"), F.lit(False).alias("base_failed"),
    )
    labels = spark.range(40000).select(F.col("id").alias("doc_id"), F.expr("int(id % 10 != 3)").alias("quality"))
    got = {r.stratum: r.cutoffs for r in quality.thresholds(rows, labels, alpha=0.05).collect()}
    assert got == {"de": {"symbols_per_word": 0.05}}  # in 'en' only good documents are above any cutoff


def test_thresholds_at_ordinary_sizes(spark):
    # 800 labelled good documents of a language and perfectly separable bad ones, 400 in 'fr'
    rows = spark.range(1400).select(
        F.col("id").alias("doc_id"), F.expr("if(id < 900, 'en', 'fr')").alias("stratum"), F.lit(100).cast("long").alias("n_words"), F.lit(500).cast("long").alias("word_chars"),
        F.expr("if(id < 100 or id >= 1300, 5, 0)").cast("long").alias("n_symbols"), F.lit(0).cast("long").alias("n_dup_lines"),
        F.lit(0).cast("long").alias("n_repeat_words"), F.lit(5).cast("long").alias("n_lines"), F.lit(False).alias("base_failed"),
    )
    labels = spark.range(1400).select(F.col("id").alias("doc_id"), F.expr("int(id >= 100 and id < 1300)").alias("quality"))
    got = {r.stratum: r.cutoffs for r in quality.thresholds(rows, labels).collect()}
    assert got == {"en": {"symbols_per_word": 0.02}}  # 400 labels are too few: 0.99 ** 400 > 0.05 / 10


def brute_shingles(t):
    w = words(t)
    return {tuple(w)} - {()} if len(w) < 5 else set(zip(*(w[i:] for i in range(5))))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check_prints(rows, docs):
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0]))
    texts = [d[1] or "" for d in docs]
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(docs)
    prints = {}
    for j, (i, t) in enumerate(zip([d[0] for d in docs], texts)):
        nxt = texts[(j + 1) % len(texts)]
        k = len(t) // 4
        edited = t[: len(t) - k] + nxt[:k]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        r = next(x for x in got[i] if x.edited_sha256 == sha)
        got[i].remove(r)
        assert r.n_chars == len(t)
        assert abs(r.near_edited - jaccard(brute_shingles(t), brute_shingles(edited))) < 0.2
        assert abs(r.near_next - jaccard(brute_shingles(t), brute_shingles(nxt))) < 0.2
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint


def test_fingerprints(spark, sf001):
    check_prints(fingerprint.op8_fingerprint(spark, sf001).collect(), docs_of(sf001))


def test_fingerprints_many_ranges(spark, sf, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 7)
    monkeypatch.setattr(fingerprint, "RANGES", 5)
    check_prints(fingerprint.op8_fingerprint(spark, sf).collect(), docs_of(sf))


def test_fingerprints_odd(spark):
    df = spark.createDataFrame(ODD, DOCS)
    check_prints(fingerprint.edited_fingerprints(df).collect(), ODD)
    assert fingerprint.edited_fingerprints(df.limit(0)).collect() == []
    assert len(fingerprint.edited_fingerprints(df.limit(1)).collect()) == 1


def test_sketch_estimates(spark):
    a = spark.range(1).select(F.expr("array_join(transform(sequence(1, 3000), x -> 'w' || x), ' ')").alias("a"), F.expr("array_join(transform(sequence(1, 1500), x -> 'w' || x), ' ')").alias("b"))
    a = a.select(fingerprint.sketch(fingerprint.shingle_hashes(F.col("a"))).alias("a"), fingerprint.sketch(fingerprint.shingle_hashes(F.col("b"))).alias("b"))
    r = a.select(
        fingerprint.resemblance(F.col("a"), F.col("b")), fingerprint.containment(F.col("b"), F.col("a")), fingerprint.distinct_shingles(F.col("a")),
        fingerprint.merge(F.col("a"), F.col("b")) == F.col("a"), fingerprint.decode(fingerprint.encode(F.col("a"))) == F.col("a"),
    ).first()
    assert abs(r[0] - 0.5) < 0.15 and r[1] == 1.0 and 2200 < r[2] < 3900 and r[3] and r[4]


def brute_chat(rows):
    by = defaultdict(list)
    for c, n, r, t in rows:
        by[c].append(((n is not None, n), r or "", t or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        all_text = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(all_text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


ODD_TURNS = [
    (1, 0, "user", "a<|end|>b\\<|start|>user<|body|>"),
    (1, 1, "user", None),
    (1, 2, "assistant", "<</SYS>><s></s>[INST][/INST]\\\\"),
    (1, 2, "assistant", "<</SYS>><s></s>[INST][/INST]\\\\"),
    (1, 3, None, "x\ny"),
    (2, None, "<|sep|>\\", "|><|"),
    (None, 1, "assistant", "é😀" * 1000),
    (3, 1, "system", ""),
]


def test_chat_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ODD_TURNS, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    rows = chat.op4_chat(spark, str(tmp_path)).collect()
    probe = "</s>[INST] ok [/INST]"
    want = brute_chat([*ODD_TURNS, (-7, 0, "user", probe), (-7, 1, "assistant", probe)])
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows} == want
    made = chat.format_chats(df)
    for r in made.collect():
        inside = r.formatted
        for mark in (chat.START, chat.BODY, chat.SEP, chat.END):
            inside = inside.replace(mark, "")
        assert not any(c in inside for c in chat.CONTROLS)
    first = made.filter("conv_id = 1").select(chat.read_chats(F.col("formatted")).alias("b")).first().b
    assert [(b.role, len(b.texts)) for b in first] == [("user", 2), ("assistant", 2), ("", 1)]
    assert chat.format_chats(df.limit(0)).collect() == []
