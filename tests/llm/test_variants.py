"""Fill in the middle, spelling variants and the rule ensemble against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import acyclic, fim, rules, spelling
from tessera.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, fim string, fim_units string, word string, n string, label string, stats string, id string"
CLASH = ("a",) * 7
ODD = [
    (1, None, "en", "b", *CLASH),
    (2, "", None, None, *CLASH),
    (3, "one two three four\n\n five\x1csix ", "en", "a", *CLASH),
    (3, "one two three four\n\n five\x1csix ", "en", "a", *CLASH),
    (4, "é ü 😀 <P a <S< b> M>\t", "de", "b", *CLASH),
    (5, "holds <S> itself " * 3, "de", "b", *CLASH),
    (6, " \n ", "de", "b", *CLASH),
    (None, "no identity heréàÀ " * 30, "en", "é", *CLASH),
    *((i, "wörld " * 60000, "en", "a", *CLASH) for i in range(7, 12)),
    *((i, f"Ends {i} with < and é ", "en", "a", *CLASH) for i in range(12, 60)),
    (60, "aaaaaaaaaaa" * 3000 + " aaaaaaaaaaa" * 5, "en", "a", *CLASH),
]
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_fim(i, text):
    text = text or ""
    units = UNIT.findall(text)
    n, digest = len(units), sha(f"42:{'' if i is None else i}")
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    if not text or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_sql(spark, sf001):
    rows = fim.op11_fim(spark, sf001).collect()
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{sf001}/documents.parquet')")
    assert Counter(map(tuple, rows)) == Counter(c.execute(fim.OP11_SQL).fetchall())
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    texts = dict(c.execute("select doc_id, coalesce(text, '') from documents").fetchall())
    assert all(r.restored_sha256 == sha(texts[r.doc_id]) for r in rows)


@pytest.mark.parametrize("block", [1, 7, 1 << 18])
def test_fim_of_random_texts_in_blocks(monkeypatch, block):
    monkeypatch.setattr(fim, "BLOCK", block)
    draw, dfa = random.Random(block), fim.automaton(fim.SENTINELS)
    for i in range(1500):
        text = "".join(draw.choices(["a", "é", "😀", " ", "\n", "<", "P", ">", "S", "M", "\x1c", "\x85"], k=draw.randrange(30)))
        out, *rest = fim.rearranged(i, text.encode(), dfa, fim.SENTINELS, "42", 50, 80)
        form, n, before, middle = rest
        assert (n, form, before, middle, out.decode()) == plain_fim(i, text)


def test_fim_odd(spark, odd):
    out = fim.fill_in_middle(odd)
    back = out.withColumn("back", fim.restored(F.col("fim"), F.col("fim_form")))
    assert set(out.columns) == set(odd.columns) | {"fim_form", "fim_prefix_chars", "fim_middle_chars"}
    rows = back.collect()
    got = Counter((r.doc_id, r.fim_units, r.fim_form, r.fim_prefix_chars, r.fim_middle_chars, r.fim) for r in rows)
    assert got == Counter((d[0], *plain_fim(d[0], d[1])) for d in ODD)
    assert all(r.back == (r.text or "") for r in rows)
    assert fim.fill_in_middle(odd.limit(0)).collect() == []


def test_fim_with_other_sentinels(spark, odd):
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    out = fim.fill_in_middle(odd, sentinels=marks, rate=100, suffix_first=0)
    rows = out.withColumn("back", fim.restored(F.col("fim"), F.col("fim_form"), marks)).collect()
    assert all(r.back == (r.text or "") and r.fim_form == ("psm" if r.text else "plain") for r in rows)
    with pytest.raises(ValueError):
        fim.Automaton(("<é>", "<S>", "<M>"))


# ---- spelling variants


def one_error(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def deleted(w):
    return {w[:i] + w[i + 1 :] for i in range(len(w))}


def brute_near(words):
    """Word to its near ones: words that share a form with one letter left out, checked letter by letter."""
    by, out = defaultdict(set), {w: set() for w in words}
    for w in words:
        for d in deleted(w) | {w}:
            by[d].add(w)
    for group in by.values():
        for w in group:
            out[w] |= {v for v in group if v != w and one_error(v, w)}
    return out


def brute_words(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute_variants(counts):
    near, form = brute_near(counts), {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = Counter()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w, form[w], root, n, len(near[w]), counts.get(form[w])] += 1
    return out


def test_spelling(spark, sf001):
    docs = duckdb.sql(f"select doc_id, text from read_parquet('{sf001}/documents.parquet')").fetchall()
    want = brute_variants(brute_words(docs))
    got = Counter(map(tuple, spelling.op12_spelling(spark, sf001).collect()))
    assert got == want
    assert any(k[1] for k in want) and any(k[4] > 1 for k in want)


def test_spelling_odd(spark, odd):
    want = brute_variants(brute_words([(d[0], d[1]) for d in ODD]))
    got = Counter(map(tuple, spelling.variants(spelling.vocabulary(spelling.runs(odd))).collect()))
    assert got == want and want
    assert spelling.variants(spelling.vocabulary(spelling.runs(odd.limit(0)))).collect() == []


@pytest.mark.parametrize("group, chunk, broadcast", [(50_000, 20_000, 100_000), (3, 1, 100_000), (20, 50, 0)])
def test_spelling_of_dense_words_in_split_groups(spark, monkeypatch, group, chunk, broadcast):
    monkeypatch.setattr(spelling, "BROADCAST_KEYS", broadcast)
    draw = random.Random(5)
    words = {"".join(draw.choices("abé", k=draw.randrange(5, 10))) for _ in range(400)} | {"prefixes" + c + d for c in "abcdefgh" for d in ("", *"abcdefgh")} | {"ø" * k for k in range(7, 30)}
    counts = {w: 10 ** draw.randrange(8) + draw.randrange(3) for w in words}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    long = {w: n for w, n in counts.items() if len(w) >= 7}
    got = spelling.near(rows, group, chunk).collect()
    assert Counter((r.word, r.near, r.near_n) for r in got) == Counter((w, v, counts[v]) for w, vs in brute_near(long).items() for v in vs)
    out = spelling.variants(rows.filter("length(word) >= 7"), 10, group, chunk).collect()
    assert Counter(map(tuple, out)) == brute_variants(long)


def test_chain_of_forms_ends_at_its_root(spark):
    base = "abcdefghijklmnopqrs"
    counts = {"x" * k + base[k:]: 10**k for k in range(19)}
    rows = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert Counter(map(tuple, rows)) == brute_variants(counts)
    assert {r.root for r in rows} == {"x" * 18 + "s"}


def test_automaton_is_minimal_and_numbers_its_words():
    draw = random.Random(7)
    for _ in range(40):
        words = sorted({"".join(draw.choices("abc", k=draw.randrange(0, 7))) for _ in range(50)})
        made = acyclic.Acyclic(words)
        assert [made.number(w) for w in words] == list(range(len(words)))
        assert made.number("abcd" * 3) is None
        futures = {tuple(sorted(w[len(p) :] for w in words if w.startswith(p))) for p in {w[:i] for w in words for i in range(len(w) + 1)}}
        reached, todo = {0}, [0]
        while todo:
            for to, _ in made.edges[todo.pop()].values():
                if to not in reached:
                    reached.add(to)
                    todo.append(to)
        assert len(reached) == len(futures)


# ---- rules


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    solid = len(re.sub(r"[\x20\x09-\x0D]", "", text))
    n, m, marks = max(len(words), 1), max(len(lines), 1), "#*$%&|<>"
    taken = lambda t, cs: sum(c in cs for c in t)
    each = max(solid, 1)
    return {
        "characters": len(text), "words": len(words), "distinct_words": len(set(words)) / n, "adjacent_words": sum(a == b for a, b in zip(words, words[1:])) / n,
        "marked_words": sum(w[-1] in marks + "!" for w in words) / n, "single_letters": sum(len(w) == 1 for w in words) / n, "lines": len(lines),
        "distinct_lines": len(set(lines)) / m, "worst_line": max((taken(x, marks + "!") / len(x) for x in lines), default=0.0), "word_length": solid / n, "line_words": len(words) / m,
        "marks": taken(text, marks) / each, "shouts": taken(text, "!") / each, "digits": taken(text, "0123456789") / each, "stops": taken(text, ".,;:?") / each,
        "capitals": sum(c.isupper() and c.lower() != c for c in text) / each,
    }


def test_statistics(spark, odd, sf):
    docs = odd.select("text").unionByName(table(spark, sf, "documents").select("text"))
    for r in docs.select("text", rules.statistics(F.col("text")).alias("s")).collect():
        assert r.s.asDict() == pytest.approx(plain_statistics(r.text), abs=1e-12)


def test_rules_are_the_paths_of_a_tree():
    described = "Tree\n  If (feature 0 <= 5.0)\n   If (feature 2 > 0.5)\n    Predict: 1.0\n   Else (feature 2 <= 0.5)\n    If (feature 0 <= 2.0)\n     Predict: 0.0\n    Else (feature 0 > 2.0)\n     Predict: 1.0\n  Else (feature 0 > 5.0)\n   Predict: 0.0\n"
    assert [str(r) for r in rules.paths(described, ["a", "b", "c"])] == [
        "a <= 5", "a <= 5 and c > 0.5", "a <= 5 and c <= 0.5", "a <= 2 and c <= 0.5", "a <= 5 and a > 2 and c <= 0.5", "a > 5"]


def plain_score(model, text):
    stats = plain_statistics(text)
    holds = lambda r: all(stats[name] > bound if above else stats[name] <= bound for name, above, bound in r.bounds)
    total = model.bias + sum(w for r, w in model.weights if holds(r))
    return 1 / (1 + math.exp(-total))


def test_compiled_rules_score_as_plain_ones(spark, sf001, monkeypatch):
    monkeypatch.setattr(rules, "TREES", 5)
    docs, labels = table(spark, sf001, "documents"), table(spark, sf001, "labels")
    model = rules.train(docs, labels)
    assert model.weights
    rows = rules.scored(docs, model).collect()
    assert all(r.quality_score == pytest.approx(plain_score(model, r.text), abs=1e-9) for r in rows)


def test_rules_on_held_out_labels(spark, sf001):
    labels = dict(duckdb.sql(f"select doc_id, quality from read_parquet('{sf001}/labels.parquet')").fetchall())
    rows = rules.op13_rules(spark, sf001).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for (i,) in duckdb.sql(f"select doc_id from read_parquet('{sf001}/documents.parquet')").fetchall())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    known = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [p for q, p in known if q], [p for q, p in known if not q]
    assert len(good) > 50 and len(bad) > 10
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_held_out_labels_and_other_columns_are_never_read(spark, sf001, monkeypatch):
    monkeypatch.setattr(rules, "TREES", 3)
    docs, labels = table(spark, sf001, "documents"), table(spark, sf001, "labels")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    wrong = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")).withColumn("id", F.lit("clash")).withColumn("label", F.lit(7))
    assert rules.train(docs, labels) == rules.train(other, wrong)


def test_rules_odd(spark, odd, monkeypatch):
    monkeypatch.setattr(rules, "TREES", 3)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, 1), (4, None), (99, 0)], "doc_id long, quality int")
    none = rules.train(odd, labels.limit(0))
    assert none.weights == ()
    model = rules.train(odd.unionByName(odd), labels)
    rows = rules.scored(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.quality_score <= 1 for r in rows)
    by = defaultdict(set)
    for r in rows:
        by[r.text or ""].add(r.quality_score)
    assert all(len(s) == 1 for s in by.values())
    assert rules.scored(odd.limit(0), model).collect() == []
    one = rules.train(odd, labels.filter("quality = 1"))
    assert one.weights == () and one.bias > 10


def test_small_sample_keeps_the_shares_of_the_labels(spark, sf001):
    docs, labels = table(spark, sf001, "documents"), table(spark, sf001, "labels")
    rows, share = rules.sampled(docs, labels, "doc_id", "text", "quality", 30)
    n = Counter(r.label for r in rows.select("label").collect())
    every = labels.filter(~rules.held_out(F.col("doc_id")))
    assert share == pytest.approx(every.agg(F.avg("quality")).first()[0])
    assert 10 <= n[0] <= 60 and 10 <= n[1] <= 60
