"""The toxicity fit and the bottom-k sketches, element by element, and pipeline stages on odd rows, against plain Python."""

import hashlib
import math
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, fingerprint, mixing, pii, toxicity
from tessera.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- bottom-k sketches


def chained(numbers, seed=42):
    for x in numbers:
        seed = xxhash.xxh64_intdigest(struct.pack("<Q", x), seed)
    return seed


def plain_sketch(text, k):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
    windows = [h[i : i + 5] for i in range(len(h) - 4)] if len(h) >= 5 else [h] if h else []
    return sorted({chained(w) >> 16 for w in windows})[:k]


def plain_resemblance(a, b, k):
    union = sorted(set(a) | set(b))[:k]
    return sum(x in set(a) & set(b) for x in union) / len(union) if union else 1.0


@pytest.mark.parametrize("k", [3, 128])
def test_fingerprints_are_plain_bottom_k_sketches(spark, sf, k):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(-3, None), (-2, ""), (-1, " \n "), (10**9, "one two"), (10**9 + 1, "a b c d e"), (10**9 + 2, "é ü 😀 x y z " * 40), (10**9 + 3, "w " * 30_000)], docs.schema)
    docs = docs.unionByName(odd)
    texts = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs, k=k).collect()}
    assert len(got) == len(texts)
    for j, (i, text) in enumerate(texts):
        r, following = got[i], texts[(j + 1) % len(texts)][1]
        cut = len(text) // 4
        own, edited, beside = (plain_sketch(t, k) for t in (text, text[: len(text) - cut] + following[:cut], following))
        assert r.fingerprint == "".join(f"{x:012x}" for x in own) and r.edited_fingerprint == "".join(f"{x:012x}" for x in edited)
        assert r.near_edited == pytest.approx(plain_resemblance(own, edited, k)) and r.near_next == pytest.approx(plain_resemblance(own, beside, k))


# ---- toxicity


def plain_features(text):
    text, out = f" {(text or '').lower()} ", set()
    for n in toxicity.SIZES:
        for i in range(len(text) - n + 1):
            h = n
            for c in text[i : i + n]:
                h = (h + ord(c)) * 0x9E3779B97F4A7C15 % 2**64
                h ^= h >> 32
            out.add(h >> (64 - toxicity.BITS))
    return out


def plain_model(rows):
    """(weights by feature, bias) of rows (text, label) by dictionaries and loops."""
    feats = sorted((sorted(plain_features(t)), y) for t, y in rows)
    n1 = sum(y for _, y in feats)
    n0 = len(feats) - n1
    p, q = Counter(f for fs, y in feats if y for f in fs), Counter(f for fs, y in feats if not y for f in fs)
    z = {f: abs(p[f] / n1 - q[f] / n0) / math.sqrt((p[f] + q[f]) / (n1 + n0) * (1 / n1 + 1 / n0)) for f in set(p) | set(q)}
    kept = sorted(sorted((f for f in z if z[f] >= toxicity.LEAST_Z), key=lambda f: (-z[f], f))[: toxicity.FEATURES])
    ratio = {f: math.log((p[f] + 1) / (n1 + 2)) - math.log((q[f] + 1) / (n0 + 2)) for f in kept}
    share = n1 / (n1 + n0)
    names = [*kept, "bias"]
    w, mean, square = ({f: 0.0 for f in names} for _ in range(3))
    w["bias"] = math.log(share / (1 - share))
    for step in range(1, toxicity.STEPS + 1):
        g = {f: toxicity.PENALTY * w[f] for f in kept} | {"bias": 0.0}
        for fs, y in feats:
            own = [f for f in fs if f in ratio]
            s = sum(ratio[f] * w[f] for f in own) + w["bias"]
            e = (1 / (1 + math.exp(-s)) - y) * (share / n1 if y else (1 - share) / n0)
            for f in own:
                g[f] += ratio[f] * e
            g["bias"] += e
        for f in names:
            mean[f] = 0.9 * mean[f] + 0.1 * g[f]
            square[f] = 0.999 * square[f] + 0.001 * g[f] ** 2
            w[f] -= toxicity.RATE * (mean[f] / (1 - 0.9**step)) / (math.sqrt(square[f] / (1 - 0.999**step)) + 1e-8)
    return {f: ratio[f] * w[f] for f in kept}, w["bias"]


def test_toxicity_is_the_plain_fit(spark):
    texts = [f"calm words number {i} for all" if i % 3 else f"you scum number {i} vile" for i in range(36)]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, *rows[:9], (None, "scum"), (99, None)], "doc_id long, text string")  # repeated rows count once
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(36)] + [(0, 0), (None, 1)], "doc_id long, toxic int")
    out = {r.doc_id for r in docs.filter(toxicity.held_out(F.col("doc_id"))).collect()}
    weights, bias = plain_model([(t, int(i % 3 == 0)) for i, t in rows if i not in out])
    model = toxicity.train(docs, labels)
    assert weights and model.bias == pytest.approx(bias, abs=1e-6)
    for r in toxicity.scored(docs, model).collect():
        s = bias + sum(weights.get(f, 0.0) for f in plain_features(r.text))
        assert r.toxicity == pytest.approx(1 / (1 + math.exp(-s)), abs=1e-4)


# ---- stages of the pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (10**9 + 1, None, "en", "b", 0), (10**9 + 2, "", None, None, 0), (10**9 + 3, "Mail a.b@c.example.com or +1 (555) 123-4567 today", "en", "a", 49), (10**9 + 3, "Mail a.b@c.example.com or +1 (555) 123-4567 today", "en", "a", 49),
    (10**9 + 4, "Mail  a.b@c.example.com or +1 (555) 123-4567\ntoday", None, "a", None), (None, "no id here at all " * 9, "de", "é", 162), (10**9 + 5, "long " * 50_000, "en", "a", 250_000), (10**9 + 6, "\U0001f600 é", "de", "b", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS)


def test_stages_bear_odd_rows(spark, odd, sf):
    stages, names = dict(corpus_pipeline.STAGES), COLUMNS.replace(" long", "").replace(" string", "").split(", ")
    texts = Counter(d[1] for d in ODD)
    kept = stages["toxicity"](spark, odd, sf)
    assert kept.columns == names and Counter(r.text for r in kept.collect()) == texts  # without labels of these rows nothing is rejected
    one = stages["near_duplicates"](spark, odd, sf)
    assert one.columns == names and sorted((r.doc_id or 0) - 10**9 for r in one.collect()) == [-(10**9), 1, 2, 3, 5, 6]
    clean = stages["pii"](spark, odd, sf)
    rows = clean.collect()
    assert clean.columns == names and len(rows) == len(ODD) and not any("@" in (r.text or "") or "555" in (r.text or "") for r in rows)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    mixed = stages["mixing"](spark, odd, sf)
    sizes = {(d[0], d[1]): len(WORD.findall(d[1] or "")) for d in ODD}
    assert mixed.columns == names and {(r.doc_id, r.text) for r in mixed.collect()} <= set(sizes)
    coded = {(r.doc_id, r.n_tokens): r for r in stages["bpe"](spark, odd, sf).collect()}
    assert Counter(i for i, _ in coded) == Counter({d[0] for d in ODD})
    assert all(r.decoded_sha256 in {hashlib.sha256((d[1] or "").encode()).hexdigest() for d in ODD if d[0] == i} for (i, _), r in coded.items())


def test_stages_bear_no_rows(spark, odd, sf):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), sf).collect() == [], name


def test_stages_leave_no_clash(spark, odd):
    """Operators of the stages, with columns that bear their own names."""
    extra = odd.withColumns({c: F.lit(c) for c in ("toxicity", "node", "component", "mark", "id", "spans", "key", "mix", "bucket", "ids")})
    assert set(pii.redacted(extra).columns) >= set(odd.columns)
    assert set(mixing.copies(mixing.mix_sources(extra)).columns) >= set(odd.columns)
    assert bpe.encoded(extra.drop("ids"), *bpe.public_vocabulary()).count() == len(ODD)
