"""Tokenizing, personal data, toxicity, near duplicates, URL filters, archives and the pipeline against brute force."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, jaccard, mixing, pii, queries, signature_tree, toxicity, urls, warc
from tessera.llm.common import table
from tessera.llm.shingles import shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, node string, id string, spans string"
ODD = [
    (1, None, "en", "b", 0, "x", "y", "z", "w"),
    (2, "", None, None, 0, None, None, None, None),
    (3, "Call +1 (555) 123-4567 now, mail a.b@c.example.com or 10.0.0.1", "en", "a", 60, "x", "y", "z", "w"),
    (3, "Call +1 (555) 123-4567 now, mail a.b@c.example.com or 10.0.0.1", "en", "a", 60, "x", "y", "z", "w"),
    (4, "é ü 😀 \x1c  a  b\n\nx", "de", "b", 30, "x", "y", "z", "w"),
    (None, "no id here " * 30, "en", "é", 330, "x", "y", "z", "w"),
    (7, "w" * 100000 + " 1" * 20000, "en", "a", 140000, "x", "y", "z", "w"),
    (8, "no ID here " * 30, "en", "a", 330, "x", "y", "z", "w"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def docs_of(sf):
    return duckdb.sql(f"select doc_id, text from read_parquet('{sf}/documents.parquet')").fetchall()


def test_bpe_is_byte_level_bpe(spark, sf001, odd):
    import tiktoken

    path, pattern = bpe.public_vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})

    def want(text):
        ids = " ".join(map(str, own.encode_ordinary(text or "")))
        return len(ids.split()), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    got = {r.doc_id: r[1:] for r in bpe.op1_bpe(spark, sf001).collect()}
    assert got == {i: want(t) for i, t in docs_of(sf001)}
    rows = bpe.encoded(odd, path, pattern, ids=True).collect()
    assert Counter((r.doc_id, *r[1:4]) for r in rows) == Counter((d[0], *want(d[1])) for d in ODD)
    assert all(len(r.ids) == r.n_tokens for r in rows)
    assert bpe.encoded(odd.limit(0), path, pattern).collect() == []


def test_bpe_vocabulary_comes_from_the_model():
    path, pattern = bpe.public_vocabulary()
    c, ranks = bpe.Codec(path, pattern), bpe.read_ranks(path)
    assert {int(i): t for i, t in c.to_bytes.items()} == {i: t for t, i in ranks.items()}
    own = {t: str(i) for t, i in ranks.items()}
    assert len(c.whole) < 100 and all(own[t.encode()] == i for t, i in c.whole.items())


def test_bpe_memory_may_run_over(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    c = bpe.Codec(*bpe.public_vocabulary())
    texts = ["one two three four five", "six seven", "one two", "x" * 100 + " one"]
    fresh = [bpe.Codec(*bpe.public_vocabulary()).encode(t) for t in texts]
    assert [c.encode(t) for t in texts] == fresh and [c.decode(s).decode() for s in fresh] == texts


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0
    return {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15],
    }


def test_pii_base_spans_are_those_of_the_patterns(spark, sf001, odd):
    def want(i, t):
        b = base_spans(t or "")
        return (i, *(len(b[k]) for k in pii.BASE), hashlib.sha256(pii.joined(b, pii.BASE).encode()).hexdigest())

    assert Counter(tuple(r[:6]) for r in pii.op2_pii(spark, sf001).collect()) == Counter(want(i, t) for i, t in docs_of(sf001))
    rows = pii.personal_data(odd).collect()
    assert Counter(tuple(r[:6]) for r in rows) == Counter(want(d[0], d[1]) for d in ODD)
    assert [r.redacted for r in rows if r.doc_id == 3][0] == "Call [PHONE] now, mail [EMAIL] or [IP]"
    assert pii.personal_data(odd.limit(0)).collect() == []
    assert pii.redacted(odd).columns == odd.columns


def test_pii_random_texts():
    rnd = random.Random(5)
    for alphabet in ("0123456789.", "01 -.+()", "ab@.-1", "12345@.+- ()a", "0123456789 -", "@a.+1"):
        for _ in range(4000):
            t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
            got = pii.find(t)
            assert {k: got[k] for k in pii.BASE} == base_spans(t), t


def test_pii_added_spans():
    t = 'see https://a.example.com/x?y=1. token = "abcdef0123456789abcd" IBAN: DE89 3704 0044 0532 0130 00; account no. 12345678'
    found = {k: [t[a:b] for a, b in v] for k, v in pii.find(t).items()}
    assert found["url"] == ["https://a.example.com/x?y=1"] and found["secret"] == ["abcdef0123456789abcd"]
    assert found["account"] == ["DE89 3704 0044 0532 0130 00", "12345678"]
    for cue in (*pii.ACCOUNT_CUES, *pii.SECRET_CUES, *pii.SCHEMES):  # in whatever case
        kind = "url" if cue in pii.SCHEMES else "secret" if cue in pii.SECRET_CUES else "account"
        for said in (cue, cue.upper(), cue.title(), cue.capitalize(), "".join(c.upper() if i % 2 else c for i, c in enumerate(cue))):
            t = f"İ {said}a.example.com" if kind == "url" else f"İ {said}: {'abcdefgh12345678' if kind == 'secret' else '12345678'}"
            a, b = pii.find(t)[kind][0]
            assert t[a:b] == t[2 if kind == "url" else t.index(": ") + 2 :], t
    for s in ("+1" * 50000, "1." * 50000, "a@" * 50000, "account token " * 10000):
        pii.find(s)


def test_toxicity(spark, sf001, odd):
    rows = toxicity.op3_toxicity(spark, sf001).collect()
    assert len(rows) == len(docs_of(sf001))
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    labels = dict(duckdb.sql(f"select doc_id, toxic from read_parquet('{sf001}/labels.parquet')").fetchall())
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    hits = sum(a > b for a, x, _ in held if x for b, y, _ in held if not y)
    pairs = sum(x for _, x, _ in held) * sum(1 - x for _, x, _ in held)
    assert hits / pairs > 0.75
    assert sum(p for _, x, p in held if not x) <= 0.05 * len(held)
    again = {r.doc_id: r.score for r in toxicity.op3_toxicity(spark, sf001).collect()}
    assert again == {r.doc_id: r.score for r in rows}


def test_toxicity_finds_stems_and_handles_odd_rows(spark, odd):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    data = [(i, " ".join([word() for _ in range(30)] + ["zzvik" + word()] * (i % 3 == 0))) for i in range(900)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in data] + [(None, 1), (5, None), (10**9, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    scores = {i: model.score(t) for i, t in data}
    held = [i for i, _ in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((scores[i] >= 0.3) == (i % 3 == 0) for i in held)
    out = toxicity.scored(odd, model)
    assert out.columns == [*odd.columns, "toxicity"] and len(out.collect()) == len(ODD)
    assert toxicity.clean(docs, labels).count() == 600
    flat = toxicity.train(docs.limit(0), labels)
    assert flat.score(None) == flat.score("anything")
    assert toxicity.train(docs, labels.filter("toxic = 0")).score("x") < 0.01


def test_blocks_lose_no_ngram(monkeypatch):
    text = "abcdefghij" * 20
    whole = set(toxicity.featured(text).tolist())
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert set(toxicity.featured(text).tolist()) == whole


def brute_groups(docs):
    """(doc id, set size, smallest id reachable) of each row."""
    sets = []
    for _, t in docs:
        w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w)} - {()} if len(w) < 5 else set(zip(*(w[i:] for i in range(5)))))
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    common = Counter()
    for ids in where.values():
        for k, i in enumerate(ids):
            for j in ids[k + 1:]:
                common[i, j] += 1
    for (i, j), n in common.items():
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(docs))


def test_near_duplicates(spark, sf, odd):
    got = Counter(tuple(r) for r in jaccard.op6_jaccard(spark, sf).collect())
    assert got == brute_groups(docs_of(sf))
    assert Counter(tuple(r) for r in jaccard.near_duplicates(odd).collect()) == brute_groups([d[:2] for d in ODD])
    assert jaccard.near_duplicates(odd.limit(0)).collect() == []
    kept = jaccard.deduplicated(odd)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 3, 4, 7, 8])


def test_one_row_of_each_group(spark, odd, monkeypatch):
    kept = jaccard.deduplicated(odd, repeats=False)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 7, 8])
    long = "one two three four five six seven eight nine ten eleven twelve " * 3
    near, far = long + "more", "quite another text of some words that is like no other one here"
    rows = [(5, far, "a"), (5, far, "b"), (5, long, "c"), (2, near, "d"), (None, "x " + far[20:], "e"), (None, "X " + far[20:], "f"), (9, "", "g"), (9, "", "h"), (10, None, "i"), *[(1, "text of its own " * 9, "j")] * 50]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string").repartition(5)
    for limit in (jaccard.BROADCAST_IDS, 0):
        monkeypatch.setattr(jaccard, "BROADCAST_IDS", limit)
        got = [tuple(r) for r in jaccard.deduplicated(docs, repeats=False).collect()]
        assert Counter(i for i, *_ in got) == Counter([5, 2, None, 9, 10, 1])  # the text of id 5 that is near id 2 goes
        assert (5, long, "c") not in got and (2, near, "d") in got and set(got) <= set(rows)
    assert Counter(r.doc_id for r in jaccard.deduplicated(docs).collect()) == Counter([5, 5, 2, None, 9, 9, 10, *[1] * 50])
    assert jaccard.deduplicated(docs.limit(0), repeats=False).collect() == []


@pytest.fixture(scope="module")
def border():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    passage = [rnd.choice(words) for _ in range(60)]
    docs, n = [], 0
    for size in (9, 12, 24, 49, 104):
        base = [rnd.choice(words) for _ in range(size)]
        for cut in range(0, size // 4):
            docs.append((n, " ".join(base[cut:])))
            n += 1
    original = [rnd.choice(words) for _ in range(80)]
    for _ in range(150):  # copies near the original, most of them not near each other
        copy = list(original)
        for p in rnd.sample(range(80), rnd.choice((1, 1, 2))):
            copy[p] = rnd.choice(words)
        docs.append((n, " ".join(copy).upper() if n % 2 else " ".join(copy)))
        n += 1
    for _ in range(80):  # a shared passage in otherwise different texts
        docs.append((n, " ".join([rnd.choice(words) for _ in range(40)] + passage)))
        n += 1
    docs += [(n + i, " ".join(original)) for i in range(60)]
    return docs, brute_groups(docs)


@pytest.mark.parametrize("limits", [{}, {"HOT_TOKEN": 1, "TREE_SHINGLES": 400, "NODE_BITS": 7}, {"TREE_SHINGLES": 2000, "BROADCAST_IDS": 0}])
def test_near_duplicates_at_the_border_and_in_large_groups(spark, monkeypatch, border, limits):
    """Also with every shingle dealt over all tasks, small blocks of trees, and sets that share their numbers."""
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    docs, want = border
    got = Counter(tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == want


def test_signature_trees_lose_no_link():
    rng = np.random.default_rng(0)
    for trial in range(12):
        base = [rng.integers(0, 2**63, rng.integers(4, 300)).astype(np.uint64) for _ in range(4)]
        sets = []
        for _ in range(rng.integers(2, 150)):
            b = base[rng.integers(4)]
            extra = rng.integers(0, 2**63, int(len(b) * rng.random() * 0.3) + 1).astype(np.uint64)
            sets.append(np.unique(np.concatenate([b[rng.random(len(b)) > rng.random() * 0.3], extra])))
        ids, sizes = np.arange(len(sets)), np.array([len(s) for s in sets])
        groups = rng.integers(0, 4, len(sets)) if trial % 2 else ids
        found = {(x, y) for a, b in signature_tree.candidates(ids, sizes, [signature_tree.bitmap(s) for s in sets], groups) for x, y in zip(a.tolist(), b.tolist())}
        for x in range(len(sets)):
            for y in range(x + 1, len(sets)):
                n = len(np.intersect1d(sets[x], sets[y]))
                if groups[x] != groups[y] and 100 * n >= 80 * (sizes[x] + sizes[y] - n):
                    assert (x, y) in found
                    assert signature_tree.pair_may_link(sizes[x], sizes[y], signature_tree.bitmap(sets[x], 2), signature_tree.bitmap(sets[y], 2), 80, 100)


def test_blocks_of_a_tree_lose_no_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 120).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(120) > rng.random() * 0.3], rng.integers(0, 2**63, 5).astype(np.uint64)])) for _ in range(60)]
    ids, sizes, maps = np.arange(60), np.array([len(s) for s in sets]), [signature_tree.bitmap(s) for s in sets]
    pairs = lambda made: {(x, y) for a, b in made for x, y in zip(a.tolist(), b.tolist())}
    side = ids % 2
    found = pairs(signature_tree.candidates(ids, sizes, maps, ids, side=side))
    assert all(side[x] != side[y] for x, y in found)
    near = {(x, y) for x in range(60) for y in range(x + 1, 60) if 100 * (n := len(np.intersect1d(sets[x], sets[y]))) >= 80 * (sizes[x] + sizes[y] - n)}
    assert near and {p for p in near if side[p[0]] != side[p[1]]} <= found


def test_forest_joins_all_that_may_link():
    rng = np.random.default_rng(4)
    pairs = lambda made: [(x, y) for a, b in made for x, y in zip(a.tolist(), b.tolist())]
    for n, spread in ((2, 0.1), (40, 0.3), (400, 0.1), (700, 0.25)):
        base = [rng.integers(0, 2**63, rng.integers(5, 400)).astype(np.uint64) for _ in range(5)]
        sets = []
        for _ in range(n):
            b = base[rng.integers(5)]
            sets.append(np.unique(np.concatenate([b[rng.random(len(b)) > rng.random() * spread], rng.integers(0, 2**63, int(len(b) * rng.random() * spread) + 1).astype(np.uint64)])))
        ids, sizes, maps = np.arange(n) * 7 - 50, np.array([len(s) for s in sets]), [signature_tree.bitmap(s) for s in sets]
        every, few = set(pairs(signature_tree.candidates(ids, sizes, maps, ids))), pairs(signature_tree.forest(ids, sizes, maps))
        assert len(few) < n and set(few) <= every and all(x < y for x, y in few)
        up = {i: i for i in ids.tolist()}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for x, y in few:
            assert root(x) != root(y)
            up[root(x)] = root(y)
        assert all(root(x) == root(y) for x, y in every)


def test_shingles():
    assert len(shingles(None)) == len(shingles(" \n\t")) == 0
    assert list(shingles("A b")) == list(shingles("a  B")) != list(shingles("a b c"))
    assert len(shingles("a b c d e f")) == 2 and len(shingles("a " * 50)) == 1
    assert list(shingles("É b c d e")) != list(shingles("é b c d e"))  # only A-Z are lowered


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(60)] + [(500, x) for x in range(501, 560)]
    got = {r.node: r.component for r in jaccard.components(spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long"), "t").collect()}
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert jaccard.components(spark.createDataFrame([], "a long, b long"), "t").collect() == []


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf001, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"create view {t} as select * from read_parquet('{sf001}/{t}.parquet')")
    want = c.sql(queries.SQL[name])
    names = sorted(want.columns)
    rows = [tuple(x) for x in want.select(*(f'"{n}"' for n in names)).fetchall()]
    assert Counter(tuple(r) for r in queries.QUERIES[name](spark, sf001).select(*names).collect()) == Counter(rows)


def test_url_patterns(spark):
    df = spark.createDataFrame([("https://u@A.b.Example.com:80/x/y/?q=/z#f",), ("nonsense",), (None,), ("http://[::1]/a",)], "u string")
    got = [r.p for r in df.select(urls.patterns_of(F.col("u")).alias("p")).collect()]
    assert got[0] == ["a.b.example.com/x/y", "a.b.example.com/x", "a.b.example.com", "b.example.com", "example.com", "com"]
    assert got[1] == got[2] == [] and got[3][-1] == "[::1]"


EVENTS = [("e.com", "add", 5), ("e.com", "add", 6), ("e.com", "remove", 10), ("e.com", "add", 20), ("x.org/p", "add", 1), ("x.org", "remove", 2), ("y.net", "add", 3), ("y.net", "remove", 3), (None, "add", 1), ("z.net", "add", None)]
CAPTURES = [(1, "http://a.e.com/", 4), (2, "http://a.e.com/", 5), (3, "http://e.com", 9), (4, "http://e.com", 10), (5, "http://e.com", 99), (6, "http://x.org/p/q", 1), (7, "http://x.org/pq", 9), (8, "http://y.net/", 9), (9, None, 5), (10, "http://e.com", None), (2, "http://a.e.com/", 5)]


@pytest.mark.parametrize(("limit", "hot"), [(100_000, 1_000_000), (0, 1_000_000), (0, 1)])
def test_url_filter_as_of(spark, monkeypatch, limit, hot):
    monkeypatch.setattr(urls, "BROADCAST_INTERVALS", limit)
    monkeypatch.setattr(urls, "HOT_ROWS", hot)
    listed = urls.intervals(spark.createDataFrame(EVENTS, "pattern string, action string, at int"))
    assert sorted(tuple(r) for r in listed.collect() if r.valid_to) == [("e.com", 5, 10)]
    caps = spark.createDataFrame([(*c, "clash", "clash") for c in CAPTURES], "page_id long, url string, fetched_at int, listed string, key string")
    out = urls.filtered(caps, listed)
    assert out.columns == [*caps.columns, "blocked", "pattern", "valid_from"]
    assert Counter(r.page_id for r in out.filter("blocked").collect()) == Counter([2, 2, 3, 5, 6])
    assert urls.filtered(caps, listed.limit(0)).filter("blocked").count() == 0
    assert urls.filtered(caps.limit(0), listed).collect() == []


def test_url_patterns_are_normalised(spark):
    given = ["Example.com", "HTTP://u@Example.com:80/Ads//x/?q=/z", "example.com./", "//a.b/c/", "[::1]:8080/x", "", None, "/only/path"]
    df = spark.createDataFrame([(p,) for p in given], "p string").select(urls.normal_pattern(F.col("p")).alias("n"))
    assert [r.n for r in df.collect()] == ["example.com", "example.com/Ads/x", "example.com", "a.b/c", "[::1]/x", None, None, None]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_url_filter_at_any_depth(spark, monkeypatch, limit):
    monkeypatch.setattr(urls, "BROADCAST_INTERVALS", limit)
    deep = "/".join(f"s{i}" for i in range(12))
    events = [("e.com/a/b/c/d/e", "add", 1), (f"e.com/{deep}", "add", 1), ("e.com/a/b", "add", 1)]
    listed = urls.intervals(spark.createDataFrame(events, "pattern string, action string, at int"))
    pages = [(1, "http://e.com/a/b/c/d/e", 5), (2, "http://e.com/a/b/c/d/e/f/g?q=/h", 5), (3, "http://e.com/a/b/c/d", 5), (4, f"http://e.com/{deep}/x", 5), (5, "http://e.com/s0/s1", 5), (6, "http://e.com", 5)]
    out = urls.filtered(spark.createDataFrame(pages, "page_id long, url string, fetched_at int"), listed).collect()
    assert {r.page_id: r.pattern for r in out} == {1: events[0][0], 2: events[0][0], 3: events[2][0], 4: events[1][0], 5: None, 6: None}


LONG = "<p>é" + "x\r\n\r\nWARC/1.1\r\n" * 20
PAGES = [(5, "http://a/ b", LONG), (3, "http://a", LONG), (9, None, LONG), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (3, "http://a", LONG), (8, "u", LONG + "."), (None, "u", LONG), (None, "u", LONG), (9, None, "other " * 30), (None, "u", "alone " * 30), (None, "v", "alone " * 30)]


def records(folder):
    """(headers, block) of all records of the archives of a folder, by file."""
    return {f.name: list(warc.parse(gzip.open(f).read().split(warc.BEGINS))) for f in sorted(folder.iterdir()) if f.name.endswith(".warc.gz")}


def members(data):
    while data:
        d = zlib.decompressobj(31)
        yield d.decompress(data)
        assert d.eof
        data = d.unused_data


@pytest.mark.parametrize(("archive", "limit"), [(1 << 30, 100_000), (1, 0), (2500, 0)])
def test_warc_round_trip(spark, tmp_path, monkeypatch, archive, limit):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", limit)
    pages = spark.createDataFrame([(*d, "clash", "2024-02-03T04:05:06Z" if d[0] == 3 else None) for d in PAGES], "page_id long, url string, html string, digest string, at string").coalesce(2)
    warc.write_archives(pages, f"{tmp_path}/w", date_col="at", archive_bytes=archive)
    rows = warc.read_archives(spark, f"{tmp_path}/w", payloads=True).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = Counter()
    for i, _, t in PAGES:
        refers = 3 if t == LONG and i != 3 else None
        want[i, len((t or "").encode()), sha(t), "revisit" if refers else "response", refers] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == want
    assert all(hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest for r in rows if r.record_type == "response")
    files = records(tmp_path / "w")
    made = [h for rs in files.values() for h, _ in rs]
    assert all(rs[0][0]["warc-type"] == "warcinfo" and sum(h["warc-type"] == "warcinfo" for h, _ in rs) == 1 for rs in files.values())
    assert len({h["warc-record-id"] for h in made}) == len(made) - 2  # pages 3 and 9 are there twice
    revisits = [h for h in made if h["warc-type"] == "revisit"]
    assert {(h["warc-refers-to"], h["warc-refers-to-target-uri"], h["warc-refers-to-date"]) for h in revisits} == {("<urn:page:3>", "http://a", "2024-02-03T04:05:06Z")}
    if archive < 100:
        assert all(len(rs) == 2 for rs in files.values())
    for f in (tmp_path / "w").iterdir():  # each member is a whole record
        if f.name.endswith(".warc.gz"):
            texts = list(members(f.read_bytes()))
            assert len(texts) == len(files[f.name]) and all(t.startswith(b"WARC/1.1\r\n") and t.endswith(b"\r\n\r\n") for t in texts)
        else:
            assert f.name.startswith(".") or f.name == "_SUCCESS"


def test_warc_of_no_pages(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/e")
    assert warc.read_archives(spark, f"{tmp_path}/e").collect() == []


def test_warc_archives_are_read_by_several_tasks(spark, tmp_path):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.expr("array_join(transform(sequence(1, 40), x -> sha2(concat(id, x), 256)), '')").alias("html")).coalesce(1)
    warc.write_archives(pages, f"{tmp_path}/w", archive_bytes=37001)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "37001")
        out = warc.read_archives(spark, f"{tmp_path}/w")
        assert out.rdd.getNumPartitions() > 8
        assert sorted(r.page_id for r in out.collect()) == list(range(400))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_warc_damage_is_noticed(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([(1, "u", "hello " * 40)], "page_id long, url string, html string"), f"{tmp_path}/w")
    f = next(f for f in (tmp_path / "w").iterdir() if f.name.endswith(".warc.gz"))
    whole = gzip.open(f).read()
    for wrong, why in ((whole.replace(b"hello", b"jello", 1), "damaged"), (whole[:-30], "ends inside"), (whole.replace(b"response\r\nContent-Length: 3", b"response\r\nContent-Length: 2"), "longer than")):
        f.write_bytes(gzip.compress(wrong))
        for crc in (tmp_path / "w").glob(".*.crc"):
            crc.unlink()
        with pytest.raises(Exception, match=why):
            warc.read_archives(spark, f"{tmp_path}/w").collect()
    with pytest.raises(ValueError, match="exists"):
        warc.write_archives(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), f"{tmp_path}/w")


def test_warc_archives_are_bounded_by_bytes(spark, tmp_path):
    """Twenty pages of a megabyte that hardly compress, before twenty thousand small ones, and one of 17 MiB."""
    text = lambda n: F.expr(f"array_join(transform(sequence(1, {n}), x -> sha2(concat(id, x), 512)), '')")
    pages = spark.range(20).select("id", text(8000).alias("html")).union(spark.range(20, 20_020).select("id", text(1))).union(spark.range(30_000, 30_001).select("id", F.repeat(F.lit("x"), 17 << 20)))
    pages = pages.coalesce(1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), "html")
    warc.write_archives(pages, f"{tmp_path}/w", archive_bytes=1 << 20)
    sizes = [f.stat().st_size for f in (tmp_path / "w").iterdir() if f.name.endswith(".warc.gz")]
    assert max(sizes) <= 1 << 20 and len(sizes) > 10 and sum(s > 1 << 19 for s in sizes) >= len(sizes) - 2
    rows = warc.read_archives(spark, f"{tmp_path}/w").collect()
    assert Counter(r.page_id for r in rows) == Counter([*range(20_020), 30_000]) and {r.payload_bytes for r in rows if r.page_id == 30_000} == {17 << 20}


def test_foreign_archives_are_read(spark, tmp_path):
    import base64

    def made(kind, uri, block, **more):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uri}>", "WARC-Date: 2020-01-01T00:00:00Z", f"WARC-Target-URI: http://{uri}/", *(f"{k.replace('_', '-')}: {v}" for k, v in more.items()), f"Content-Length: {len(block)}", "", ""]
        return "\r\n".join(lines).encode() + block + b"\r\n\r\n"

    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    odd = b"tricky\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\nWARC/1.1 end\r\n"
    page = b"<html>\xe9 raw bytes</html>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    own = dict(Content_Type="application/http; msgtype=response")
    all_of = [
        made("warcinfo", "info", b"software: other\r\n"), made("request", "r", b"GET / HTTP/1.1\r\n\r\n"), made("response", "a", http + page, WARC_Payload_Digest=sha1(page), **own), made("response", "b", http + odd, **own),
        made("resource", "c", odd, Content_Type="text/plain"), made("response", "d", http, **own), made("revisit", "e", b"", WARC_Payload_Digest=sha1(page), WARC_Refers_To="<urn:uuid:a>"), made("metadata", "m", odd), made("response", "f", http + odd * 300, **own),
    ]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in all_of))
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(b"".join(all_of)))
    (tmp_path / "other.txt").write_text("no archive")
    want = Counter({("a", "response", page): 2, ("b", "response", odd): 2, ("c", "resource", odd): 2, ("d", "response", b""): 2, ("e", "revisit", None): 2, ("f", "response", odd * 300): 2})
    rows = warc.read_archives(spark, str(tmp_path), payloads=True).collect()
    assert Counter((r.target_uri[7:-1], r.record_type, None if r.payload is None else bytes(r.payload)) for r in rows) == want
    assert all(r.page_id is None and r.date == "2020-01-01T00:00:00Z" and r.record_id == f"<urn:uuid:{r.target_uri[7:-1]}>" for r in rows)
    assert all(r.payload_digest == hashlib.sha256(bytes(r.payload)).hexdigest() for r in rows if r.payload is not None)
    assert {(r.payload_digest, r.refers_to_id) for r in rows if r.record_type == "revisit"} == {(sha1(page), "<urn:uuid:a>")}
    (tmp_path / "bad.warc.gz").write_bytes(gzip.compress(made("response", "z", http + page, WARC_Payload_Digest=sha1(b"other"), **own)))
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spark, f"{tmp_path}/bad.warc.gz").collect()


def test_pipeline_stage_by_stage(spark, sf001):
    docs = table(spark, sf001, "documents")
    columns, before = docs.columns, docs
    model = toxicity.train(docs, table(spark, sf001, "labels"))
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf001).cache()
        rows, was = after.collect(), before.collect()
        if name != "bpe":
            assert after.columns == columns
        if name == "toxicity":
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in was if model.score(r.text) < 0.3)
        elif name == "near_duplicates":
            want = {d for d, _, c in brute_groups([(r.doc_id, r.text) for r in was]) if d == c}
            assert {r.doc_id for r in rows} == want and len(rows) == len(want)
        elif name == "pii":
            texts = {r.doc_id: r.text for r in rows}
            assert len(rows) == len(was)
            for r in was:
                assert texts[r.doc_id] == pii.redact(r.text, pii.find(r.text))
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "mixing":
            taken = {r.doc_id: (r.mix.taken, r.mix.size) for r in mixing.mix_sources(before).collect()}
            times = Counter(r.doc_id for r in rows)
            assert all(times[d] == int(t / s + 0.5) for d, (t, s) in taken.items() if s)
        else:
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in was)
            shas = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in was}
            assert all(r.decoded_sha256 == shas[r.doc_id] and len(r.ids) == r.n_tokens for r in rows)
        before = after
    last = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf001).collect()) == last
