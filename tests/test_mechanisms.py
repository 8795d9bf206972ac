"""Exact splits, digests, versions, sidecars, ledger, numbered lines, batches and large matchings against plain Python."""

import hashlib
import json
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera import scratch
from tessera.functions import jsonparse as J
from tessera.functions import modelparse as M
from tessera.operators import align, collate, digest, kernels, match, metrics, references, select, shuffle, split
from tessera.plans import catalogue, parsing
from tessera.plans import views as V
from tessera.schemas import ELEMENTS
from tessera.sources import jsonl, sidecars, versions
from tessera.streaming import ledger, stopping, stream

catalogue.load()


# ---- splits and digests


def plain_hash(key, seed=7):
    return int(hashlib.md5(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("few", [10_000, 1])
def test_kth_is_that_of_a_sort(spark, monkeypatch, few):
    monkeypatch.setattr(select, "FEW", few)
    keys = [f"k{n % 900}" for n in range(1000)] + [None] * 5
    df = spark.createDataFrame([(k,) for k in keys], "key string").repartition(7).select(select.keyed_hash(F.col("key"), 7).alias("h"), "key")
    order = sorted((plain_hash(k), k is not None, k) for k in keys)
    for k in (1, 2, 500, 1004, 1005):
        assert select.kth(df, k) == (order[k - 1][0], order[k - 1][2])
    assert select.kth(df, 1006) is None
    with pytest.raises(ValueError):
        select.kth(df, 0)


def test_kth_among_equal_hashes(spark, monkeypatch):
    monkeypatch.setattr(select, "FEW", 3)
    df = spark.createDataFrame([(5, k) for k in "bbbbbaaaacc"] + [(9, "z")], "h long, key string")
    assert [select.kth(df, k)[1] for k in (1, 4, 5, 9, 10, 11, 12)] == list("aabbccz")


@pytest.mark.parametrize("n, ratio", [(1, 0.5), (2, 0.9), (5, 0.5), (25, 0.1), (1000, 0.25), (1001, 0.0001)])
def test_exact_split_has_its_size_under_any_partitioning(spark, n, ratio):
    df = spark.createDataFrame([(f"id{i}", "img") for i in range(n)], "id string, source_image string")
    out = split.exact_split(df.repartition(3), ratio, 7)
    got = {r.id for r in out.collect() if r.is_validation}
    assert got == set(sorted((f"id{i}" for i in range(n)), key=lambda i: (plain_hash(i), i))[: split.validation_count(n, ratio)])
    assert out.columns == ["id", "is_validation"]
    assert got == {r.id for r in split.exact_split(df.coalesce(1), ratio, 7).collect() if r.is_validation}


def test_seeded_split_query_is_the_shuffle_of_all_rows(spark, sf):
    rows = sorted((r.image, r._ord, r.id) for r in V.pred(spark, sf).select("image", "_ord", "id").collect())
    ids = [i for *_, i in rows]
    random.Random(42).shuffle(ids)
    n = split.validation_count(len(ids), 0.1)
    got = {r.id: r.part for r in parsing.seeded_split(spark, sf).collect()}
    assert got == {i: "validation" if k < n else "train" for k, i in enumerate(ids)}


def test_seeded_split_beyond_five_million_rows(spark):
    n = 5_000_100
    t, v = split.seeded_split(spark.range(n).select("id", F.lit(None).cast("string").alias("image"), F.col("id").alias("_ord")), 0.001, 3)
    ids = list(range(n))
    random.Random(3).shuffle(ids)
    assert {r.id for r in v.collect()} == set(ids[: split.validation_count(n, 0.001)]) and t.count() == n - v.count()


@pytest.mark.parametrize("n, ratio, seed", [(1, 0.5, 3), (2, 0.5, 0), (63, 0.9, 1), (64, 0.5, 2), (5000, 0.1, 42)])
def test_seeded_split_by_small_blocks_and_a_shuffled_join(spark, monkeypatch, n, ratio, seed):
    for name, value in (("BLOCK", 700), ("STEPS", 90)):
        monkeypatch.setattr(shuffle, name, value)
    monkeypatch.setattr(split, "BROADCAST_ROWS", 0)
    t, v = split.seeded_split(spark.range(n).select(F.col("id").cast("string").alias("id"), F.format_string("%05d", F.col("id") % 77).alias("image"), F.col("id").alias("_ord")).repartition(3), ratio, seed)
    ids = sorted(range(n), key=lambda i: (i % 77, i))
    random.Random(seed).shuffle(ids)
    first = split.validation_count(n, ratio)
    assert {int(r.id) for r in v.collect()} == set(ids[:first]) and {int(r.id) for r in t.collect()} == set(ids[first:])


def test_draws_are_those_of_random():
    for seed, high in ((9, (1 << 32) + 500), (4, 1 << 20), (5, 3000)):
        own, low = random.Random(seed), high - 400 if high != 1 << 20 else high
        assert shuffle.draws(shuffle.generator(seed), high, low).tolist() == [own._randbelow(i + 1) for i in range(high, low - 1, -1)]


def test_exact_split_refuses(spark):
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    for bad in (df.union(df), df.limit(0), df.union(spark.createDataFrame([("",)], "id string")), df.union(spark.createDataFrame([(None,)], "id string"))):
        with pytest.raises(ValueError, match="unique"):
            split.exact_split(bad, 0.5, 1)
    with pytest.raises(ValueError, match="ratio"):
        split.exact_split(df, 1.0, 1)


def plain_tree(ids, depth):
    """Node to (rows, digest) by nested sorting."""
    ids = sorted((hashlib.md5(i.encode()).hexdigest(), i) for i in ids)
    out = {}
    for h, i in ids:
        out.setdefault(h[:depth], []).append(i)
    level = {n: (len(x), hashlib.sha256("\n".join(x).encode()).hexdigest()) for n, x in out.items()}
    every = {(depth, n): v for n, v in level.items()}
    for d in range(depth - 1, -1, -1):
        above = defaultdict(list)
        for n in sorted(level):
            above[n[:d]].append((level[n][0], f"{n} {level[n][1]}"))
        level = {n: (sum(r for r, _ in x), hashlib.sha256("\n".join(t for _, t in x).encode()).hexdigest()) for n, x in above.items()}
        every |= {(d, n): v for n, v in level.items()}
    return every


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_digest_tree_is_the_plain_one(spark, depth):
    ids = [f"é{n}" for n in range(300)] + ["", "é1"]
    df = spark.createDataFrame([(i or None,) for i in ids], "id string")
    for d in (df, df.repartition(6)):
        assert {(r.level, r.node): (r.rows, r.digest) for r in digest.tree(d, depth=depth).collect()} == plain_tree(ids, depth)
    assert digest.root(digest.tree(df.limit(0), depth=depth))[0] == 0


def test_changed_id_is_found_along_one_path(spark):
    a = spark.range(20_000).select(F.concat(F.lit("id"), "id").alias("id"))
    b = a.withColumn("id", F.when(F.col("id") == "id777", "id777x").otherwise(F.col("id")))
    assert digest.depth_of(20_000) == 2 and digest.depth_of(0) == 0
    left, right = (digest.tree(x, depth=2) for x in (a, b))
    assert digest.first_difference(left, left) == []
    path = digest.first_difference(left, right)
    assert [p["level"] for p in path] == [0, 1, 2] and path[0]["left_rows"] == 20_000
    changed = {hashlib.md5(i.encode()).hexdigest()[:2]: (i, side) for i, side in (("id777", "left"), ("id777x", "right"))}
    first = min(changed)
    assert path[-1]["node"] == first
    assert {tuple(r) for r in digest.changed(a, b, path).collect()} >= {changed[first]}
    assert digest.first_difference(left, digest.tree(a.limit(0), depth=2))[-1]["right"] is None
    with pytest.raises(ValueError):
        digest.first_difference(left, digest.tree(a, depth=1))


def test_metadata_notices_a_changed_id(spark):
    df = spark.createDataFrame([(f"id{i}",) for i in range(50)], "id string")
    s = split.exact_split(df, 0.2, 3)
    t, v = s.filter("not is_validation"), s.filter("is_validation")
    m = split.metadata(t, v, 0.2, 3)
    assert (m["training_count"], m["validation_count"]) == (40, 10) and split.verify(m, t.repartition(9), v) == []
    assert split.verify(m, t.withColumn("id", F.concat("id", F.lit("x"))), v) == ["training_ids_hash"]


# ---- versions and sidecars


def test_version_stays_while_a_writer_stops_between_two_tables(spark, tmp_path):
    store = versions.Versions(spark, f"{tmp_path}/s")
    assert store.current() is None
    with pytest.raises(ValueError):
        store.rollback()
    store.write({"a": spark.range(1), "b": spark.range(10)})
    broken = spark.range(5).select(F.raise_error(F.lit("stopped")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stopped"):
        store.write({"a": spark.range(2), "b": broken})
    assert (store.read("a").count(), store.read("b").count()) == (1, 10)
    store.write({"a": spark.range(3), "b": store.read("b").filter("id < 4")})
    assert (store.read("a").count(), store.read("b").count()) == (3, 4)
    store.rollback()
    assert (store.read("a").count(), store.read("b").count()) == (1, 10)
    store.write({"a": spark.range(7)})
    assert store.read("a").count() == 7
    with pytest.raises(ValueError):
        store.read("b")
    store.rollback()
    assert store.read("b").count() == 10
    assert len(store.log()) == 5 and len(store.clean(keep=1)) == 2
    assert store.read("b").count() == 10 and store.clean(keep=1) != []


DOC = "role string, id string, raw_model_output string, parse_ok boolean, parse_error string, element_count int"


def test_sidecars_are_replaced_pruned_and_reported(spark, tmp_path):
    store = sidecars.Sidecars(spark, f"{tmp_path}/s")
    made = lambda rows: spark.createDataFrame(rows, DOC)
    store.write(made([("t", "1", "é", True, None, 3), ("t", "2", "bad " * 100, False, "why", 0), ("t", "3", "x", None, None, None), ("s", "1", "y", True, None, 9), ("s", "9", "y", True, None, 9)]))
    assert {tuple(r) for r in store.report().select("role", "total_files", "parse_ok", "parse_failed", "total_elements").collect()} == {("t", 3, 1, 2, 3), ("s", 2, 2, 0, 18)}
    assert {(r.id, len(r.preview)) for r in store.failures().collect()} == {("2", 200), ("3", 1)}
    ids = spark.createDataFrame([("1",), ("2",), ("4",)], "id string")
    new = made([("t", "2", "z", True, None, 5), ("t", "2", "z", True, None, 5), ("t", "8", "z", True, None, 7)])
    for _ in range(2):  # a rerun changes nothing
        store.write(new, manifest=ids)
        assert {(r.role, r.id, r.element_count) for r in store.documents().collect()} == {("t", "1", 3), ("t", "2", 5), ("s", "1", 9), ("s", "9", 9)}
        assert store.documents("t").count() == 2 and store.failures().count() == 0
    store.write(made([]), manifest=ids)
    assert store.documents().count() == 4


def test_sidecars_leave_compressed_documents_and_no_shuffle_files(spark, tmp_path):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f.getName() for f in [blocks.getAllFiles().apply(i) for i in range(blocks.getAllFiles().size())] if f.getName().startswith("shuffle_")}
    store, before = sidecars.Sidecars(spark, f"{tmp_path}/s"), shuffled()
    docs = spark.range(20_000).select(F.lit("t").alias("role"), F.col("id").cast("string").alias("id"), F.repeat(F.lit("answer "), 50).alias("raw_model_output"), (F.col("id") % 3 > 0).alias("parse_ok"), F.lit(None).cast("string").alias("parse_error"), F.lit(2).alias("element_count"))
    ids = spark.range(15_000).select(F.col("id").cast("string").alias("id"))
    store.write(docs)
    store.write(docs.filter("id % 4 = 0").withColumn("parse_ok", F.lit(True)), manifest=ids)
    for _ in range(50):  # files go behind the write
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before
    assert spark.conf.get(scratch.FREED, "false") == "false"
    files = [f for f in (tmp_path / "s").rglob("part-*") if "documents" in f.parts]
    assert files and all(f.name.endswith(".json.gz") for f in files) and sum(f.stat().st_size for f in files) < 1_000_000
    failed = [i for i in range(15_000) if i % 3 == 0 and i % 4]
    assert tuple(store.report().first()) == ("t", 15_000, 15_000 - len(failed), len(failed), 2 * (15_000 - len(failed)))
    assert {int(r.id) for r in store.failures().collect()} == set(failed)


def test_answers_of_the_sidecars_are_derived_behind_their_shuffle(spark, sf):
    plan = parsing.raw_answers(spark, sf)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning") :]
    assert plan.count("Exchange hashpartitioning") == 1 and "l_shipdate" in below and "concat_ws" in plan and "concat_ws" not in below


def test_foreign_sidecars_are_scanned(spark, tmp_path):
    folder = tmp_path / "json" / "teacher"
    folder.mkdir(parents=True)
    for name, doc in (("a-1", {"id": "a-1", "parse_ok": True, "element_count": 2}), ("a-2", {"parse_ok": False, "parse_error": "e", "raw_model_output": "line\none"}), ("parse_report", {"total_files": 9})):
        (folder / f"{name}.json").write_text(json.dumps(doc, indent=2))
    docs = sidecars.scan(spark, str(tmp_path), "teacher", "id string, parse_ok boolean, parse_error string, element_count int, raw_model_output string")
    assert tuple(sidecars.report(docs).first()) == (2, 1, 1, 2)
    assert [tuple(r) for r in sidecars.failures(docs).collect()] == [("a-2", "e", "line one")]


# ---- ledger


def test_ledger_takes_each_id_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "MERGE_EVERY", 2)
    draw, done, seen = random.Random(2), ledger.Ledger(spark, f"{tmp_path}/l", buckets=4), set()
    assert done.last() == -1 and done.rows() is None and done.size().first().ids == 0
    done.append(spark.createDataFrame([], "id string, v int"), 0)
    for number in range(1, 5):
        ids = [str(draw.randrange(2500)) for _ in range(900)] + [None]
        batch = spark.createDataFrame([(i, number) for i in ids], "id string, v int")
        got = done.append(batch, number)
        new = set(ids) - seen
        assert got["new"] == len(new) and got["asked"] >= len(set(ids) & seen)
        seen |= set(ids)
        assert Counter(r.id for r in done.rows().collect()) == Counter(seen)
        assert done.append(batch, number)["rows"] == 0  # a replay
    assert done.rows().filter("id is null").count() == 1
    size = done.size().first()
    assert (size.batches, size.ids, size.filters) == (5, len(seen), 4)


def test_ledger_overwrites_what_a_stopped_batch_left(spark, tmp_path):
    done = ledger.Ledger(spark, f"{tmp_path}/l")
    done.append(spark.createDataFrame([("a",)], "id string"), 0)
    spark.createDataFrame([("zzz",)], "id string").write.parquet(f"{tmp_path}/l/rows/batch=1")
    spark.createDataFrame([("zzz", 0)], "id string, bucket int").write.parquet(f"{tmp_path}/l/ids/batch=1/part=0")
    assert [r.id for r in done.rows().collect()] == ["a"] and done.size().first().ids == 1
    assert done.append(spark.createDataFrame([("a",), ("b",)], "id string"), 1)["new"] == 1
    assert sorted(r.id for r in done.rows().collect()) == ["a", "b"]


def test_filters_exclude_new_ids(spark, tmp_path):
    done = ledger.Ledger(spark, f"{tmp_path}/l", buckets=8)
    done.append(spark.range(20_000).select(F.col("id").cast("string")), 0)
    got = done.append(spark.range(20_000, 40_000).select(F.col("id").cast("string")), 1)
    assert got["new"] == 20_000 and got["asked"] < 400


def test_ledger_behind_a_stream(spark, tmp_path):
    for n in range(3):
        spark.range(n * 50, n * 50 + 100).select(F.col("id").cast("string").alias("id")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    done = ledger.Ledger(spark, f"{tmp_path}/l")
    stream.run_each(stream.file_stream(spark, f"{tmp_path}/in", "id string"), f"{tmp_path}/state", done.append)
    assert Counter(int(r.id) for r in done.rows().collect()) == Counter(range(200)) and done.last() == 2


@pytest.mark.parametrize("min_delta", [0.0, 0.3])
def test_stopper_over_batches_is_the_fold(spark, tmp_path, min_delta):
    draw, patience = random.Random(13), 4
    rows = [(draw.choice(["a", "b", "c", None]), n, draw.choice([None, *(round(draw.random() * 5 / (1 + n / 60), 2) for _ in range(6))])) for n in range(240)]
    stopper = stopping.Stopper(spark, f"{tmp_path}/s", "k", ["n"], "x", patience, min_delta)
    assert stopper.states().count() == 0
    for number in range(4):
        part = rows[number * 60 : number * 60 + 60]
        batch = spark.createDataFrame(draw.sample(part, len(part)), "k string, n int, x double")
        stopper.append(batch, number)
        stopper.append(batch, number)  # a replay
        want = {}
        for key in {r[0] for r in rows[: number * 60 + 60]}:
            best, bad, steps, stopped = None, 0, 0, None
            for k, _, x in rows[: number * 60 + 60]:
                if k != key or stopped:
                    continue
                steps += 1
                if x is not None and (best is None or x < best - min_delta):
                    best, bad = x, 0
                elif best is not None:
                    bad += 1
                    stopped = steps if bad >= patience else None
            want[key] = (best, bad, steps, stopped)
        assert {r.key: (r.best, r.bad, r.steps, r.stopped_at) for r in stopper.states().collect()} == want


# ---- lines


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    draw, want = random.Random(3), {}
    for name in ("a", "b"):
        text = ["\ufeff" + json.dumps({"id": "first"})] + [draw.choice(["", "  ", "\x1c", json.dumps({"id": "x" * draw.randrange(80)}) + draw.choice(["", "\r"])]) for _ in range(400)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(text), encoding="utf-8", newline="")
        want |= {(name, i): t.strip("\ufeff\r") for i, t in enumerate(text, 1) if t.strip(" \ufeff\x1c")}
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        rows = jsonl.lines(spark, str(tmp_path)).collect()
        assert {(r.file.rsplit("/", 1)[1][0], r.line): r.text for r in rows} == want and len(rows) == len(want)
        first = jsonl.read_jsonl(spark, str(tmp_path), "id string", max_samples=7).collect()
        assert [(r._ord.file.rsplit("/", 1)[1][0], r._ord.line) for r in first] == sorted(want)[:7] and first[0].id == "first"
        assert jsonl.read_jsonl(spark, str(tmp_path), "id string", max_samples=100_000).count() == len(want)
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_bad_line_is_named(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "1"}\n\n{"id": \n{"id": 5}\n[1]\n')
    with pytest.raises(Exception, match=r"x\.jsonl:3 is malformed"):
        jsonl.read_jsonl(spark, f"{tmp_path}/x.jsonl", "id string").select("id").collect()
    rows = jsonl.read_jsonl(spark, f"{tmp_path}/x.jsonl", "id string", strict=False).orderBy("_ord").collect()
    assert [(r._ord.line, r.id, r._bad) for r in rows][:3] == [(1, "1", None), (3, None, '{"id": '), (4, "5", None)]
    assert len(jsonl.first_files(spark, f"{tmp_path}/x.jsonl", 1)) == 1


# ---- answers


def hostile():
    good = {"text": " Save ", "bbox_norm": [1, 2, 30, 40], "focused": True}
    whole = lambda *es, **more: {"elements": list(es), "coordinate_system": "normalized_0_1000"} | more
    bare = {k: v for k, v in good.items() if k != "focused"}
    values = [whole(good), whole(good, bare), whole(bare), whole(good | {"focused": None}), whole(), whole(good | {"text": "  icon "}), whole(good | {"text": "  "}), whole(good | {"text": None}, good), whole(good | {"text": 5}),
              whole(good | {"bbox_norm": [1, 2, 3]}, good), whole(good | {"bbox_norm": [5, 2, 3, 4]}, good), whole(good | {"bbox_norm": [1, 2, 3, 4.0]}), whole(good | {"bbox_norm": ["1", 2, 3, 4]}), whole(good | {"bbox_norm": None}, good),
              whole(good | {"bbox_norm": [1, 2, None, 4]}, good), whole(good | {"bbox_norm": [True, 2, 3, 4]}), whole(good | {"bbox_norm": [1, 2, 3, 10**30]}), whole(good | {"type": "button"}), whole(None, good), whole([1], good), whole(good, "x"),
              whole(good, coordinate_system="pixels"), whole(good, coordinate_system=None), whole(good, coordinate_system=5), {"elements": [good]}, {"elements": good}, {"elements": None}, {"other": 1}, [whole(good)], "text", 5, None,
              whole(good | {"text": "a b é \U0001f600"}), whole(good | {"text": "\ud800x"}), whole(good | {"text": "Menu Item"}, good), whole(good, note="extra"), whole(good | {"text": "a}{b"}), whole(good | {"text": "“q”：”"})]
    texts = [json.dumps(v, ensure_ascii=e) for v in values for e in ((True, False) if "\\ud8" not in json.dumps(v).lower() else (True,))]
    one = json.dumps(whole(good))
    texts += [None, "", " \x1c ", f"```json\n{one}\n```", f"```\n\n {one} \n\n```  ", f"```json\r\n{one}\r\n```", f"```json\n{one}", f"```json\n[{one}]\n```", f"```json\n{one}\n``` done", f"`{one}`", "```\n```", f"Here {{it}} is: {one}",
              f"Here: {one} Done", f"{one} {one}", f"{one[:-1]},}}", one[:-2], one[:60], one[: one.index("]")], f"[1] {one}", f"5 {one}", f'"a" {one}', f"Note: {one}", f"none: {one}", f"\ufeff{one}", one.replace('"', "“"),
              one.replace('"text"', '"text": 1, "text"'), one.replace("1, 2", "NaN, 2"), one.replace("1, 2", "01, 2"), one.replace("Save", "Sa\tve"), one.replace("Save", "Sa\\u0000ve"), "{" * 3000, '{"elements":' + "[" * 3000, "a|button|1|2|3|4|true", one.replace(" ", "\n"), f"  \n{one}\n "]
    return texts


def test_native_answers_are_those_of_the_plain_parser(spark, sf):
    texts = hostile()
    df = spark.createDataFrame(list(enumerate(texts)), "n int, raw string")
    df = df.unionByName(parsing.raw_answers(spark, sf).select(F.lit(-1).alias("n"), "raw"))
    native = 0
    for r in J.parse_answers(df.withColumn("native", J.native_answer(F.col("raw"))), "raw", "p").collect():
        want = J.parse_answer(r.raw)
        assert r.p.asDict(True) == want, r.raw
        if r.native is not None:
            native += 1
            assert r.native.asDict(True) == want, r.raw
    assert native > 400
    shares = {r.how: r.native / r.rows for r in parsing.answer_paths(spark, sf).collect()}
    assert shares == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0, 5: 1}


@pytest.mark.parametrize("text, want, n", [
    ('{"bbox": 1, 2.5 ,-3,4e1 , "t":1}', '{"bbox": [1, 2.5 ,-3,4e1] , "t":1}', 1), ('{"bbox": [ 1,2,3,4 , "t":1,"box":5,6,7,8 ]}', '{"bbox": [ 1,2,3,4] , "t":1,"box":[5,6,7,8 ]}', 2),
    ('{"coordinates="1,2,3,4],"t":"bbox"}', '{"coordinates":[1,2,3,4],"t":"bbox"}', 1), ('{"bbox": 1,2,3, "t":1}', '{"bbox": 1,2,3, "t":1}', 0), ('{"bbox": [1,2,3,4], "t":1}', '{"bbox": [1,2,3,4], "t":1}', 0),
    ('{"bbox": 1,2,3,4}', '{"bbox": 1,2,3,4}', 0), ('{"bbox="1,2,3,4,"t":1}', '{"bbox="1,2,3,4,"t":1}', 0), ('{"x_bbox": 1,2,3,4 ]', '{"x_bbox": 1,2,3,4 ]', 0)])
def test_box_repair(spark, text, want, n):
    new, kinds = J.repaired(text)
    assert (new, len(kinds)) == (want, n)
    parts = spark.range(1).select(F.filter(F.transform(J.mended_parts(F.lit(text)), lambda p: p["mended"]), lambda m: m.isNotNull()).alias("k")).first().k
    assert parts == kinds and len(J.notes_of(kinds)) == len(set(kinds))
    assert tuple(spark.range(1).select(J.repair_boxes(F.lit(text)), J.repair_notes(F.lit(text))).first()) == (want, n)


# ---- batches


def test_batches_are_bounded_and_come_back(spark, sf):
    draw = random.Random(6)
    rows = [(i, [draw.randrange(1, 99) for _ in range(draw.choice([0, 1, 5, 63, 64, 65, 300, 1500]))], draw.choice([None, 0, 3, 400])) for i in range(400)] + [(None, [1, 2], 1), (900, None, 2)]
    df = spark.createDataFrame(rows, "id int, input_ids array<int>, prompt_token_len int").repartition(5)
    got = collate.collated(df, 1000, pad=7).collect()
    assert Counter(i for b in got for i in b.ids) == Counter(r[0] for r in rows)
    for b in got:
        assert len(b.ids) == 1 or len(b.ids) * b.longest <= 1000
        assert b.longest == max(sum(m) for m in b.attention_mask) and b.real_tokens == sum(map(sum, b.attention_mask))
        for part in (b.input_ids, b.attention_mask, b.labels):
            assert all(len(x) == b.longest for x in part)
        for x, m, y in zip(b.input_ids, b.attention_mask, b.labels):
            n = sum(m)
            assert m == [1] * n + [0] * (b.longest - n) and x[n:] == [7] * (b.longest - n) and y[n:] == [-100] * (b.longest - n)
    by_class = defaultdict(list)
    for b in got:
        by_class[b["class"]].append((b.batch, len(b.ids)))
    for k, sizes in by_class.items():
        assert [n for n, _ in sorted(sizes)] == list(range(len(sizes)))
        assert len({n for _, n in sorted(sizes)[:-1]}) <= 1  # all but the last are full
    back = {r.id: (r.input_ids, r.labels) for r in collate.unpadded(collate.collated(df, 1000)).collect()}
    assert back == {i: (x or [], [-100 if k < (p or 0) else t for k, t in enumerate(x or [])]) for i, x, p in rows}
    assert collate.collated(df.limit(0), 10).count() == 0


def test_positions_by_two_columns_in_many_ranges(spark):
    df = spark.createDataFrame([(n % 3, n) for n in range(500)], "a int, b int").repartition(4)
    got = [(r.a, r.b) for r in align.global_position(df, "a", "b", ranges=20).orderBy("position").collect()]
    assert got == sorted(got) and len(got) == 500


# ---- matching


def plain_greedy(p, r):
    """Every pair of one text, best overlap first."""

    def iou(a, b):
        if a is None or b is None:
            return 0.0
        w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
        return w * h / union if union > 0 else 0.0

    pairs = sorted((-iou(a["box"], b["box"]), i, j) for i, a in enumerate(p) for j, b in enumerate(r) if a["text"] == b["text"])
    ps, rs, total, boxes = set(), set(), 0.0, 0
    for v, i, j in pairs:
        if i not in ps and j not in rs:
            ps.add(i)
            rs.add(j)
            total -= v
            boxes += p[i]["box"] is not None and r[j]["box"] is not None
    return len(ps), total, boxes


def random_elements(draw, n, texts, side, none=0.1):
    out = []
    for _ in range(n):
        x, y = draw.randrange(side), draw.randrange(side)
        out.append({"text": draw.choice(texts), "box": None if draw.random() < none else [x, y, x + draw.randrange(1, 30), y + draw.randrange(1, 30)]})
    return out


def test_kernel_matches_as_every_pair_in_turn():
    draw = random.Random(8)
    for side in (5, 40, 400):
        for _ in range(60):
            p, r = (random_elements(draw, draw.randrange(40), ["a", "b"], side) for _ in range(2))
            got, want = kernels.greedy(p, r), plain_greedy(p, r)
            assert (got[0], got[2]) == (want[0], want[2]) and got[1] == pytest.approx(want[1])


def test_large_samples_go_to_the_kernel(spark, monkeypatch):
    monkeypatch.setattr(match, "LARGE", 200)
    draw = random.Random(9)
    rows = [(k, random_elements(draw, n, ["a", "b"], 60), random_elements(draw, n, ["a", "b"], 60)) for k, n in enumerate((0, 3, 14, 15, 40, 150))]
    df = spark.createDataFrame([(k, [(e["text"], e["box"]) for e in p], [(e["text"], e["box"]) for e in r]) for k, p, r in rows], f"k int, p {match.USABLE}, r {match.USABLE}")
    got = {x.k: tuple(x.m) for x in df.select("k", match.one_to_one(F.col("p"), F.col("r")).alias("m")).collect()}
    for k, p, r in rows:
        want = plain_greedy(p, r)
        assert (got[k][0], got[k][2]) == (want[0], want[2]) and got[k][1] == pytest.approx(want[1])


def test_twenty_thousand_elements_a_side():
    import resource

    draw = random.Random(10)
    p, r = (random_elements(draw, 20_000, ["a", "b", "c"], 970) for _ in range(2))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    tp, total, boxes = kernels.greedy(p, r)
    assert tp >= 19_000 and 0 < total < boxes <= tp
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # KB


def test_evaluate_large_is_that_of_every_pair(spark, sf):
    def elements(df):
        s = df.select("id", match.usable(F.col("elements")).alias("e"))
        return {r.id: [{"text": e.text, "box": e.box} for e in r.e] for r in s.collect()}

    from tessera.plans.evaluation import by_supplier, evaluate_large

    p, r = elements(by_supplier(V.el_pred(spark, sf))), elements(by_supplier(V.el_ref(spark, sf)))
    got = {x.key: x for x in evaluate_large(spark, sf).collect()}
    assert set(got) == set(p) | set(r) and max(len(p[k]) * len(r[k]) for k in p) > match.LARGE
    for k, x in got.items():
        tp, total, boxes = plain_greedy(p[k], r[k])
        assert (x.element_tp, x.matched_bbox_count) == (tp, boxes) and x.bbox_iou == pytest.approx(total / tp, abs=1e-6)


def test_evaluate_large_shuffles_its_lines_once(spark, sf):
    from tessera.plans.evaluation import R, by_supplier, evaluate_large

    got = evaluate_large(spark, sf)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    s = metrics.score_samples(by_supplier(V.el_pred(spark, sf)), by_supplier(V.el_ref(spark, sf)))
    s = s.withColumn("bbox_iou", F.round("bbox_iou", R)).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, s.collect()))


def test_aligned_elements_of_one_side(spark):
    rows = spark.createDataFrame([(1, 2, "b", None), (1, 1, "a", "c"), (2, 1, None, "d"), (3, 1, None, None)], "sample long, n int, pred string, ref string")
    got = {r.key: (r.pred and r.pred.elements, r.ref and r.ref.elements) for r in align.aligned_elements(rows, "sample", ["n"]).collect()}
    assert got == {"1": (["a", "b"], ["c"]), "2": (None, ["d"]), "3": (None, None)}


def test_evaluate_large_never_has_a_sample_as_a_row(spark, sf):
    from tessera.plans.evaluation import evaluate_large

    plan = evaluate_large(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan  # rows of elements, one sample after the other
    assert not any(x in plan for x in ("collect_list", "ArrowEvalPython", "BatchEvalPython"))  # which hold all samples of a batch


def test_scores_of_element_rows_are_those_of_samples(spark):
    draw = random.Random(12)

    def element():
        x, y = float(draw.randrange(60)), float(draw.randrange(60))
        box = draw.choice([None, [], [5.0, 5.0, 4.0, 9.0], [x, 2.0, 3.0], [x, float("nan"), 1001.0, 70.0], [x + 0.5, None, 70.0, 70.0]])
        box = box if draw.random() < 0.2 else [x + draw.randrange(4) / 4, y, x + 1.0 + draw.randrange(30), y + 0.25 + draw.randrange(30)]
        return draw.choice([None, "", " \n ", "A", " a", "a  b", "B", "b", "\u00c4"]), box

    rows = []
    for key in ("1", " 2", "three", "only pred", "only ref", "neither"):
        for n in range(30):
            p, r = element(), element()
            pred = None if draw.random() < 0.2 or key in ("only ref", "neither") else p
            rows.append((key, n // 2 if n else None, draw.choice("xy") + str(n), pred, None if draw.random() < 0.2 or key in ("only pred", "neither") else r))
    e = "struct<text:string,bbox_norm:array<double>>"
    df = spark.createDataFrame(rows, f"sample string, n int, part string, pred {e}, ref {e}").repartition(7)
    got, want = metrics.score_elements(df, "sample", ["n", "part"]), metrics.score_aligned(align.aligned_elements(df, "sample", ["n", "part"]))
    assert [c for c in got.dtypes if "repeats" not in c[0]] == [c for c in want.dtypes if "repeats" not in c[0]]
    got, want = ({x.key: x.asDict() for x in d.collect()} for d in (got, want))
    assert got == {k: x | {"bbox_iou": pytest.approx(x["bbox_iou"])} for k, x in want.items()} and len(got) == 6
    assert sum(x["element_tp"] for x in got.values()) > 30


def test_texts_matched_together_and_alone_agree(monkeypatch):
    draw = random.Random(13)
    p, r = (random_elements(draw, 300, "aaaaaaaabcdef", 60) for _ in range(2))
    want = kernels.greedy(p, r)
    assert (want[0], want[2]) == (lambda x: (x[0], x[2]))(plain_greedy(p, r))
    for most in (1, 500, 1500, 10_000):
        monkeypatch.setattr(kernels, "AT_ONCE", most)
        assert kernels.greedy(p, r) == want


def test_few_boxes_match_as_many_do(monkeypatch):
    for seed in range(5):
        draw = random.Random(seed)
        p, r = (random_elements(draw, 120, ["a", "b"], 30 + 300 * (seed % 2)) for _ in range(2))
        few = kernels.greedy(p, r)
        monkeypatch.setattr(kernels, "AT_ONCE", 0)
        assert kernels.greedy(p, r) == few
        monkeypatch.undo()


def plain_names(refs, candidates, threshold, similarity):
    free, out = list(range(len(candidates))), []
    for name in refs:
        best = max(free, key=lambda i: (similarity(name, candidates[i]), -i), default=None)
        s = similarity(name, candidates[best]) if best is not None else 0.0
        out.append((name, None if best is None else candidates[best], round(s, 6), best is not None and s >= threshold))
        if out[-1][3]:
            free.remove(best)
    return out


def test_similarity_query_is_the_plain_fold(spark, sf):
    from test_units import plain_similarity

    from tessera.plans.texts import similarity_match

    parts = defaultdict(list)
    for r in V.table(spark, sf, "part").orderBy("p_partkey").collect():
        parts[r.p_partkey // 40].append((r.p_name, r.p_type))
    got = defaultdict(list)
    for r in similarity_match(spark, sf).orderBy("sample", "nth").collect():
        got[r.sample].append((r.ref, r.best, r.similarity, r.matched))
    want = {k: plain_names([n for n, _ in x], [t for _, t in x], 0.4, plain_similarity) for k, x in parts.items()}
    assert dict(got) == want and any(m for x in want.values() for *_, m in x)


def test_ten_thousand_names_a_side():
    draw = random.Random(11)
    word = lambda: "".join(draw.choices("abcdefgh", k=draw.randrange(2, 6)))
    names = [[" ".join(word() for _ in range(3)) for _ in range(10_000)] for _ in range(2)]
    rows = list(kernels.by_similarity(*names, *names, 0.95))
    assert len(rows) == 10_000 and all(0 <= r["similarity"] <= 1 and r["best"] for r in rows)
    assert sum(r["matched"] for r in rows) < 10_000


# ---- rows of training


def test_isolation_error_has_counts_and_examples(spark):
    rows = lambda *r: spark.createDataFrame(r, "id string, image string")
    train, apart = rows(("1", "a"), ("2", "b")), rows(("3", "c"))
    align.require_isolated(train, apart, ["id", "image"])
    with pytest.raises(ValueError, match=r"(?s)id: 0 shared.*image: 1 shared.*image b: training row 2, validation row 9"):
        align.require_isolated(train, rows(("9", "b")), ["id", "image"])
    with pytest.raises(ValueError, match="1 repeats in training"):
        align.require_isolated(rows(("1", "a"), ("1", "b")), apart, ["id", "image"])
    with pytest.raises(ValueError, match="validation rows without a value: image 1"):
        align.require_isolated(train, rows(("3", " ")), ["id", "image"])
    many = spark.range(50).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("image"))
    assert align.overlap_examples(many, many, ["id", "image"]).groupBy("field").count().orderBy("field").collect()[0]["count"] == 10


def plain_prepared(r, shared, skip, align_):
    """Positions, token_k and weights of a row by lists."""
    if r["scores"] is None:
        return "absent", None, None, None
    scores, vocab, student = r["scores"], r["vocab_size"], r["student_vocab"]
    k = list(r["token_k"]) if r["token_k"] is not None else [len(p) for p in scores]
    copied = min(shared, vocab, student) if shared is not None and vocab is not None else 0
    if vocab == student:
        status = "same"
    elif copied > 0:
        status = "remapped"
        k = [min(a, sum(i < copied for i, _ in p)) for a, p in zip(k, scores)]
        scores = [[(min(i, copied - 1), v if i < copied else -1e4) for i, v in p] for p in scores]
    else:
        return "skipped", None, None, None
    width = max((len(p) for p in scores), default=0)
    prompt = 0 if r["prompt_len"] is not None and r["prompt_len"] >= len(scores) else r["prompt_len"]
    start, first = (prompt, r["student_prompt_len"]) if align_ and prompt is not None and r["student_prompt_len"] is not None else (0, 0)
    out = lambda xs, pad: [xs[i - first + start] if first <= i and i - first + start < len(xs) else pad for i in range(r["length"])]
    return status, out(scores, [(0, -1e4)] * width), out(k, 0), out(r["token_weight"], 0.0) if r["token_weight"] is not None else None


@pytest.mark.parametrize("shared, align_", [(6, True), (None, True), (6, False), (0, True)])
def test_references_are_prepared_as_by_lists(spark, shared, align_):
    draw = random.Random(12)
    rows = []
    for i in range(120):
        n, k = draw.randrange(1, 6), draw.randrange(1, 4)
        scores = [[(j, float(draw.randrange(50))) for j in draw.sample(range(10), k)] for _ in range(n)]
        rows.append({"id": i, "scores": draw.choice([scores, scores, scores, None]), "vocab_size": draw.choice([10, 10, 8, None]), "student_vocab": draw.choice([10, 7]), "length": draw.randrange(1, 8), "prompt_len": draw.choice([None, 0, 1, 2, 9]),
                     "student_prompt_len": draw.choice([None, 0, 1, 5, 9]), "token_k": draw.choice([None, [draw.randrange(4) for _ in range(n)]]), "token_weight": draw.choice([None, [draw.random() for _ in range(n)]])})
    kind = "id int, scores array<array<struct<idx:int,val:double>>>, vocab_size int, student_vocab int, length int, prompt_len int, student_prompt_len int, token_k array<int>, token_weight array<double>"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], kind)
    for r in references.prepared(df, shared, align=align_).collect():
        positions = None if r.positions is None else [[tuple(e) for e in p] for p in r.positions]
        assert (r.status, positions, r.token_k, r.weights) == plain_prepared(rows[r.id], shared, True, align_), rows[r.id]
    with pytest.raises(Exception, match="does not match the student"):
        references.prepared(df, None, skip=False).collect()


def test_online_targets(spark):
    df = spark.createDataFrame([("1", "parsing", [("a", [1, 2, 3, 4], True)], None, "x"), ("2", "vqa", None, " ", " y "), ("3", "vqa", None, "t", "y"), ("4", None, None, None, None)], f"id string, task string, elements {ELEMENTS}, teacher_answer string, answer string")
    got = [r.target for r in references.target_text(df, online=True).orderBy("id").collect()]
    assert got[1:] == ["y", "t", ""] and json.loads(got[0])["elements"][0]["text"] == "a"
    assert [r.target for r in references.target_text(df).orderBy("id").collect()][1:] == ["", "t", ""]
    with pytest.raises(Exception, match="no elements to train on: 9"):
        references.target_text(spark.createDataFrame([("9", "parsing", None, "t", "a")], df.schema), online=True).collect()


def test_lenient_elements():
    raw = json.dumps({"elements": [{"name": " n ", "bbox": ["1", 2.5, True, 4], "focused": "yes"}, {"text": "", "label": "l", "bbox": [9, 9, 1, 1]}, {"text": 5, "bbox": [1, 2, 3, 4]}, {"text": "t", "bbox": [1, 2]}, {"text": "t", "bbox": [1, None, 2, 3]}, 7]})
    p = J.lenient_payload(f"Here: {raw} .")
    assert p["elements"] == [{"text": "n", "bbox_norm": [1.0, 2.5, 1.0, 4.0], "focused": True}, {"text": "l", "bbox_norm": [9.0, 9.0, 1.0, 1.0], "focused": False}]
    assert p["skipped"] == ["element_3: missing text", "element_4: malformed bbox", "element_5: non-numeric bbox", "element_6: not an object"] and p["error"] is None
    assert [J.lenient_payload(x)["error"] for x in (None, "", "[1]", '{"a":1}')] == ["no JSON object"] * 3 + ["no elements list"]


def test_expected_value():
    v = M.expected_value('{"boxes":1} {"bbox":1,2,3,4,"predictions":[],"objects":1}')
    assert v == {"value": '{"bbox":[1,2,3,4],"objects":1,"predictions":[]}', "keys": ["objects", "predictions"], "repaired": True, "notes": ["both brackets: 1"], "error": None}
    assert M.expected_value(None)["error"] and M.expected_value('{"elements": [')["value"] is None


def test_metrics_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (1, None, 5.0), (2, 3.0, None), (None, 4.0, 0.0)], "g int, x double, w double")
    assert {r.g: r.loss for r in metrics.masked_loss(df, "x", "w", by="g").collect()} == {1: 2.0, 2: 0.0, None: 0.0}
    assert metrics.masked_loss(df.limit(0), "x", "w").first().loss == 0.0
    assert metrics.role_delta(df, "x", 1, 2, role="g").first().delta == -1.0 and metrics.role_delta(df, "x", 1, 7, role="g").first().delta is None
    assert {(r.g, r.tensors, r.missing) for r in metrics.gradient_norms(df, "g", "x").collect()} == {(1, 1, 1), (2, 1, 0), (None, 1, 0)}
    assert [tuple(r) for r in align.repeated(df, "g").collect()] == [(1, 2)]
    base = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), (None, 3, 3)], "id string, v int, _ord int")
    got = {r.id: (r.v, r.from_sample) for r in align.base_rows(spark.createDataFrame([("a",), ("b",), (None,)], "id string"), base).collect()}
    assert got == {"a": (2, False), "b": (None, True), None: (None, True)}
