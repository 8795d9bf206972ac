"""Queries of answer parsing, splitting, streaming and document reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import jsonparse as J
from tessera.functions import modelparse as M
from tessera.functions import text as T
from tessera.operators import align, collate, digest, metrics, split
from tessera.plans import views as V
from tessera.plans.catalogue import query
from tessera.scratch import scratch_path
from tessera.sources import io, jsonl, sidecars
from tessera.streaming import ledger, stopping, stream


def raw_answers(spark, sf_dir):
    """Serialised samples, damaged in turn: intact, fenced, typographic quotes, cut at 70 %, a pipe table, prose around."""
    s = V.pred(spark, sf_dir).select("id", F.col(align.ORD), J.serialized(F.col("elements")).alias("j"))
    how = F.col(align.ORD) % 6
    raw = (
        F.when(how == 1, F.concat(F.lit("```json\n"), "j", F.lit("\n```"))).when(how == 2, F.translate("j", '"', "“"))
        .when(how == 3, F.substring(F.col("j"), F.lit(1), (F.length("j") * 0.7).cast("int"))).when(how == 4, F.lit("a|button|1|2|3|4|true"))
        .when(how == 5, F.concat(F.lit("Here it is: "), "j", F.lit(" Done."))).otherwise(F.col("j"))
    )
    return s.select("id", how.alias("how"), raw.alias("raw"), "j")


@query("json_props", "F30 F31", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def json_props(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


def short_error(error):
    """A parse error without the positions that a failed ladder names."""
    return F.when(error.startswith("direct JSON parse"), "direct JSON parse").otherwise(error)


@query("parse_answer", "F30 F31 F32 F33 F34 F35 P10 P11 F53", f"WITH {V.answer_sql()} SELECT * FROM answers")
def parse_answer(spark, sf_dir):
    r = J.parse_answers(raw_answers(spark, sf_dir), "raw", "p")
    return r.select("id", F.col("how").cast("int").alias("how"), "p.parse_ok", "p.usable", "p.element_count", "p.salvaged", "p.salvage_reason", short_error(F.col("p.parse_error")).alias("parse_error"))


@query("answer_paths", "F30 F31 F32 F33", f"WITH {V.BASE_SQL} SELECT l_orderkey % 6 AS how, count(*) AS rows, CASE WHEN l_orderkey % 6 IN (0, 1, 5) THEN count(*) ELSE 0 END AS native FROM (SELECT DISTINCT l_orderkey FROM el_pred) GROUP BY 1")
def answer_paths(spark, sf_dir):
    """How many answers of each damage are parsed without a Python worker: the intact, fenced and embedded ones."""
    r = raw_answers(spark, sf_dir).select("how", J.native_answer(F.col("raw")).isNotNull().alias("native"))
    return r.groupBy("how").agg(F.count("*").alias("rows"), F.count_if("native").alias("native"))


@query("parse_histogram", "A10", f"WITH {V.answer_sql()} SELECT CAST(how AS VARCHAR) AS role, coalesce(regexp_replace(parse_error, '[0-9]+', 'N', 'g'), 'none') AS parse_error, count(*) AS rows, CAST(sum(element_count) AS BIGINT) AS elements FROM answers GROUP BY 1, 2")
def parse_histogram(spark, sf_dir):
    r = J.parse_answers(raw_answers(spark, sf_dir), "raw", "p")
    error = F.regexp_replace(short_error(F.col("p.parse_error")), r"\d+", "N")
    return metrics.parse_histogram(r.select(F.col("how").cast("string").alias("role"), error.alias("parse_error"), F.col("p.element_count").alias("element_count")))


@query("serialize_label", "F36", f"""WITH {V.BASE_SQL} SELECT sample_id AS id, '{{"coordinate_system":"normalized_0_1000","elements":[' ||
  string_agg('{{"bbox_norm":[' || bx1 || ',' || by1 || ',' || bx2 || ',' || by2 || '],"focused":' || focused || ',"text":"' || text || '"}}', ',' ORDER BY idx) || ']}}' AS label FROM el_pred GROUP BY 1""")
def serialize_label(spark, sf_dir):
    return V.pred(spark, sf_dir).select("id", J.serialized(F.col("elements")).alias("label"))


@query("lenient_answers", "P11", f"""WITH {V.BASE_SQL}, n AS (SELECT sample_id AS id, l_orderkey % 6 AS how, count(*) AS n, sum(bx1) AS x FROM el_pred GROUP BY 1, 2)
SELECT id, CASE WHEN how IN (0, 1, 5) THEN n ELSE 0 END AS elements, CASE WHEN how IN (0, 1, 5) THEN CAST(x AS DOUBLE) END AS x1_sum, CASE WHEN how IN (0, 1, 5) THEN 2 ELSE 0 END AS skipped, CASE WHEN how NOT IN (0, 1, 5) THEN 'no JSON object' END AS error FROM n""")
def lenient_answers(spark, sf_dir):
    """Answers with other field names, and two elements more that lack something: strict parsing keeps none of them."""
    raw = F.replace(F.replace(F.col("raw"), F.lit('"bbox_norm"'), F.lit('"bbox"')), F.lit('"text"'), F.lit('"name"'))
    raw = F.replace(raw, F.lit("}]}"), F.lit('},{"name":" ","bbox":[1,2,3,4]},{"label":"x","bbox":[1,"z",3,4]}]}'))
    r = J.lenient_elements(raw_answers(spark, sf_dir).withColumn("raw", raw), "raw", "p")
    total = F.aggregate("p.elements", F.lit(0.0), lambda a, e: a + e["bbox_norm"][0])
    return r.select("id", F.size("p.elements").cast("long").alias("elements"), F.when(F.size("p.elements") > 0, total).alias("x1_sum"), F.size("p.skipped").alias("skipped"), "p.error")


@query("expected_json", "F41 F40", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"elements":[' || event_id || ']}' WHEN 1 THEN '{"detections":[{"bbox":[1,2,3,' || event_id || '],"t":1}]}' WHEN 2 THEN '{"objects":[{"box":[1,2,3,4]},{"box":[5,6,7,' || event_id || '],"t":1}]}' END AS value,
  CASE event_id % 5 WHEN 1 THEN 'both brackets: 1' WHEN 2 THEN 'opening bracket: 1,closing bracket: 1' ELSE '' END AS notes, event_id % 5 = 3 AS truncated FROM events""")
def expected_json(spark, sf_dir):
    """Values in prose: a bare list behind an object of other keys, boxes without brackets, a value that is cut, and none."""
    n, how = F.col("event_id").cast("string"), F.col("event_id") % 5
    raw = (
        F.when(how == 0, F.concat(F.lit('So {"note":1} or ['), n, F.lit("] it is"))).when(how == 1, F.concat(F.lit('{"detections":[{"bbox":1,2,3,'), n, F.lit(',"t":1}]} done')))
        .when(how == 2, F.concat(F.lit('{"objects":[{"box":1,2,3,4]},{"box":[5,6,7,'), n, F.lit(',"t":1}]}'))).when(how == 3, F.concat(F.lit('{"elements":[{"t":'), n)).otherwise(F.concat(F.lit('{"other":'), n, F.lit("}")))
    )
    r = M.expected_values(V.table(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "raw", "p")
    return r.select("event_id", "p.value", F.array_join("p.notes", ",").alias("notes"), F.contains(F.coalesce("p.error", F.lit("")), F.lit("truncated")).alias("truncated"))


@query("repair_bbox", "F40", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"bbox":[1,2,3,4],"t":' ELSE '{"bbox":[1,2,3,' || event_id || CASE WHEN event_id % 4 = 1 THEN '],"t":' WHEN event_id % 4 = 2 THEN ' ],"t":' ELSE '],"t":' END END || event_id || '}' AS fixed,
  CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END AS repairs FROM events""")
def repair_bbox(spark, sf_dir):
    e, n = V.table(spark, sf_dir, "events"), F.col("event_id").cast("string")
    how = F.col("event_id") % 4
    raw = F.when(how == 0, F.lit('{"bbox":[1,2,3,4],"t":')).when(how == 1, F.concat(F.lit('{"bbox":1,2,3,'), n, F.lit(',"t":'))).when(how == 2, F.concat(F.lit('{"bbox":1,2,3,'), n, F.lit(' ],"t":'))).otherwise(F.concat(F.lit('{"bbox":[1,2,3,'), n, F.lit(',"t":')))
    raw = F.concat(raw, n, F.lit("}"))
    return e.select("event_id", J.repair_boxes(raw).alias("fixed"), J.repair_notes(raw).alias("repairs"))


@query("pipe_table", "F19", f"""WITH {V.BASE_SQL} SELECT sample_id AS id, count(*) FILTER (WHERE ok AND idx % 5 <> 4 AND trim(text) <> '') AS elements, CAST(coalesce(sum(bx1) FILTER (WHERE ok AND idx % 5 <> 4), 0) AS BIGINT) AS x1_sum,
  count(*) FILTER (WHERE ok AND idx % 5 <> 4 AND focused) AS focused FROM p GROUP BY 1""")
def pipe_table(spark, sf_dir):
    kind = lambda i: F.when(i % 5 == 4, "banner").otherwise("button")
    line = lambda e, i: F.concat_ws("|", e["text"], kind(i), F.array_join(e["bbox_norm"].cast("array<string>"), "|"), F.when(e["focused"], "Yes").otherwise("no"))
    rows = V.el_pred(spark, sf_dir).groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("idx", "text", "bbox_norm", "focused"))).alias("es"))
    text = F.concat(F.lit("Elements:\nBEGIN_ELEMENTS\ntext|type|x1|y1|x2|y2|focused\n"), F.array_join(F.transform("es", lambda e: line(e, e["idx"])), "\n"), F.lit("\nEND_ELEMENTS\n"))
    t = rows.select(F.col("sample_id").alias("id"), J.pipe_table(text).alias("t"))
    return t.select("id", F.size("t").cast("long").alias("elements"), F.aggregate("t", F.lit(0).cast("long"), lambda a, e: a + e["bbox_norm"][0]).alias("x1_sum"), F.size(F.filter("t", lambda e: e["focused"])).cast("long").alias("focused"))


@query("object_lines", "F17 F18 U6", """WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '^\\s*(?:[-*•]+|\\d+[.)]|[A-Za-z][.)])\\s*', '')) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
k AS (SELECT doc_id, lower(x) AS k, min(i) AS i FROM l WHERE x <> '' AND NOT regexp_matches(lower(x), '^(here are|objects:|object names:|visible objects:|visible ui elements:|ui elements:|elements:|output:|answer:|explanation:|note:|json|\\{|\\[|```)')
  AND NOT contains(x, '|') AND len(regexp_split_to_array(x, '\\s+')) <= 12 GROUP BY 1, 2)
SELECT d.doc_id, count(k.k) AS names FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY 1""")
def object_lines(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", F.size(T.object_lines(F.col("text"))).cast("long").alias("names"))


@query("draw_label", "F24", f"""WITH {V.BASE_SQL} SELECT sample_id, idx, '#' || idx || ' | ' || text || ' | ' || 'card' || CASE WHEN focused THEN ' | FOCUSED' ELSE '' END AS label FROM el_ref""")
def draw_label(spark, sf_dir):
    return V.el_ref(spark, sf_dir).select("sample_id", F.col("idx").cast("long").alias("idx"), T.draw_label(F.col("idx"), F.col("text"), F.lit("card"), F.col("focused")).alias("label"))


@query("profile_log", "S17 F45", "SELECT event_id, CAST(event_id % 8 AS INTEGER) AS gpu, floor(value * 100) / 100 AS used FROM events WHERE event_id % 3 <> 0")
def profile_log(spark, sf_dir):
    line = F.concat_ws(", ", (F.col("event_id") % 8).cast("string"), (F.floor(F.col("value") * 100) / 100).cast("string"), F.when(F.col("event_id") % 3 != 0, "16380"))
    g = V.table(spark, sf_dir, "events").select("event_id", F.explode(io.gpu_rows(line)).alias("g"))
    return g.select("event_id", F.col("g.index").alias("gpu"), F.col("g.used").alias("used"))


REPORT_SQL = "count(*) AS total_files, count(*) FILTER (WHERE parse_ok) AS parse_ok, count(*) FILTER (WHERE NOT parse_ok) AS parse_failed, CAST(coalesce(sum(element_count) FILTER (WHERE parse_ok), 0) AS BIGINT) AS total_elements"


def sidecar_store(spark, sf_dir):
    """Documents of all answers; then a run whose manifest lacks each fourth sample and which repairs each other fourth one."""
    store = sidecars.Sidecars(spark, scratch_path(spark, "sidecars"))
    raw = raw_answers(spark, sf_dir).withColumn("of", F.substring_index("id", "-", -1).cast("long") % 4)

    def documents(rows, text):
        r = J.parse_answers(rows.withColumn("raw_model_output", text), "raw_model_output", "p")
        return r.select(F.lit("teacher").alias("role"), "id", "raw_model_output", "p.parse_ok", "p.parse_error", "p.element_count")

    store.write(documents(raw, F.col("raw")))
    store.write(documents(raw.filter("of = 1"), F.col("j")), manifest=raw.filter("of <> 0").select("id"))
    return store


SIDECAR_SQL = V.answer_sql("CASE WHEN l_orderkey % 4 = 1 THEN 0 ELSE l_orderkey % 6 END", "l_orderkey % 4 <> 0")


@query("sidecar_report", "A9 S6 S7", f"WITH {SIDECAR_SQL} SELECT 'teacher' AS role, {REPORT_SQL} FROM answers")
def sidecar_report(spark, sf_dir):
    return sidecar_store(spark, sf_dir).report()


@query("sidecar_failures", "A9 S6 S7 F13", f"""WITH {SIDECAR_SQL} SELECT 'teacher' AS role, id, parse_error, how = 4 AS table_like FROM answers WHERE NOT parse_ok""")
def sidecar_failures(spark, sf_dir):
    f = sidecar_store(spark, sf_dir).failures()
    return f.select("role", "id", short_error(F.col("parse_error")).alias("parse_error"), (F.col("preview") == "a|button|1|2|3|4|true").alias("table_like"))


@query("nested_shape", "F44 F48", """SELECT vec_id, CASE WHEN vec_id % 5 <> 0 THEN '1,' || (vec_id % 8 + 1) || ',8' WHEN vec_id % 8 = 0 THEN '1,1,7' END AS shape FROM embeddings""")
def nested_shape(spark, sf_dir):
    """One to eight rows of eight scores; the last row of each fifth vector has seven, so more than one row is ragged."""
    last = F.col("vec_id") % 8
    rows = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.slice("embedding", (i * 8 + 1).cast("int"), F.when((i == last) & (F.col("vec_id") % 5 == 0), 7).otherwise(8)))
    return V.table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(J.nested_shape(F.array(rows), 3), ",").alias("shape"))


@query("seeded_split", "V7 F58 P8", None)
def seeded_split(spark, sf_dir):
    t, v = split.seeded_split(V.pred(spark, sf_dir), 0.1, 42)
    return t.select("id", F.lit("train").alias("part")).unionByName(v.select("id", F.lit("validation").alias("part")))


KEYED_SQL = f"""{V.BASE_SQL}, ids AS (SELECT sample_id AS id, CAST('0x' || substr(md5('42:' || sample_id), 1, 15) AS BIGINT) AS h FROM el_pred GROUP BY 1),
parts AS (SELECT id, row_number() OVER (ORDER BY h, id) <= greatest(1, round_even((SELECT count(*) FROM ids) * 0.1, 0)) AS is_validation FROM ids)"""


@query("exact_split", "V7 F58 P8", f"WITH {KEYED_SQL} SELECT id, is_validation FROM parts")
def exact_split(spark, sf_dir):
    return split.exact_split(V.pred(spark, sf_dir).withColumn("source_image", F.lit("x")), 0.1, 42).select("id", "is_validation")


def tree_sql(source: str, depth: int) -> str:
    """Levels of the digest tree of ``source`` (part, id)."""
    levels = [f"l{depth} AS (SELECT part, substr(md5(id), 1, {depth}) AS node, count(*) AS rows, sha256(string_agg(id, chr(10) ORDER BY md5(id), id)) AS digest FROM {source} GROUP BY 1, 2)"]
    for d in range(depth - 1, -1, -1):
        levels.append(f"l{d} AS (SELECT part, substr(node, 1, {d}) AS node, CAST(sum(rows) AS BIGINT) AS rows, sha256(string_agg(node || ' ' || digest, chr(10) ORDER BY node)) AS digest FROM l{d + 1} GROUP BY 1, 2)")
    return ", ".join(levels)


@query("hashed_split", "V7", f"WITH {KEYED_SQL} SELECT id, h < {int(0.1 * (1 << 60))} AS is_validation FROM ids")
def hashed_split(spark, sf_dir):
    return split.hashed_split(V.pred(spark, sf_dir), 0.1, 42).select("id", "is_validation")


@query("split_metadata", "V8 F56", f"""WITH {KEYED_SQL}, s AS (SELECT CASE WHEN is_validation THEN 'validation' ELSE 'train' END AS part, id FROM parts), {tree_sql('s', split.DEPTH)}, t AS (SELECT * FROM l0 WHERE part = 'train'), v AS (SELECT * FROM l0 WHERE part = 'validation')
SELECT '0.1' AS ratio, '42' AS seed, CAST(t.rows + v.rows AS VARCHAR) AS total_count, CAST(t.rows AS VARCHAR) AS training_count, CAST(v.rows AS VARCHAR) AS validation_count, t.digest AS training_ids_hash, v.digest AS validation_ids_hash FROM t, v""")
def split_metadata(spark, sf_dir):
    s = split.exact_split(V.pred(spark, sf_dir), 0.1, 42)
    m = split.metadata(s.filter("not is_validation"), s.filter("is_validation"), 0.1, 42)
    return spark.createDataFrame([tuple(str(x) for x in m.values())], ", ".join(f"{k} string" for k in m))


@query("split_digest", "V8 F56", f"WITH {KEYED_SQL}, s AS (SELECT CASE WHEN is_validation THEN 'validation' ELSE 'train' END AS part, id FROM parts), {tree_sql('s', 2)} "
       + " UNION ALL ".join(f"SELECT part, {d} AS level, node, rows, digest FROM l{d}" for d in range(3)))
def split_digest(spark, sf_dir):
    """Digest trees of the ids of either part; their roots are what the split's metadata holds."""
    s = split.exact_split(V.pred(spark, sf_dir), 0.1, 42)
    trees = [digest.tree(s.filter(c), depth=2).select(F.lit(part).alias("part"), "level", "node", "rows", "digest") for part, c in (("train", "not is_validation"), ("validation", "is_validation"))]
    return trees[0].unionByName(trees[1])


@query("split_reverified", "V8 F56", """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey = max(o_orderkey) OVER () AS gone FROM orders), g AS (SELECT md5(id) AS h FROM o WHERE gone), d AS (SELECT unnest([0, 1, 2]) AS level)
SELECT level, substr(h, 1, level) AS node, count(*) AS left_rows, count(*) - 1 AS right_rows FROM d, g, o WHERE substr(md5(id), 1, level) = substr(h, 1, level) GROUP BY 1, 2""")
def split_reverified(spark, sf_dir):
    """The path to the one order that a later set of ids lacks."""
    ids = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    last = ids.agg(F.max("id")).first()[0]
    path = digest.first_difference(digest.tree(ids, depth=2), digest.tree(ids.filter(F.col("id") != last), depth=2))
    return spark.createDataFrame([(p["level"], p["node"], p["left_rows"], p["right_rows"]) for p in path], "level int, node string, left_rows long, right_rows long")


@query("numbered_lines", "S1 S2", "SELECT CASE WHEN event_id % 7 <> 0 THEN event_id END AS event_id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS event_type, CASE WHEN event_id % 7 = 0 THEN '{\"event_id\": ' || event_id || ', broken' END AS bad FROM events")
def numbered_lines(spark, sf_dir):
    """Events as JSON Lines with blank lines among them, each seventh damaged, read again."""
    path = scratch_path(spark, "lines")
    e = V.table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(", broken"))).otherwise(F.to_json(F.struct("event_id", "event_type")))
    e.select(F.concat(line, F.when(F.col("event_id") % 5 == 0, "\n \n").otherwise("")).alias("value")).write.text(path)
    r = jsonl.read_jsonl(spark, path, "event_id long, event_type string", strict=False)
    return r.select("event_id", "event_type", F.col("_bad").alias("bad"))


@query("collated_batches", "L15 L16 A21", """WITH d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) AS n FROM documents), c AS (SELECT *, greatest(1, CAST(ceil(n / 64.0) AS BIGINT)) AS class FROM d),
b AS (SELECT *, (row_number() OVER (PARTITION BY class ORDER BY doc_id) - 1) // greatest(1, 4096 // (class * 64)) AS batch FROM c)
SELECT class, batch, count(*) AS rows, max(n) AS longest, CAST(sum(n) AS BIGINT) AS real_tokens, count(*) * max(n) AS places, CAST(sum(greatest(n - 8, 0)) AS BIGINT) AS trained FROM b GROUP BY 1, 2""")
def collated_batches(spark, sf_dir):
    """Documents as sequences of hashed words, the first eight of each a prompt, in batches of at most 4096 places."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^ \t\n\r]+"), F.lit(0))
    rows = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.transform(words, lambda w: (F.crc32(w.cast("binary")) % 50_000).cast("int")).alias("input_ids"), F.lit(8).alias("prompt_token_len"))
    b = collate.collated(rows, 4096)
    places = F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, r: a + F.size(r))
    trained = F.aggregate("labels", F.lit(0).cast("long"), lambda a, r: a + F.size(F.filter(r, lambda x: x != collate.IGNORED)))
    return b.select("class", "batch", F.size("ids").alias("rows"), "longest", "real_tokens", places.alias("places"), trained.alias("trained"))


def _streamed(spark, sf_dir, build, mode, each=None):
    """Runs a stream over the events, which arrive in three batches in order of time, and reads its result; with ``each``
    every batch and its number go there instead."""
    root = scratch_path(spark, "stream")
    e = V.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    (low, high), rows = e.agg(F.percentile_approx(F.unix_micros("ts"), [0.33, 0.67]), F.count("*")).first()
    files = rows // 3_000_000 + 1  # of about a million rows each
    at = F.unix_micros("ts")
    for part in (at < low, (at >= low) & (at < high), at >= high):
        e.filter(part).repartition(files).write.mode("append").parquet(f"{root}/in")
    rows = build(stream.file_stream(spark, f"{root}/in", e.schema, files))
    return stream.run_each(rows, f"{root}/state", each) if each else stream.run_once(rows, f"{root}/out", f"{root}/state", mode)


@query("resume_stream", "T1 T2 S4", "SELECT user_id, count(*) AS ids FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def resume_stream(spark, sf_dir):
    build = lambda s: stream.resumed(s.select(F.concat_ws("/", "user_id", "event_type").alias("id"), "user_id"))
    return _streamed(spark, sf_dir, build, "append").groupBy("user_id").agg(F.count("*").alias("ids"))


@query("resume_ledger", "T1 S4", "SELECT user_id, count(*) AS ids FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def resume_ledger(spark, sf_dir):
    """The same through a ledger of ids: bounded reads a batch, and nothing twice when a batch is replayed."""
    done = ledger.Ledger(spark, scratch_path(spark, "ledger"))

    def build(s):
        return s.select(F.concat_ws("/", "user_id", "event_type").alias("id"), "user_id")

    _streamed(spark, sf_dir, build, "append", each=done.append)
    return done.rows().groupBy("user_id").agg(F.count("*").alias("ids"))


@query("windowed_stream", "T2", """SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS rows, round(sum(value), 6) AS total FROM events GROUP BY 1, 2
HAVING date_trunc('day', min(ts)) + INTERVAL 2 DAY <= (SELECT max(ts) FROM events)""")
def windowed_stream(spark, sf_dir):
    """Windows that the watermark has closed, a day behind the latest event."""
    out = _streamed(spark, sf_dir, lambda s: stream.windowed_counts(s, "ts", "event_type"), "append")
    return out.select("event_type", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "rows", F.round("total", 6).alias("total"))


@query("early_stop_stream", "T3 W5", """WITH RECURSIVE x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT event_type, CAST(1 AS BIGINT) AS n, value AS best, 0 AS bad, CAST(NULL AS BIGINT) AS stopped_at FROM x WHERE n = 1
  UNION ALL SELECT f.event_type, x.n, CASE WHEN x.value < f.best - 0.01 THEN x.value ELSE f.best END, CASE WHEN x.value < f.best - 0.01 THEN 0 ELSE f.bad + 1 END,
  CASE WHEN x.value >= f.best - 0.01 AND f.bad + 1 >= 40 THEN x.n END FROM f JOIN x ON x.event_type = f.event_type AND x.n = f.n + 1 WHERE f.stopped_at IS NULL)
SELECT event_type AS key, round(arg_max(best, n), 6) AS best, CAST(max(n) AS INTEGER) AS steps, max(stopped_at) AS stopped_at FROM f GROUP BY 1""")
def early_stop_stream(spark, sf_dir):
    stopper = stopping.Stopper(spark, scratch_path(spark, "stopping"), "event_type", ["ts", "event_id"], "value", 40, 0.01)
    _streamed(spark, sf_dir, lambda s: s, "append", each=stopper.append)
    return stopper.states().select("key", F.round("best", 6).alias("best"), F.col("steps").cast("int").alias("steps"), "stopped_at")
