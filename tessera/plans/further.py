"""Queries of the parsers' fallbacks, per-role statistics, row contracts, inventories and small steps of training data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import jsonparse as J
from tessera.functions import logits as L
from tessera.functions import modelparse as M
from tessera.functions import text as T
from tessera.operators import align, metrics, validate
from tessera.plans import pipeline as P
from tessera.plans import views as V
from tessera.plans.catalogue import query
from tessera.schemas import LABEL_KEYS

R = 6


def model_outputs(spark, sf_dir):
    """Raw outputs named after parts, by p_partkey % 6: compact, compact without its last brace, objects, no JSON, fenced, none."""
    n = V.table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat(F.lit("r"), (F.col("p_size") % 3).cast("string")).alias("role"))
    k = F.col("p_partkey") % 6
    e = F.concat(F.lit('["'), "p_name", F.lit('",1,2,30,40]'))
    raw = (F.when(k == 0, F.concat(F.lit('{"e":['), e, F.lit("]}"))).when(k == 1, F.concat(F.lit('{"e":['), e, F.lit("]"))).when(k == 2, F.concat(F.lit('[{"name":"'), "p_name", F.lit('","bbox":"9,8,3,4"}]')))
           .when(k == 3, F.lit("no json")).when(k == 4, F.concat(F.lit('```json\n{"elements":[{"name":"'), "p_name", F.lit('","confidence":0.5}]}\n```'))))
    return n.withColumn("raw", raw)


OUTPUT_SQL = """o AS (SELECT p_partkey, p_name, 'r' || (p_size % 3) AS role, p_partkey % 6 AS k FROM part)"""


@query("parse_model_output", "F38 F39", f"""WITH {OUTPUT_SQL} SELECT p_partkey, CASE WHEN k IN (3, 5) THEN NULL ELSE trim(p_name) END AS name, CASE k WHEN 3 THEN 'could_not_find_json_payload' WHEN 5 THEN 'empty_output' END AS parse_error,
  CASE WHEN k = 1 THEN 'appended_missing_top_level_closing_brace' END AS parse_repair, CASE k WHEN 0 THEN '1,2,30,40' WHEN 1 THEN '1,2,30,40' WHEN 2 THEN '3,4,9,8' END AS box FROM o""")
def parse_model_output(spark, sf_dir):
    p = M.parse_outputs(model_outputs(spark, sf_dir), "raw")
    first = F.get("parsed.elements", F.lit(0))
    return p.select("p_partkey", first["name"].alias("name"), "parsed.parse_error", "parsed.parse_repair", F.array_join(first["bbox"].cast("array<int>"), ",").alias("box"))


@query("role_parse_stats", "A10 A11 A12", f"""WITH {OUTPUT_SQL}, s AS (SELECT role, count(*) AS n, count(*) FILTER (WHERE k = 3) AS e3, count(*) FILTER (WHERE k = 5) AS e5, count(*) FILTER (WHERE k = 1) AS fixed,
  count(*) FILTER (WHERE k NOT IN (3, 5)) AS found, count(*) FILTER (WHERE k < 3) AS boxed FROM o GROUP BY 1)
SELECT role, n AS num_rows, e3 + e5 AS num_parse_errors, round((e3 + e5) / CAST(n AS DOUBLE), 6) AS parse_error_rate, found AS total_parsed_elements, round(found / CAST(n AS DOUBLE), 6) AS mean_parsed_elements_per_row,
  concat_ws(',', CASE WHEN e3 > 0 THEN 'could_not_find_json_payload=' || e3 END, CASE WHEN e5 > 0 THEN 'empty_output=' || e5 END) AS parse_errors, fixed AS num_repaired_rows, round(fixed / CAST(n AS DOUBLE), 6) AS repair_rate,
  CASE WHEN fixed > 0 THEN 'appended_missing_top_level_closing_brace=' || fixed ELSE '' END AS repairs, boxed AS elements_with_valid_bbox, found - boxed AS elements_with_missing_or_invalid_bbox,
  CASE WHEN found > 0 THEN round(boxed / CAST(found AS DOUBLE), 6) ELSE 0.0 END AS valid_bbox_rate FROM s""")
def role_parse_stats(spark, sf_dir):
    s = metrics.parse_statistics(M.parse_outputs(model_outputs(spark, sf_dir), "raw"))
    said = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return s.select(
        "role", "num_rows", "num_parse_errors", F.round("parse_error_rate", R).alias("parse_error_rate"), "total_parsed_elements", F.round("mean_parsed_elements_per_row", R).alias("mean_parsed_elements_per_row"),
        said("parse_error_counts").alias("parse_errors"), "num_repaired_rows", F.round("repair_rate", R).alias("repair_rate"), said("repair_counts").alias("repairs"),
        "elements_with_valid_bbox", "elements_with_missing_or_invalid_bbox", F.round("valid_bbox_rate", R).alias("valid_bbox_rate"),
    )


@query("outcome_tally", "A29", f"WITH {OUTPUT_SQL} SELECT count(*) FILTER (WHERE k IN (0, 2, 4)) AS success, count(*) FILTER (WHERE k = 1) AS recovered, count(*) FILTER (WHERE k = 3) AS parse_failed, count(*) FILTER (WHERE k = 5) AS runtime_failed FROM o")
def outcome_tally(spark, sf_dir):
    return metrics.outcome_tally(M.parse_outputs(model_outputs(spark, sf_dir), "raw"))


@query("lenient_labels", "F42", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || '|' || p_type WHEN 1 THEN p_name WHEN 2 THEN p_type WHEN 3 THEN '' ELSE p_name END AS labels FROM part""")
def lenient_labels(spark, sf_dir):
    k = F.col("p_partkey") % 5
    made = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    n, t = F.col("p_name"), F.col("p_type")
    raw = (
        F.when(k == 0, made('{"elements":[{"label":"', n, '"},{"label":"","text":" ', t, ' "},{"name":"', F.upper(n), '"},{"title":null},7]}'))
        .when(k == 1, made('Sure: {"selectable_elements":["', n, ' "," "]} done')).when(k == 2, made('{"elements":[{"label":"","name":"","title":"', t, '"}],"selectable_elements":["x"]}'))
        .when(k == 3, made('["', n, '"]')).otherwise(made('x {"elements":[{"text":"', n, '"}]} y'))
    )
    out = J.ordered_lenient_labels(V.table(spark, sf_dir, "part").withColumn("raw", raw), "raw")
    return out.select("p_partkey", F.array_join("labels", "|").alias("labels"))


@query("prediction_elements", "F43", f"""WITH {V.BASE_SQL}, s AS (SELECT sample_id, l_orderkey % 5 AS k, count(*) AS n, count(*) FILTER (WHERE ok) AS good FROM p GROUP BY 1, 2)
SELECT sample_id AS id, CASE WHEN k = 0 THEN n WHEN k < 4 THEN good ELSE -1 END AS elements, CASE WHEN k < 4 THEN 'normalized_0_1000' END AS coordinate_system FROM s""")
def prediction_elements(spark, sf_dir):
    """Elements as an array, as text in one of three other columns behind an earlier null one, or nowhere."""
    k = F.col(align.ORD) % 5
    rows = V.pred(spark, sf_dir)
    text = J.serialized(F.col("elements"))
    rows = rows.withColumns({"prediction": F.when(k == 1, text), "student_answer": F.when(k == 2, text), "raw_output": F.when(k.isin(2, 3), F.when(k == 3, text).otherwise("not this one"))})
    rows = rows.withColumn("elements", F.when(k == 0, F.col("elements")))
    p = J.predicted(rows)
    return p.select("id", F.coalesce(F.size("predicted.elements"), F.lit(-1)).cast("long").alias("elements"), "predicted.coordinate_system")


@query("manifest_projection", "P2", """SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'task must be parsing' WHEN p_partkey % 7 = 0 THEN 'image not found' END AS reason,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'brand=' || p_brand || ',' END || CASE WHEN p_partkey % 2 = 0 THEN 'brand_is=old,' ELSE '' END || 'size=' || p_size AS metadata FROM part""")
def manifest_projection(spark, sf_dir):
    """Columns besides the known ones become metadata, over entries of the same name; each seventh image has no file."""
    p, k = V.table(spark, sf_dir, "part"), F.col("p_partkey")
    image = F.concat(F.lit("img/"), k.cast("string"), F.lit(".png"))
    rows = p.select(
        k.cast("string").alias("id"), image.alias("image"), F.when(k % 5 == 0, "vqa").otherwise("parsing").alias("task"),
        F.when(k % 2 == 0, F.create_map(F.lit("size"), F.lit("0"), F.lit("brand_is"), F.lit("old"))).alias("metadata"), F.when(k % 3 != 0, F.col("p_brand")).alias("brand"), F.col("p_size").alias("size"),
    )
    files = p.filter(k % 7 != 0).select(image.alias("path"))
    out = P.projected(rows, files)
    said = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.select(F.col("id").cast("long").alias("id"), "reason", said.alias("metadata"))


@query("strict_keys", "P15", """SELECT CASE p_partkey % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'keys are missing' WHEN 2 THEN 'keys are not expected' ELSE 'row is not a JSON object' END AS reason, count(*) AS rows FROM part GROUP BY 1""")
def strict_keys(spark, sf_dir):
    k, one = F.col("p_partkey") % 4, F.col("p_name")
    row = lambda keys: F.to_json(F.struct(*[one.alias(x) for x in keys]))
    raw = F.when(k == 0, row(reversed(LABEL_KEYS))).when(k == 1, row(LABEL_KEYS[1:])).when(k == 2, row((*LABEL_KEYS, "other"))).otherwise(one)
    return metrics.validation_summary(V.table(spark, sf_dir, "part"), validate.key_reason(raw, LABEL_KEYS))


@query("reuse_status", "P14", f"""WITH {V.BASE_SQL}, r0 AS (SELECT DISTINCT l_orderkey AS o FROM el_ref WHERE l_orderkey % 13 <> 0)
SELECT o_orderkey AS id, CASE WHEN o IS NULL THEN 'missing' WHEN o % 11 = 0 THEN 'duplicate' WHEN o % 7 = 0 THEN 'image differs' WHEN o % 5 = 0 THEN 'no elements' ELSE 'reused' END AS status FROM orders LEFT JOIN r0 ON o = o_orderkey""")
def reuse_status(spark, sf_dir):
    """What each asked order could take over from the rows of the teacher; those of another role do not count."""
    o = F.col(align.ORD)
    rows = V.ref(spark, sf_dir).withColumn("model_role", F.when(o % 13 == 0, "student").otherwise("teacher"))
    rows = rows.withColumn("elements", F.when(o % 5 == 0, F.filter("elements", lambda e: F.lit(False))).otherwise(F.col("elements")))
    rows = rows.unionByName(rows.filter(o % 11 == 0))
    sample = F.concat(F.lit("parsing-"), F.col("o_orderkey").cast("string"))
    image = F.concat(F.when(F.col("o_orderkey") % 7 == 0, "old/").otherwise("img/"), sample, F.lit(".png"))
    asked = V.table(spark, sf_dir, "orders").select(sample.alias("id"), image.alias("image"))
    return align.reused(asked, rows, "teacher").select(F.substring_index("id", "-", -1).cast("long").alias("id"), "status")


@query("self_evaluation", "A4", "SELECT count(*) AS rows, avg(CASE WHEN text IS NULL THEN 1.0 ELSE 1.0 END) AS exact_match, avg(1.0) AS token_f1 FROM conversations WHERE role <> 'system'")
def self_evaluation(spark, sf_dir):
    rows = V.table(spark, sf_dir, "conversations").filter("role <> 'system'").withColumn("task", F.lit("vqa"))
    return metrics.legacy_evaluation(rows)


@query("adapter_inventory", "A24", """WITH n AS (SELECT p_partkey % 6 AS k, p_size AS layer, CASE WHEN p_partkey % 2 = 0 THEN 'float16' ELSE 'float32' END AS dtype FROM part),
x AS (SELECT CASE WHEN k IN (0, 1) THEN 'attention' WHEN k = 2 THEN 'mlp' WHEN k = 3 THEN 'projector' ELSE 'unmatched' END AS kind, k, layer, dtype FROM n WHERE k < 5),
m AS (SELECT kind, layer, count(DISTINCT k) AS parts FROM x WHERE k < 3 GROUP BY 1, 2)
SELECT kind, count(*) AS tensors, coalesce(any_value(c.modules), 0) AS modules, coalesce(any_value(c.incomplete), 0) AS incomplete_modules, string_agg(DISTINCT dtype, ',' ORDER BY dtype) AS dtypes
FROM x LEFT JOIN (SELECT kind, count(*) AS modules, count(*) FILTER (WHERE parts < 2) AS incomplete FROM m GROUP BY 1) c USING (kind) GROUP BY 1""")
def adapter_inventory(spark, sf_dir):
    """Parameter names by p_partkey % 6: either half of an attention adapter, half of an mlp one, a projector's, an odd one, none."""
    k, layer = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    at = lambda rest: F.concat(F.lit("base.model.language_model.layers."), layer, F.lit(rest))
    name = (
        F.when(k == 0, at(".self_attn.q_proj.lora_A.default.weight")).when(k == 1, at(".self_attn.q_proj.lora_B.weight")).when(k == 2, at(".mlp.up_proj.lora_a.weight"))
        .when(k == 3, F.lit("model.visual.merger.linear_fc1.lora_A.weight")).when(k == 4, at(".mlp.q_proj.lora_A.weight")).otherwise(at(".mlp.up_proj.weight"))
    )
    rows = V.table(spark, sf_dir, "part").select(name.alias("name"), F.when(F.col("p_partkey") % 2 == 0, "float16").otherwise("float32").alias("dtype"))
    out = metrics.adapter_inventory(rows)
    return out.withColumn("dtypes", F.array_join("dtypes", ","))


@query("precision_summary", "A26", """SELECT CASE p_partkey % 3 WHEN 0 THEN 'uint8' WHEN 1 THEN 'float16' ELSE 'float32' END AS dtype, count(*) AS tensors, CAST(sum(p_size) AS BIGINT) AS numel, count(*) FILTER (WHERE p_partkey % 3 = 0) AS quantised,
  count(*) FILTER (WHERE p_partkey % 3 = 0 AND p_partkey % 4 = 0) AS quantised_visual FROM part GROUP BY 1""")
def precision_summary(spark, sf_dir):
    k = F.col("p_partkey")
    rows = V.table(spark, sf_dir, "part").select(
        F.concat(F.when(k % 4 == 0, "visual.").otherwise("language."), "p_name").alias("name"), F.when(k % 3 == 0, "uint8").when(k % 3 == 1, "float16").otherwise("float32").alias("dtype"), F.col("p_size").alias("numel"))
    return metrics.precision_summary(rows)


@query("supervised_span", "W8", """WITH a AS (SELECT vec_id, list_filter(range(label, label + 5), lambda i: CAST(embedding[i + 1] AS DOUBLE) > -0.1) AS pos FROM embeddings)
SELECT vec_id, list_max(pos) - list_min(pos) + 1 = len(pos) AS contiguous FROM a""")
def supervised_span(spark, sf_dir):
    """Five places from the label on, without those of a low score; none left: null."""
    at = F.filter(F.sequence(F.col("label"), F.col("label") + 4), lambda i: F.get("embedding", i).cast("double") > -0.1)
    return V.table(spark, sf_dir, "embeddings").select("vec_id", L.contiguous(at).alias("contiguous"))


@query("mismatch_context", "W9", """WITH t AS (SELECT conv_id, turn, string_split(text, '') AS a, string_split(coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), '') AS b FROM conversations),
m AS (SELECT conv_id, turn, a, b, list_filter(range(0, least(len(a), len(b))), lambda i: a[i + 1] <> b[i + 1])[1] AS d FROM t WHERE len(b) > 1)
SELECT conv_id, turn, array_to_string(list_slice(a, greatest(d - 4, 1), d + 6), '') AS context FROM m WHERE d IS NOT NULL""")
def mismatch_context(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = V.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", "").alias("a"), F.split(F.coalesce(F.lead("text").over(w), F.lit("")), "").alias("b")).filter(F.size("b") > 1)
    t = t.withColumn("at", L.first_mismatch(F.col("a"), F.col("b"))).filter(F.col("at") < F.least(F.size("a"), F.size("b")))
    return t.select("conv_id", "turn", F.array_join(L.context_window(F.col("a"), F.col("at")), "").alias("context"))


#: Damages of a score row in order, with what the validator says of each.
DAMAGES = (
    "valid", "switch_logits is missing", "switch_logits is not aligned to the answer", "switch_logits tokens are not marked as identical", "switch_logits vocab_size is missing", "switch_logits vocab_size must be positive",
    "switch_logits answer tokens differ", "switch_logits shape must have three numbers", "switch_logits shape must be positive", "switch_logits length differs from the tokens", "switch_logits vocab_size differs",
    "switch_logits batch differs", "switch_logits positions differ from the tokens", "switch_logits top-k lengths differ", "switch_logits top-k is empty", "switch_logits index is out of range", "switch_logits entropy length differs",
    "target token ids are missing", "id is missing",
)


def score_rows(spark, sf_dir):
    """Rows of two answer tokens with four scores each, damaged in turn by vec_id."""
    k = F.col("vec_id") % len(DAMAGES)
    top = F.transform(L.top_k(F.col("embedding").cast("array<double>"), 4), lambda e: e["idx"])
    row = F.when(k == 15, F.transform(top, lambda i: i + 64)).when(k == 14, F.slice(top, 1, 0)).otherwise(top)
    values = F.transform(F.when(k == 13, F.slice(row, 1, 3)).otherwise(row), lambda i: i.cast("double"))
    seq = lambda x: F.when(k == 12, F.array(x)).otherwise(F.array(x, x))
    batch = lambda x: F.when(k == 11, F.array(x, x)).otherwise(F.array(x))
    ints = lambda *x: F.array(*[F.lit(i) for i in x])
    shape = F.when(k == 7, ints(1, 2)).when(k == 8, ints(1, 0, 4)).when(k == 9, ints(1, 3, 4)).otherwise(ints(1, 2, 4))
    entropy = F.when(k == 16, F.array(F.array(F.lit(0.5)))).when(k % 2 == 0, F.array(F.array(F.lit(0.5), F.lit(0.25))))
    payload = F.struct(
        shape.alias("shape"), batch(seq(row)).alias("indices"), batch(seq(values)).alias("values"), F.when(k == 10, 32).when(k % 2 == 0, 64).alias("vocab_size"),
        F.array(ints(4, 4)).alias("token_k"), entropy.alias("entropy"), F.lit(None).cast("array<array<double>>").alias("entropy_weight"),
    )
    tokens = F.when(k != 17, ints(5, 6))
    return V.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(k == 18, " ").otherwise(F.col("vec_id").cast("string")).alias("id"), tokens.alias("teacher_tokens"), F.when(k != 1, payload).alias("switch_logits"), (k != 2).alias("switch_logits_aligned_to_answer"),
        F.when(k != 3, True).alias("switch_logits_token_identity_match"), F.when(k == 5, 0).when(k != 4, 64).alias("switch_logits_vocab_size"), F.when(k == 6, ints(5, 7)).when(k != 17, ints(5, 6)).alias("switch_logits_answer_token_ids"),
    )


@query("score_validation", "V2", f"SELECT [{', '.join(repr(x) for x in DAMAGES)}][vec_id % {len(DAMAGES)} + 1] AS reason, count(*) AS rows FROM embeddings GROUP BY 1")
def score_validation(spark, sf_dir):
    return metrics.validation_summary(score_rows(spark, sf_dir), validate.switch_reason())


@query("pruned_scores", "V3", f"SELECT vec_id FROM embeddings WHERE vec_id % {len(DAMAGES)} = 0")
def pruned_scores(spark, sf_dir):
    return validate.pruned(score_rows(spark, sf_dir), validate.switch_reason()).select("vec_id")


@query("experiment_name", "F12", r"SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'experiment' ELSE regexp_replace(trim('  ' || p_name || chr(9) || ' ' || p_brand), '\s+', '_', 'g') END AS name FROM part")
def experiment_name(spark, sf_dir):
    text = F.when(F.col("p_partkey") % 9 == 0, "\t ").otherwise(F.concat(F.lit("  "), "p_name", F.lit("\t "), "p_brand"))
    return V.table(spark, sf_dir, "part").select("p_partkey", T.experiment_name(text).alias("name"))


@query("output_names", "F12", """WITH n AS (SELECT doc_id, 's' || (doc_id % 300) || '__' || lang || '_x__annotated' AS base, 'in/' || source || '/' || lang || ' x.png' AS src FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS i FROM n) SELECT doc_id, base || CASE WHEN i > 1 THEN '__' || substr(sha1(src), 1, 8) ELSE '' END || '.png' AS name FROM o""")
def output_names(spark, sf_dir):
    rows = V.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("s"), (F.col("doc_id") % 300).cast("string")).alias("id"), F.concat(F.lit("in/"), "source", F.lit("/"), "lang", F.lit(" x.png")).alias("source"), F.col("doc_id").alias(align.ORD))
    return align.output_names(rows).select("doc_id", "name")


@query("identity_path", "F11", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/data/' ELSE '/' END || 'a/' || page_id || '.png' AS path FROM pages")
def identity_path(spark, sf_dir):
    n = F.col("page_id").cast("string")
    raw = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("./a\\b//../"), n, F.lit(".png"))).otherwise(F.concat(F.lit("/../x/../a/./"), n, F.lit(".png ")))
    return V.table(spark, sf_dir, "pages").select("page_id", T.identity_path(raw, "/data").alias("path"))


@query("accumulation_scale", "F60", "SELECT event_id, round(CASE WHEN event_id <= 0 OR event_id % 7 = 0 THEN 1.0 ELSE 7.0 / (event_id % 7) END, 6) AS scale FROM events")
def accumulation_scale(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select("event_id", F.round(L.accumulation_scale(F.col("event_id"), 7), R).alias("scale"))


@query("spliced", "L17", "SELECT vec_id, CASE WHEN vec_id % 4 = 3 THEN '0,1,2,3,4,5' ELSE array_to_string(list_transform(list_concat(range(0, vec_id % 4), list_concat([-1, -2, -3], range(vec_id % 4 + 1, 6))), lambda x: CAST(x AS VARCHAR)), ',') END AS row FROM embeddings")
def spliced(spark, sf_dir):
    """Three rows of an image in place of the placeholder; each fourth row has none."""
    k = F.col("vec_id") % 4
    out = L.spliced(F.sequence(F.lit(0), F.lit(5)), F.when(k != 3, k.cast("int")), F.array(F.lit(-1), F.lit(-2), F.lit(-3)))
    return V.table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(out.cast("array<string>"), ",").alias("row"))


@query("rank_stripes", "T5 T6", "SELECT url, CAST((row_number() OVER (ORDER BY url) - 1) % 4 AS INTEGER) AS rank FROM (SELECT DISTINCT url FROM pages)")
def rank_stripes(spark, sf_dir):
    return align.striped(V.table(spark, sf_dir, "pages").select("url").distinct(), "url", 4)


@query("two_phase", "T4", """SELECT o_orderkey AS id, l_linenumber AS line, o_orderkey * 3 + l_linenumber AS answer FROM (SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')""")
def two_phase(spark, sf_dir):
    """A value an order, made once and cached, then used by all its lines."""
    rows = V.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"))
    rows = rows.join(V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id")
    out = P.two_phase(rows, lambda r: r.select("id", (F.col("id") * 3).alias("seen")), lambda r: r.select("id", "line", (F.col("seen") + F.col("line")).alias("answer")))
    return out
