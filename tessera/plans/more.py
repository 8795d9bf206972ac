"""Further queries: joins, statistics and array steps of evaluation and training data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import logits as L
from tessera.functions import text as T
from tessera.operators import align, match, metrics, references
from tessera.plans import arrays, parsing  # noqa: F401  registers the SQL used here
from tessera.plans import views as V
from tessera.plans.catalogue import SQL, query

R = 6


def first_by_label(elements):
    """The first element of each normalised text of a sample."""
    e = elements.withColumn("label", T.normalize(F.col("text")))
    return e.groupBy("sample_id", "label").agg(F.min_by(F.struct("bbox_norm", "focused"), "idx").alias("e")).select("sample_id", "label", "e.bbox_norm", "e.focused")


@query("shared_labels", "J11", f"""WITH {V.BASE_SQL}, a AS (SELECT sample_id, t, arg_min(ROW(bx1, by1, bx2, by2, ok), idx) AS e, arg_min(focused, idx) AS f FROM p GROUP BY 1, 2), b AS (SELECT sample_id, t, arg_min(focused, idx) AS f FROM r GROUP BY 1, 2)
SELECT sample_id, count(*) AS shared, round(avg(CASE WHEN a.f = b.f THEN 1.0 ELSE 0.0 END), 6) AS focused_accuracy FROM a JOIN b USING (sample_id, t) GROUP BY 1""")
def shared_labels(spark, sf_dir):
    a, b = first_by_label(V.el_pred(spark, sf_dir)), first_by_label(V.el_ref(spark, sf_dir)).withColumnRenamed("focused", "wanted").drop("bbox_norm")
    j = a.join(b, ["sample_id", "label"])
    return j.groupBy("sample_id").agg(F.count("*").alias("shared"), F.round(F.avg((F.col("focused") == F.col("wanted")).cast("double")), R).alias("focused_accuracy"))


@query("base_rows", "J6", "SELECT o_orderkey AS id, o_orderstatus AS status, coalesce(l.n, 0) AS elements, l.n IS NULL AS from_sample FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l_orderkey = o_orderkey")
def base_rows(spark, sf_dir):
    base = V.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n")).withColumn(align.ORD, F.col("id"))
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return align.base_rows(o, base).select("id", "status", F.coalesce("n", F.lit(0)).alias("elements"), "from_sample")


@query("attach_metrics", "J15 A13", f"""WITH {V.BASE_SQL}, q AS (SELECT p.sample_id, avg({V.iou_sql('p', 'r')}) FILTER (WHERE p.ok AND r.ok) AS iou FROM p JOIN r ON p.sample_id = r.sample_id AND p.idx = r.idx GROUP BY 1)
SELECT s.sample_id, n, round(iou, 6) AS mean_iou FROM (SELECT sample_id, count(*) AS n FROM el_ref GROUP BY 1) s LEFT JOIN q USING (sample_id)""")
def attach_metrics(spark, sf_dir):
    from tessera.plans.evaluation import box_pairs

    m = metrics.box_aggregate(box_pairs(spark, sf_dir), "sample_id").select("sample_id", F.round("mean_iou", R).alias("mean_iou"))
    return V.el_ref(spark, sf_dir).groupBy("sample_id").agg(F.count("*").alias("n")).join(m, "sample_id", "left")


@query("role_delta", "A15", "SELECT round(avg(value) FILTER (WHERE user_id % 2 = 0) - avg(value) FILTER (WHERE user_id % 2 = 1), 6) AS delta, event_type FROM events GROUP BY event_type")
def role_delta(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").withColumn("role", F.col("user_id") % 2)
    return metrics.role_delta(e, "value", 0, 1, by="event_type").select("event_type", F.round("delta", R).alias("delta"))


@query("validation_loss", "A20 A21", "SELECT event_type, round(coalesce(sum(value * (event_id % 3)) FILTER (WHERE event_id % 11 <> 0), 0) / greatest(coalesce(sum(event_id % 3) FILTER (WHERE event_id % 11 <> 0), 0), 1.0), 6) AS loss FROM events GROUP BY 1")
def validation_loss(spark, sf_dir):
    """Token losses under a mask of weights 0 to 2; each eleventh loss is missing."""
    e = V.table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"), (F.col("event_id") % 3).alias("mask"))
    return metrics.masked_loss(e, "value", "mask", by="event_type").withColumn("loss", F.round("loss", R))


@query("gradient_norms", "A25", "SELECT p_brand, count(*) FILTER (WHERE p_partkey % 7 <> 0) AS tensors, count(*) FILTER (WHERE p_partkey % 7 = 0) AS missing, round(sqrt(coalesce(sum(p_retailprice * p_retailprice) FILTER (WHERE p_partkey % 7 <> 0), 0)), 4) AS norm FROM part GROUP BY 1")
def gradient_norms(spark, sf_dir):
    """Each seventh tensor has no gradient."""
    p = V.table(spark, sf_dir, "part").select("p_brand", F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("grad"))
    return metrics.gradient_norms(p, "p_brand", "grad").withColumn("norm", F.round("norm", 4))


@query("image_group_stats", "A27", f"""WITH {V.BASE_SQL} SELECT l_orderkey % 10 AS grp, count(DISTINCT sample_id) AS images, count(*) AS elements, count(*) FILTER (WHERE focused) AS focused, count(*) FILTER (WHERE NOT ok) AS invalid FROM p GROUP BY 1""")
def image_group_stats(spark, sf_dir):
    return metrics.image_group_stats(V.el_pred(spark, sf_dir).withColumn("grp", F.col("l_orderkey") % 10), "grp", "l_orderkey")


@query("repeated_ids", "A30", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def repeated_ids(spark, sf_dir):
    return align.repeated(V.table(spark, sf_dir, "orders"), "o_custkey")


@query("unix_lines", "F16", "SELECT doc_id, md5(trim(replace(replace(replace(text, chr(10), chr(13) || chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10)))) AS text FROM documents")
def unix_lines(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.unix_lines(F.replace("text", F.lit("\n"), F.lit("\r\n")))).alias("text"))


@query("answer_tokens", "F46", """SELECT vec_id, CASE vec_id % 6 WHEN 0 THEN vec_id || ',1' WHEN 1 THEN vec_id || ',2' WHEN 2 THEN vec_id || ',3,' || label WHEN 3 THEN vec_id || ',4' WHEN 4 THEN vec_id || ',3,' || label ELSE '' END AS tokens,
  CASE vec_id % 6 WHEN 0 THEN vec_id || ',1' WHEN 1 THEN vec_id || ',2' WHEN 2 THEN vec_id || ',3,' || label WHEN 4 THEN vec_id || ',3,' || label ELSE '' END AS strict FROM embeddings""")
def answer_tokens(spark, sf_dir):
    """By vec_id % 6: cached beside teacher scores, beside switch scores, parsing rows without either, generated ids only,
    a task that has no use for cached ones, and nothing."""
    v, k = F.col("vec_id").cast("int"), F.col("vec_id") % 6
    rows = V.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(k == 4, "vqa").otherwise(" parsing").alias("task"), F.when(k == 0, F.array(v, F.lit(1))).when(k == 4, F.array(v, F.lit(9))).alias("teacher_logits_answer_token_ids"),
        F.when(k <= 1, F.array(F.array(v, F.lit(2)), F.array(F.lit(8)))).alias("switch_logits_answer_token_ids"), F.when(k.isin(0, 1, 2, 4), F.array(v, F.lit(3), F.col("label"))).alias("teacher_tokens"), F.when(k <= 3, F.array(F.array(v, F.lit(4)))).alias("teacher_generated_ids"))
    both = references.answer_tokens(references.answer_tokens(rows), "strict", strict=True)
    return both.select("vec_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("tokens", "strict")])


@query("answer_spans", "L16", """SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 THEN length(target) ELSE -1 END AS tokens FROM (SELECT conv_id, turn, text, role, lead(text) OVER w AS target, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'""")
def answer_spans(spark, sf_dir):
    """Characters as tokens: prompt and answer in one sequence, which in each third turn does not begin with its prompt."""
    q = V.qa_pairs(spark, sf_dir)
    split = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    prompt = F.concat(F.array(F.lit("^")), split(F.col("prediction")))
    full = F.concat(F.when(F.col("turn") % 3 == 0, F.array(F.lit("$"))).otherwise(F.array(F.lit("^"))), split(F.col("prediction")), split(F.col("target")))
    return q.select("conv_id", "turn", F.coalesce(F.size(L.answer_span(full, prompt)), F.lit(-1)).cast("long").alias("tokens"))


@query("loss_mix", "F59", "SELECT event_id, round(value + 0.5 * (event_id % 7) + 0.25 * (event_id % 5), 6) AS loss FROM events")
def loss_mix(spark, sf_dir):
    """A weighted sum of losses that fails the query on a number that is not finite."""
    x = F.col("value") + 0.5 * (F.col("event_id") % 7) + 0.25 * (F.col("event_id") % 5)
    checked = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit("loss is not finite")).cast("double")).otherwise(x)
    return V.table(spark, sf_dir, "events").select("event_id", F.round(checked, R).alias("loss"))


@query("mock_logits", "L14", "SELECT p_partkey AS id, length(p_name) AS positions, CAST(length(p_name) * (length(p_name) - 1) / 2 AS BIGINT) AS total FROM part")
def mock_logits(spark, sf_dir):
    """Scores that follow from position and place, padded to 64 positions and masked again."""
    n = V.table(spark, sf_dir, "part").select("p_partkey", F.length("p_name").alias("len"))
    values = F.transform(F.sequence(F.lit(0), F.col("len") - 1), lambda i: i)
    padded = L.padded(values, F.lit(64), -100)
    kept = F.filter(padded, lambda x: x != -100)
    return n.select(F.col("p_partkey").alias("id"), F.size(kept).alias("positions"), F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("first_rows", "O3", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100")
def first_rows(spark, sf_dir):
    """max_samples: the first rows in order; the limit is the feature."""
    return V.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey").limit(100)


@query("sorted_distinct", "O9", "SELECT p_brand, string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) AS sizes FROM part GROUP BY 1")
def sorted_distinct(spark, sf_dir):
    return V.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set(F.col("p_size").cast("string"))), ",").alias("sizes"))


@query("drop_empty", "P9", f"""WITH {V.BASE_SQL}, pk AS (SELECT DISTINCT sample_id, regexp_replace(t, '[^a-z0-9]', '', 'g') AS k FROM p), rk AS (SELECT DISTINCT sample_id, regexp_replace(t, '[^a-z0-9]', '', 'g') AS k FROM r),
d AS (SELECT sample_id FROM (SELECT * FROM pk EXCEPT SELECT * FROM rk) UNION SELECT sample_id FROM (SELECT * FROM rk EXCEPT SELECT * FROM pk))
SELECT count(*) AS rows FROM d WHERE sample_id IN (SELECT sample_id FROM el_pred) AND sample_id IN (SELECT sample_id FROM el_ref)""")
def drop_empty(spark, sf_dir):
    return align.unique_elements(V.ref(spark, sf_dir), V.pred(spark, sf_dir), keep_empty=False).agg(F.count("*").alias("rows"))


@query("reuse_teacher", "", "SELECT count(*) AS kept, count(*) FILTER (WHERE l_orderkey % 5 = 0) AS of_five FROM (SELECT l_orderkey FROM lineitem WHERE l_partkey % 17 <> 0 AND l_orderkey % 31 <> 0 GROUP BY 1) WHERE l_orderkey IN (SELECT o_orderkey FROM orders)")
def reuse_teacher(spark, sf_dir):
    """Teacher rows of the asked samples with elements, one an id."""
    asked = V.table(spark, sf_dir, "orders").select(F.concat(F.lit("parsing-"), F.col("o_orderkey").cast("string")).alias("id"))
    kept = align.dedup(V.ref(spark, sf_dir).filter(F.size("elements") > 0), ["id"]).join(asked, "id", "left_semi")
    return kept.agg(F.count("*").alias("kept"), F.count_if(F.col(align.ORD) % 5 == 0).alias("of_five"))


@query("flatten_roles", "U8", "SELECT 0 AS role_ord, doc_id AS id FROM documents UNION ALL SELECT 1, doc_id FROM labels")
def flatten_roles(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select(F.lit(0).alias("role_ord"), F.col("doc_id").alias("id"))
    return d.unionByName(V.table(spark, sf_dir, "labels").select(F.lit(1).alias("role_ord"), F.col("doc_id").alias("id")))


@query("prepared_reference", "L12 L10 L11", """WITH v AS (SELECT a.vec_id, a.embedding AS s, b.embedding AS r FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
t AS (SELECT vec_id, list_slice(list_sort(list_transform(range(64), lambda i: {'v': -CAST(r[i + 1] AS DOUBLE), 'i': i})), 1, 8) AS p0, list_slice(list_sort(list_transform(range(64), lambda i: {'v': -CAST(s[i + 1] AS DOUBLE), 'i': i})), 1, 8) AS p1, CASE WHEN vec_id % 3 = 0 THEN 48 ELSE 64 END AS top FROM v),
c AS (SELECT *, list_filter(p0, lambda e: e.i < top) AS c0, list_filter(p1, lambda e: e.i < top) AS c1 FROM t)
SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'remapped' WHEN 1 THEN 'same' ELSE 'skipped' END AS status, CASE WHEN vec_id % 3 = 2 THEN NULL WHEN vec_id % 2 = 0 THEN '0,0,' || len(c1) || ',0' ELSE len(c0) || ',' || len(c1) || ',0,0' END AS token_k,
  CASE WHEN vec_id % 3 <> 2 THEN round(CASE WHEN vec_id % 2 = 1 THEN coalesce(-list_sum(list_transform(c0, lambda e: e.v)), 0) ELSE 0 END - coalesce(list_sum(list_transform(c1, lambda e: e.v)), 0), 6) END AS active,
  CASE WHEN vec_id % 3 <> 2 THEN CASE WHEN vec_id % 2 = 0 THEN '0.0,0.0,0.25,0.0' ELSE '0.5,0.25,0.0,0.0' END END AS weights FROM c""")
def prepared_reference(spark, sf_dir):
    """Two positions of cached scores for a student's four: of its own vocabulary, of a larger one that is cut to the shared
    part, and of unknown size; even rows have a prompt of one position that becomes one of two."""
    k, even = F.col("vec_id") % 3, F.col("vec_id") % 2 == 0
    rows = V.logit_rows(spark, sf_dir).select(
        "vec_id", F.array(L.top_k(F.col("reference"), 8), L.top_k(F.col("student"), 8)).alias("scores"), F.when(k != 2, 64).alias("vocab_size"), F.when(k == 0, 50).otherwise(64).alias("student_vocab"),
        F.lit(4).alias("length"), F.when(even, 1).alias("prompt_len"), F.lit(2).alias("student_prompt_len"), F.array(F.lit(0.5), F.lit(0.25)).alias("token_weight"))
    out = references.prepared(rows, shared=48)
    total = F.aggregate(F.flatten("positions"), F.lit(0.0), lambda a, e: a + F.when(e["val"] > references.INACTIVE, e["val"]).otherwise(0.0))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return out.select("vec_id", "status", text("token_k").alias("token_k"), F.round(total, R).alias("active"), text("weights").alias("weights"))


@query("role_match", "J4", """WITH r AS (SELECT unnest(['base', 'tuned']) AS role)
SELECT c_custkey, role, CASE WHEN role = 'tuned' AND c_custkey % 3 <> 0 THEN 1 ELSE 0 END AS matched, CASE WHEN role = 'tuned' AND c_custkey % 3 <> 0 THEN 1 WHEN role = 'base' AND c_custkey % 2 = 0 THEN 1 ELSE 0 END AS candidates FROM customer, r""")
def role_match(spark, sf_dir):
    """Names of customers against those of two roles: 'tuned' has two rows an id, the last one right, 'base' wrong ones."""
    c = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array("c_name").alias("names"))
    made = lambda role, rows, name, n: rows.select(F.lit(role).alias("role"), "id", name.alias("names"), F.lit(n).alias(align.ORD))
    tuned, wrong = c.filter("id % 3 <> 0"), F.array(F.lit("???"))
    rows = made("tuned", tuned, wrong, 1).unionByName(made("tuned", tuned, F.col("names"), 2)).unionByName(made("base", c.filter("id % 2 = 0"), wrong, 1))
    m = align.by_role(c, rows, ["base", "tuned"]).withColumn("m", match.by_similarity(F.col("names"), F.col("candidate_names"), 0.9))
    return m.select(F.col("id").alias("c_custkey"), "role", F.size(F.filter("m", lambda r: r["matched"])).alias("matched"), F.size("candidate_names").alias("candidates"))


@query("vocab_equality", "J14", """WITH l AS (SELECT unnest([0, 1, 2]) AS pair, c_name AS token, c_custkey AS id FROM customer),
r AS (SELECT pair, token, CASE WHEN pair = 1 AND id = 7 THEN 0 ELSE id END AS id FROM l WHERE pair <> 2 OR id <> 7),
j AS (SELECT coalesce(l.pair, r.pair) AS pair, l.id, l.token IS NOT NULL AND r.token IS NOT NULL AND l.id = r.id AS same FROM l FULL JOIN r ON l.pair = r.pair AND l.token = r.token)
SELECT pair, bool_and(coalesce(same, false)) AS equal, CASE WHEN bool_and(coalesce(same, false)) THEN max(id) + 1 END AS shared_size FROM j GROUP BY 1""")
def vocab_equality(spark, sf_dir):
    left = V.table(spark, sf_dir, "customer").select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("pair"), F.col("c_name").alias("token"), F.col("c_custkey").alias("id"))
    right = left.filter("pair <> 2 or id <> 7").withColumn("id", F.when((F.col("pair") == 1) & (F.col("id") == 7), 0).otherwise(F.col("id")))
    return align.vocab_equality(left, right, "pair")


@query("token_k_stats", "A22", f"SELECT CAST(min(token_k) AS DOUBLE) AS min, CAST(max(token_k) AS DOUBLE) AS max, round(avg(token_k), 6) AS mean FROM ({SQL['kneedle_k']})")
def token_k_stats(spark, sf_dir):
    return metrics.token_k_stats(arrays.kneedle_k(spark, sf_dir)).withColumn("mean", F.round("mean", R))


@query("object_text", "F23", SQL["object_lines"].split("SELECT d.doc_id")[0].replace("SELECT doc_id, lower(x) AS k, min(i) AS i", "SELECT doc_id, lower(x) AS k, min(i) AS i, arg_min(x, i) AS x") + """
SELECT d.doc_id, 'Object count: ' || count(k.k) || chr(10) || 'Objects:' || chr(10) || coalesce(string_agg('- ' || k.x, chr(10) ORDER BY k.i), '(none)') || chr(10) AS text FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY 1""")
def object_text(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", T.let(T.object_lines(F.col("text")), T.object_text).alias("text"))


@query("training_summary", "A19", """SELECT count(*) AS rows, count(*) FILTER (WHERE vec_id % 5 <> 0) AS target_rows, count(*) FILTER (WHERE vec_id % 2 = 0) AS teacher_logits_rows, count(*) FILTER (WHERE vec_id % 7 = 0) AS switch_logits_rows,
  '48,64' AS teacher_logits_vocab_sizes, '64' AS switch_logits_vocab_sizes FROM embeddings WHERE vec_id + 1 IN (SELECT vec_id FROM embeddings)""")
def training_summary(spark, sf_dir):
    k, top = F.col("vec_id"), L.top_k(F.col("reference"), 8)
    teacher, switch = k % 2 == 0, k % 7 == 0
    rows = V.logit_rows(spark, sf_dir).select(
        F.when(k % 5 != 0, F.concat(F.lit("label "), F.col("label").cast("string"))).when(k % 10 == 0, "").alias("target"),
        F.when(teacher, top).alias("teacher_logits"), F.when(teacher, F.when(k % 3 == 0, 48).otherwise(64)).alias("teacher_logits_vocab_size"),
        F.when(switch, top).alias("switch_logits"), F.when(switch, 64).alias("switch_logits_vocab_size"),
    )
    sizes = ("teacher_logits_vocab_sizes", "switch_logits_vocab_sizes")
    return metrics.training_summary(rows).withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in sizes})


@query("drawing_summary", "A28", f"""WITH {V.BASE_SQL}, d AS (SELECT *, l_orderkey % 7 <> 0 AS parsed, idx % 5 = 4 AS bad, bx1 = bx2 AS flat FROM el_pred)
SELECT count(DISTINCT sample_id) AS rows_total, count(DISTINCT sample_id) FILTER (WHERE parsed) AS images_written, count(DISTINCT sample_id) FILTER (WHERE NOT parsed) AS rows_parse_failed,
  count(*) FILTER (WHERE parsed) AS elements_total, count(*) FILTER (WHERE parsed AND NOT bad AND NOT flat) AS elements_drawn, count(*) FILTER (WHERE parsed AND (bad OR flat)) AS elements_skipped,
  count(*) FILTER (WHERE parsed AND bad) AS skipped_malformed_bbox, count(*) FILTER (WHERE parsed AND NOT bad AND flat) AS skipped_zero_area FROM d""")
def drawing_summary(spark, sf_dir):
    """Each seventh order stands for a prediction that was not parsed; the box of an element of idx % 5 = 4 lacks a number."""
    e = V.el_pred(spark, sf_dir).withColumn("bbox_norm", F.when(F.col("idx") % 5 == 4, F.slice("bbox_norm", 1, 3)).otherwise(F.col("bbox_norm")))
    rows = e.groupBy("sample_id").agg(F.collect_list(F.struct("bbox_norm")).alias("elements"))
    failed = F.substring_index("sample_id", "-", -1).cast("long") % 7 == 0
    return metrics.drawing_summary(rows.withColumn("elements", F.when(~failed, F.col("elements"))), 1920, 1080)
