"""Queries of the labelling workflow and of row validators over nested score arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import logits as L
from tessera.functions import text as T
from tessera.operators import align, references, validate
from tessera.plans import pipeline as P
from tessera.plans import views as V
from tessera.plans.catalogue import query
from tessera.plans.texts import QA_SQL


def manifest(spark, sf_dir):
    """A row an order."""
    key = F.col("o_orderkey").cast("string")
    return V.table(spark, sf_dir, "orders").select(F.concat(F.lit("m-"), key).alias("id"), F.concat(F.lit("img/"), key, F.lit(".png")).alias("image"), F.lit("parsing").alias("task"), F.col("o_orderpriority").alias("query"), F.col("o_orderkey").alias(align.ORD))


def faulty(rows):
    """Answers of the mock, by the last digit of the id: 0 to 2 prose first and at the second try the label, 3 cut in its
    first element, 4 fenced, 5 with a second element out of range, others as they are."""
    digit = F.substring("id", -1, 1).cast("int")
    told = F.col("prompt").startswith("The last answer")
    made = P.mock_answers(rows)
    second = F.replace(F.col("raw"), F.lit("}]}"), F.lit(',"z":1},{"bbox_norm":[5,5,2000,9],"text":"far"}]}'))
    raw = F.when((digit <= 2) & ~told, "I see a button.").when(digit == 3, F.substring("raw", 1, 70)).when(digit == 4, F.concat(F.lit("```json\n"), "raw", F.lit("\n```"))).when(digit == 5, second).otherwise(F.col("raw"))
    return made.withColumn("raw", raw)


@query("label_workflow", "P3 P4 M2 F22 S15 J7", """SELECT 'm-' || o_orderkey AS id, 'img/' || o_orderkey || '.png' AS image, o_orderpriority AS query, 1 AS elements FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 10 <> 3""")
def label_workflow(spark, sf_dir):
    """Orders that are not done, from a faulty backend with one retry: cut answers without an element are lost."""
    done = manifest(spark, sf_dir).filter(F.col(align.ORD) % 7 == 0).select("id")
    rows = P.label(manifest(spark, sf_dir), done, faulty, retries=1, template="Find {query} as {task}.")
    return rows.select("id", "image", "query", F.size("elements").alias("elements"))


@query("validate_manifest", "P13", """SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'id is missing' WHEN o_orderkey % 7 = 0 THEN 'image is missing' WHEN o_orderkey % 11 = 0 THEN 'task is missing' WHEN o_orderkey % 3 = 0 THEN 'task must be parsing' ELSE 'valid' END AS reason, count(*) AS rows FROM orders GROUP BY 1""")
def validate_manifest(spark, sf_dir):
    k = F.col(align.ORD)
    m = manifest(spark, sf_dir).withColumns({
        "id": F.when(k % 5 != 0, F.col("id")).when(k % 2 == 0, " "), "image": F.when(k % 7 != 0, F.col("image")), "task": F.when(k % 11 == 0, F.lit("")).when(k % 3 == 0, F.lit("vqa")).otherwise(F.col("task"))})
    return m.groupBy(F.coalesce(P.manifest_reason(), F.lit("valid")).alias("reason")).agg(F.count("*").alias("rows"))


@query("format_prompts", "P17 F22", """SELECT 'm-' || o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'The last answer could not be read as JSON. Follow the instructions below again, and answer with JSON alone.' || chr(10) || chr(10) ELSE '' END || 'Find ' || o_orderpriority || ' in {task} as parsing.' AS prompt FROM orders""")
def format_prompts(spark, sf_dir):
    prompt = P.prompt("Find {query} in {{task}} as {task}.")
    return manifest(spark, sf_dir).select("id", F.when(F.col(align.ORD) % 2 == 0, P.retry_prompt(prompt)).otherwise(prompt).alias("prompt"))


@query("existing_answers", "P6 F37", f"""WITH {V.BASE_SQL}, {V.LABEL_SQL} SELECT id, CASE WHEN ord % 3 = 0 THEN label WHEN ord % 3 = 1 THEN 'said ' || ord END AS own FROM labels_of""")
def existing_answers(spark, sf_dir):
    """Rows with elements, with an answer only, and with neither; other tasks keep their elements for themselves."""
    k = F.col(align.ORD)
    s = V.pred(spark, sf_dir).withColumns({"elements": F.when(k % 3 != 2, F.col("elements")), "task": F.when(k % 3 == 1, "vqa").otherwise(F.col("task")), "answer": F.when(k % 3 != 2, F.concat(F.lit("said "), k.cast("string"))).otherwise("")})
    return s.select("id", P.existing_answer(s).alias("own"))


@query("target_texts", "F47 F36", f"""WITH {V.BASE_SQL}, {V.LABEL_SQL} SELECT id, CASE WHEN ord % 4 = 0 THEN 'answer ' || ord WHEN ord % 4 = 1 THEN '' ELSE label END AS target FROM labels_of""")
def target_texts(spark, sf_dir):
    k = F.col(align.ORD)
    s = V.pred(spark, sf_dir).withColumns({"task": F.when(k % 4 <= 1, "vqa").otherwise(" parsing "), "teacher_answer": F.when(k % 4 == 0, F.concat(F.lit("  answer "), k.cast("string"), F.lit(" ")))})
    return references.target_text(s).select("id", "target")


@query("joined_prompts", "F22", f"WITH {QA_SQL} SELECT conv_id, turn, md5(trim(CASE WHEN turn % 2 = 0 THEN prediction || ' ' ELSE rtrim(prediction) || ' ' END || target, ' ' || chr(10) || chr(9) || chr(13))) AS text FROM qa")
def joined_prompts(spark, sf_dir):
    q = V.qa_pairs(spark, sf_dir)
    prompt = F.when(F.col("turn") % 2 == 0, F.concat("prediction", F.lit(" "))).otherwise(F.rtrim("prediction"))
    return q.select("conv_id", "turn", F.md5(references.joined(prompt, F.col("target"))).alias("text"))


@query("legacy_convert", "P12", "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS teacher_answer FROM documents")
def legacy_convert(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("teacher_answer"), F.col("source").alias("student_target"))
    return P.legacy_rows(d)


@query("confidence_filter", "P5", "SELECT doc_id AS id FROM labels WHERE quality >= 1")
def confidence_filter(spark, sf_dir):
    return P.confident(V.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("teacher_confidence")), 0.5).select("id")


@query("training_rows", "P7", f"WITH {V.BASE_SQL} SELECT count(*) AS rows, count(DISTINCT sample_id) AS ids FROM (SELECT DISTINCT sample_id, l_orderkey FROM el_pred) WHERE l_orderkey % 4 <> 0")
def training_rows(spark, sf_dir):
    rows = V.pred(spark, sf_dir)
    rows = rows.withColumn("elements", F.when(F.col(align.ORD) % 4 == 0, F.filter("elements", lambda e: F.lit(False))).otherwise(F.col("elements")))
    return P.training_rows(rows).agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"))


def switch_rows(spark, sf_dir):
    """Compact score rows, damaged in turn by vec_id % 8."""
    k = F.col("vec_id") % 8
    r = V.logit_rows(spark, sf_dir).select("vec_id", L.top_k(F.col("student"), 4).alias("t"))
    idx, val = F.transform("t", lambda e: e["idx"]), F.transform("t", lambda e: e["val"])
    idx = F.when(k == 1, F.transform(idx, lambda i: i + 64)).when(k == 2, F.slice(idx, 1, 3)).otherwise(idx)
    val = F.when(k == 3, F.transform(val, lambda v: F.lit(float("nan")))).otherwise(val)
    return r.select(
        F.concat(F.lit("v-"), F.col("vec_id").cast("string")).alias("id"), F.array(F.array(idx)).alias("indices"), F.array(F.array(val)).alias("values"),
        F.when(k == 4, F.array(F.lit(1), F.lit(1))).when(k == 5, F.array(F.lit(1), F.lit(2), F.lit(4))).otherwise(F.array(F.lit(1), F.lit(1), F.lit(4))).alias("shape"),
        F.when(k == 6, 0).otherwise(64).alias("vocab_size"), F.when(k == 7, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("tokens"),
    )


@query("switch_validation", "A8 V6", """SELECT CASE (vec_id % 8) WHEN 1 THEN 'index is out of range' WHEN 2 THEN 'indices and values differ in shape' WHEN 3 THEN 'value is not finite' WHEN 4 THEN 'shape must have three positive numbers'
  WHEN 5 THEN 'payload does not have the stated shape' WHEN 6 THEN 'vocab_size must be positive' WHEN 7 THEN 'sequence length differs from the tokens' ELSE 'valid' END AS reason, count(*) AS rows
FROM embeddings WHERE vec_id + 1 IN (SELECT vec_id FROM embeddings) GROUP BY 1""")
def switch_validation(spark, sf_dir):
    return switch_rows(spark, sf_dir).groupBy(F.coalesce(validate.compact_reason(), F.lit("valid")).alias("reason")).agg(F.count("*").alias("rows"))


@query("training_validation", "V4", """SELECT CASE WHEN doc_id % 5 = 0 THEN 'query is missing' WHEN doc_id % 5 = 1 THEN 'target text is missing' WHEN doc_id % 5 = 2 THEN 'teacher_logits is not allowed here' WHEN doc_id % 5 = 3 AND doc_id % 2 = 0 THEN 'switch_logits is not allowed here' ELSE 'valid' END AS reason, count(*) AS rows FROM documents GROUP BY 1""")
def training_validation(spark, sf_dir):
    """Rows for online training, which must not carry cached scores."""
    k = F.col("doc_id") % 5
    d = V.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("image"), F.when(k != 0, F.col("lang")).alias("query"), F.when(k != 1, F.concat(F.lit("t "), "text")).otherwise(" ").alias("target"),
        F.when(k == 2, F.array("n_chars")).alias("teacher_logits"), F.when((k == 3) & (F.col("doc_id") % 2 == 0), F.array("n_chars")).alias("switch_logits"))
    return d.groupBy(F.coalesce(validate.training_reason(("teacher_logits", "switch_logits")), F.lit("valid")).alias("reason")).agg(F.count("*").alias("rows"))


@query("file_profile", "F20", "SELECT p_partkey, (p_partkey % 2 + 1) * 360 || 'p' AS resolution, CASE WHEN p_partkey % 3 = 0 THEN '4bit' END AS quantization FROM part")
def file_profile(spark, sf_dir):
    name = F.concat(F.lit("out/teacher_labels_"), ((F.col("p_partkey") % 2 + 1) * 360).cast("string"), F.lit("p"), F.when(F.col("p_partkey") % 3 == 0, "_4bit").otherwise(""), F.lit(".jsonl"))
    return V.table(spark, sf_dir, "part").select("p_partkey", T.file_profile(name).alias("f")).select("p_partkey", "f.resolution", "f.quantization")


@query("contract_sets", "U7 V14", """WITH h AS (SELECT DISTINCT p_brand, p_size FROM part), w AS (SELECT unnest(range(1, 41)) AS s), b AS (SELECT DISTINCT p_brand FROM part)
SELECT p_brand, (SELECT count(*) + 1 FROM w WHERE s NOT IN (SELECT p_size FROM h WHERE h.p_brand = b.p_brand)) AS missing, (SELECT count(*) FROM h WHERE h.p_brand = b.p_brand AND p_size > 40) AS unexpected FROM b""")
def contract_sets(spark, sf_dir):
    """Sizes of each brand against those that a contract names, one of which no part has."""
    have = V.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set(F.col("p_size").cast("string")).alias("have"))
    want = F.array(*[F.lit(str(n)) for n in range(1, 41)], F.lit("none"))
    return have.select("p_brand", validate.contract(F.col("have"), want).alias("c")).select("p_brand", F.size("c.missing").cast("long").alias("missing"), F.size("c.unexpected").cast("long").alias("unexpected"))
