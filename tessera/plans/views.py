"""Inputs derived from the TPC-like tables, in Spark and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.align import ORD
from tessera.schemas import COORDINATE_SYSTEM


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TOTAL = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _derived() -> list:
    """What an element takes from its line: txt, x1, y1, w, h."""
    return [
        F.concat_ws(" ", "l_returnflag", "l_linestatus", (F.col("l_linenumber") % 3).cast("string")).alias("txt"),
        (F.col("l_partkey") % 800).cast("int").alias("x1"), (F.col("l_suppkey") % 800).cast("int").alias("y1"),
        F.when(F.col("l_partkey") % 13 == 0, 0).otherwise(1 + F.col("l_quantity").cast("int")).alias("w"), (1 + 7 * F.col("l_linenumber")).alias("h"),
    ]


def el_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    idx = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*TOTAL)) - 1
    # in a second step, or what is derived would be shuffled for the window beside what it derives from
    return l.withColumn("idx", idx).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "idx", *_derived())


def _box(shift):
    x1 = F.col("x1") + shift
    return F.array(x1, F.col("y1"), x1 + F.col("w"), F.col("y1") + F.col("h")).cast("array<int>")


def _pred() -> tuple:
    """(kept, text, box) of a predicted element."""
    k = F.col("txt")
    text = F.when(F.col("l_suppkey") % 5 == 0, F.concat(F.lit("  "), F.lower(k), F.lit(" "))).otherwise(k)
    return (F.col("l_partkey") % 11 != 0) & (F.col("l_orderkey") % 29 != 0), text, _box(3 * (F.col("l_linenumber") % 3))


def _ref() -> tuple:
    return (F.col("l_partkey") % 17 != 0) & (F.col("l_orderkey") % 31 != 0), F.col("txt"), _box(F.lit(0))


def _elements(base: DataFrame, kept, text, box) -> DataFrame:
    e = base.filter(kept).select("l_orderkey", "l_suppkey", "idx", text.alias("text"), box.alias("bbox_norm"), (F.col("l_linenumber") == 1).alias("focused"))
    return e.withColumn("sample_id", F.concat(F.lit("parsing-"), F.col("l_orderkey").cast("string")))


def el_pred(spark, sf_dir) -> DataFrame:
    return _elements(el_base(spark, sf_dir), *_pred())


def el_ref(spark, sf_dir) -> DataFrame:
    return _elements(el_base(spark, sf_dir), *_ref())


#: Columns of a line that tell its elements and, among lines of one order and supplier, those of one text apart.
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"]


def el_both(spark: SparkSession, sf_dir: str, key) -> DataFrame:
    """Lines dealt by ``key`` with sample, its value, and pred and ref, the element of either side (text, bbox_norm) or null.

    Lines are shuffled as they are, once for both sides; elements are derived behind that. They have no idx, which is a
    window over orders: in the order of ``LINE`` lines come as by idx, but for lines equal in order, number, part, supplier
    and quantity, whose boxes are equal, so that it matters to no match.
    """
    l = table(spark, sf_dir, "lineitem").select(*LINE).filter(_pred()[0] | _ref()[0])  # noqa: E741
    side = lambda kept, text, box: F.when(kept, F.struct(text.alias("text"), box.alias("bbox_norm")))
    d = l.withColumn("sample", key).repartition("sample").select("sample", *LINE, *_derived())
    return d.select("sample", *LINE, side(*_pred()).alias("pred"), side(*_ref()).alias("ref"))


def samples(elements: DataFrame) -> DataFrame:
    """Label rows: one a sample, elements in order."""
    es = F.transform(F.sort_array(F.collect_list(F.struct("idx", "text", "bbox_norm", "focused"))), lambda e: F.struct(e["text"].alias("text"), e["bbox_norm"].alias("bbox_norm"), e["focused"].alias("focused")))
    return elements.groupBy("sample_id", "l_orderkey").agg(es.alias("elements")).select(
        F.col("sample_id").alias("id"), F.concat(F.lit("img/"), F.col("sample_id"), F.lit(".png")).alias("image"), F.lit("parsing").alias("task"), F.lit("").alias("query"),
        "elements", F.lit(COORDINATE_SYSTEM).alias("coordinate_system"), F.col("l_orderkey").alias(ORD),
    )


def pred(spark, sf_dir) -> DataFrame:
    return samples(el_pred(spark, sf_dir))


def ref(spark, sf_dir) -> DataFrame:
    return samples(el_ref(spark, sf_dir))


def qa_pairs(spark, sf_dir) -> DataFrame:
    """A user turn with the assistant turn that follows it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("target", F.lead("text").over(w)).withColumn("next_role", F.lead("role").over(w))
    return c.filter("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prediction"), "target")


def logit_rows(spark, sf_dir) -> DataFrame:
    """(vec_id, student, reference, label): each vector with the next one, as doubles."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("student"), "label")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("student").alias("reference"))
    return e.join(nxt, "vec_id")


HEAD = '{"coordinate_system":"normalized_0_1000","elements":['
#: Fixed value.
NONE_LEFT = "No usable elements remained after normalization."


def answer_sql(how: str = "l_orderkey % 6", kept: str = "true") -> str:
    """What parsing gives for the answers of ``parsing.raw_answers``, from the damage: (id, how, parse_ok, usable, element_count,
    salvaged, salvage_reason, parse_error). Of an answer cut at 70 % the elements that end before the cut are seen."""
    return f"""{BASE_SQL},
je AS (SELECT sample_id, {how} AS how, idx, ok, row_number() OVER w AS nth, length('{{"bbox_norm":[' || bx1 || ',' || by1 || ',' || bx2 || ',' || by2 || '],"focused":' || focused || ',"text":"' || text || '"}}') AS len
    FROM p WHERE {kept} WINDOW w AS (PARTITION BY sample_id ORDER BY idx)),
jc AS (SELECT *, {len(HEAD)} - 1 + sum(len + 1) OVER (PARTITION BY sample_id ORDER BY idx) AS end_at, CAST(floor(({len(HEAD)} + 1 + sum(len + 1) OVER (PARTITION BY sample_id)) * CAST(0.7 AS DOUBLE)) AS BIGINT) AS cut FROM je),
js AS (SELECT *, how IN (0, 1, 2, 5) OR (how = 3 AND end_at <= cut) AS seen FROM jc),
an AS (SELECT sample_id AS id, how, count(*) FILTER (WHERE seen AND ok) AS kept, min(nth) FILTER (WHERE seen AND NOT ok) AS bad, count(*) FILTER (WHERE seen) AS n, max(cut) - max(end_at) FILTER (WHERE seen) AS behind FROM js GROUP BY 1, 2),
answers AS (SELECT id, CAST(how AS INTEGER) AS how, kept > 0 AND bad IS NULL AS parse_ok, kept > 0 AS usable, CAST(kept AS INTEGER) AS element_count, how = 3 AND n > 0 AS salvaged,
    CASE WHEN how = 3 AND n > 0 THEN CASE WHEN behind >= 2 THEN 'truncated_tail_element_dropped' ELSE 'truncated_elements_recovered' END END AS salvage_reason,
    CASE WHEN n = 0 THEN 'direct JSON parse' WHEN how = 3 AND behind < 2 THEN CASE WHEN kept = 0 THEN '{NONE_LEFT}' END
      WHEN bad IS NOT NULL THEN 'element_' || bad || ': invalid bbox_norm coordinates' WHEN kept = 0 THEN '{NONE_LEFT}' END AS parse_error FROM an)"""


BASE_SQL = """
el_base AS (SELECT *, 'parsing-' || l_orderkey AS sample_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS idx,
    l_returnflag || ' ' || l_linestatus || ' ' || (l_linenumber % 3) AS txt, CAST(l_partkey % 800 AS INTEGER) AS x1, CAST(l_suppkey % 800 AS INTEGER) AS y1,
    CASE WHEN l_partkey % 13 = 0 THEN 0 ELSE 1 + CAST(floor(l_quantity) AS INTEGER) END AS w, 1 + 7 * l_linenumber AS h FROM lineitem),
el_pred AS (SELECT l_orderkey, sample_id, idx, CASE WHEN l_suppkey % 5 = 0 THEN '  ' || lower(txt) || ' ' ELSE txt END AS text,
    x1 + 3 * (l_linenumber % 3) AS bx1, y1 AS by1, x1 + 3 * (l_linenumber % 3) + w AS bx2, y1 + h AS by2, l_linenumber = 1 AS focused FROM el_base WHERE l_partkey % 11 <> 0 AND l_orderkey % 29 <> 0),
el_ref AS (SELECT l_orderkey, sample_id, idx, txt AS text, x1 AS bx1, y1 AS by1, x1 + w AS bx2, y1 + h AS by2, l_linenumber = 1 AS focused FROM el_base WHERE l_partkey % 17 <> 0 AND l_orderkey % 31 <> 0),
p AS (SELECT *, lower(trim(text)) AS t, bx1 >= 0 AND bx1 < bx2 AND bx2 <= 1000 AND by1 >= 0 AND by1 < by2 AND by2 <= 1000 AS ok FROM el_pred),
r AS (SELECT *, lower(trim(text)) AS t, bx1 >= 0 AND bx1 < bx2 AND bx2 <= 1000 AND by1 >= 0 AND by1 < by2 AND by2 <= 1000 AS ok FROM el_ref)"""


#: labels_of: (id, ord, label), the serialised label of each predicted sample; goes behind BASE_SQL.
LABEL_SQL = """labels_of AS (SELECT sample_id AS id, l_orderkey AS ord, '{"coordinate_system":"normalized_0_1000","elements":[' ||
  string_agg('{"bbox_norm":[' || bx1 || ',' || by1 || ',' || bx2 || ',' || by2 || '],"focused":' || focused || ',"text":"' || text || '"}', ',' ORDER BY idx) || ']}' AS label FROM el_pred GROUP BY 1, 2)"""


def iou_sql(a: str, b: str) -> str:
    w = f"greatest(0, least({a}.bx2, {b}.bx2) - greatest({a}.bx1, {b}.bx1))"
    h = f"greatest(0, least({a}.by2, {b}.by2) - greatest({a}.by1, {b}.by1))"
    area = lambda x: f"(greatest(0, {x}.bx2 - {x}.bx1) * greatest(0, {x}.by2 - {x}.by1))"
    union = f"({area(a)} + {area(b)} - {w} * {h})"
    return f"(CASE WHEN {a}.ok AND {b}.ok AND {union} > 0 THEN CAST({w} * {h} AS DOUBLE) / {union} ELSE 0.0 END)"


SCORE_SQL = BASE_SQL + f""",
cand AS (SELECT p.sample_id, list({{'p': [p.idx], 'r': [r.idx], 's': {iou_sql('p', 'r')}, 'b': CAST(p.ok AND r.ok AS INTEGER)}} ORDER BY -{iou_sql('p', 'r')}, p.idx, r.idx) AS cs
    FROM p JOIN r ON p.sample_id = r.sample_id AND p.t = r.t GROUP BY p.sample_id),
fold AS (SELECT sample_id, list_reduce(cs, lambda a, c: CASE WHEN list_has_any(a.p, c.p) OR list_has_any(a.r, c.r) THEN a
    ELSE {{'p': list_concat(a.p, c.p), 'r': list_concat(a.r, c.r), 's': a.s + c.s, 'b': a.b + c.b}} END) AS m FROM cand),
keys AS (SELECT coalesce(a.sample_id, b.sample_id) AS key, coalesce(a.n, 0) AS np, coalesce(b.n, 0) AS nr, a.n IS NULL AS missing_prediction, b.n IS NULL AS missing_reference
    FROM (SELECT sample_id, count(*) AS n FROM p GROUP BY 1) a FULL JOIN (SELECT sample_id, count(*) AS n FROM r GROUP BY 1) b USING (sample_id)),
s0 AS (SELECT k.*, coalesce(len(m.p), 0) AS tp, coalesce(m.s, 0.0) AS iou_sum, coalesce(m.b, 0) AS boxes FROM keys k LEFT JOIN fold f ON f.sample_id = k.key),
s1 AS (SELECT *, CASE WHEN np = 0 AND nr = 0 THEN 1.0 WHEN np = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / np END AS pr, CASE WHEN np = 0 AND nr = 0 THEN 1.0 WHEN nr = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / nr END AS re FROM s0)"""
