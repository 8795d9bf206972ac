"""Queries of text functions over conversations, documents and page addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import align, match
from tessera.plans import views as V
from tessera.plans.catalogue import query

R = 6

QA_SQL = """qa AS (SELECT conv_id, turn, text AS prediction, target FROM (SELECT *, lead(text) OVER w AS target, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'),
n AS (SELECT *, lower(trim(regexp_replace(prediction, '\\s+', ' ', 'g'))) AS a, lower(trim(regexp_replace(target, '\\s+', ' ', 'g'))) AS b FROM qa)"""
TOKENS_SQL = f"""{QA_SQL}, w AS (SELECT *, list_filter(string_split(a, ' '), lambda x: x <> '') AS p, list_filter(string_split(b, ' '), lambda x: x <> '') AS t FROM n),
o AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(list_intersect(p, t)), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(t, lambda y: y = x))))), 0) AS k FROM w)"""


@query("normalize_text", "F1", f"WITH {QA_SQL} SELECT conv_id, turn, md5(a) AS a, md5(b) AS b FROM n")
def normalize_text(spark, sf_dir):
    return V.qa_pairs(spark, sf_dir).select("conv_id", "turn", F.md5(T.normalize(F.col("prediction"))).alias("a"), F.md5(T.normalize(F.col("target"))).alias("b"))


@query("exact_match", "F2", f"WITH {QA_SQL} SELECT avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS exact, count(*) AS pairs FROM n")
def exact_match(spark, sf_dir):
    return V.qa_pairs(spark, sf_dir).agg(F.avg(T.exact_match(F.col("prediction"), F.col("target"))).alias("exact"), F.count("*").alias("pairs"))


@query("token_f1", "F3", f"WITH {TOKENS_SQL} SELECT conv_id, turn, round(CASE WHEN len(p) = 0 AND len(t) = 0 THEN 1.0 WHEN k = 0 THEN 0.0 ELSE 2.0 * k / (len(p) + len(t)) END, 6) AS f1 FROM o")
def token_f1(spark, sf_dir):
    return V.qa_pairs(spark, sf_dir).select("conv_id", "turn", F.round(T.token_f1(F.col("prediction"), F.col("target")), R).alias("f1"))


@query("element_f1", "F4", f"WITH {TOKENS_SQL} SELECT conv_id, turn, round(CAST(k AS DOUBLE) / len(p), 6) AS precision, round(CAST(k AS DOUBLE) / len(t), 6) AS recall FROM o WHERE len(p) > 0 AND len(t) > 0")
def element_f1(spark, sf_dir):
    q = V.qa_pairs(spark, sf_dir).select("conv_id", "turn", T.tokens(F.col("prediction")).alias("p"), T.tokens(F.col("target")).alias("t")).filter("size(p) > 0 and size(t) > 0")
    q = q.select("conv_id", "turn", T.multiset_scores(F.col("p"), F.col("t")).alias("s"))
    return q.select("conv_id", "turn", F.round("s.precision", R).alias("precision"), F.round("s.recall", R).alias("recall"))


@query("label_key", "F5", r"SELECT doc_id, md5(regexp_replace(lower(text), '[^\p{L}\p{Nd}\p{Nl}\p{No}]', '', 'g')) AS key FROM documents")
def label_key(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.label_key(F.col("text"))).alias("key"))


@query("strong_normalize", "F6", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[\s_\-]+', ' ', 'g'), '[^\p{L}\p{Nd}\p{Nl}\p{No} ]', '', 'g'), ' +', ' ', 'g'))) AS text FROM documents")
def strong_normalize(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.strong_normalize(F.col("text"))).alias("text"))


NAME_SQL = r"""nm AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[\s_\-]+', ' ', 'g'), '[^\p{L}\p{Nd}\p{Nl}\p{No} ]', '', 'g'), ' +', ' ', 'g')) AS a,
  trim(regexp_replace(regexp_replace(regexp_replace(lower(p_type), '[\s_\-]+', ' ', 'g'), '[^\p{L}\p{Nd}\p{Nl}\p{No} ]', '', 'g'), ' +', ' ', 'g')) AS b FROM part),
c AS (SELECT *, list_filter(string_split(a, ' '), lambda x: x <> '') AS wa, list_filter(string_split(b, ' '), lambda x: x <> '') AS wb, string_split(replace(a, ' ', ''), '') AS ca, string_split(replace(b, ' ', ''), '') AS cb FROM nm),
k AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(list_intersect(ca, cb)), lambda x: least(len(list_filter(ca, lambda y: y = x)), len(list_filter(cb, lambda y: y = x))))), 0) AS common FROM c)"""


@query("name_similarity", "F7 F8 F9", f"""WITH {NAME_SQL} SELECT p_partkey, round(CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.9
  ELSE greatest(CAST(len(list_intersect(list_distinct(wa), list_distinct(wb))) AS DOUBLE) / len(list_distinct(list_concat(wa, wb))), 2.0 * common / (len(ca) + len(cb))) END, 6) AS similarity FROM k""")
def name_similarity(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select("p_partkey", F.round(T.name_similarity(F.col("p_name"), F.col("p_type")), R).alias("similarity"))


@query("image_path", "F10", r"SELECT page_id, array_to_string(list_filter(string_split(replace(url, '\', '/'), '/'), lambda x: x <> '' AND x <> '.'), '/') AS path FROM pages")
def image_path(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", T.image_path(F.col("url")).alias("path"))


@query("raw_preview", "F13", r"""SELECT doc_id, CASE WHEN length(t) > 200 THEN substr(t, 1, 197) || '...' ELSE t END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def raw_preview(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", T.raw_preview(F.col("text")).alias("preview"))


@query("strip_special", "F14", r"SELECT conv_id, turn, trim(regexp_replace('<|im_start|>' || text || '<|im_end|>', '<\|[^|>]+\|>', '', 'g')) AS text FROM conversations")
def strip_special(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.strip_special(F.concat(F.lit("<|im_start|>"), "text", F.lit("<|im_end|>"))).alias("text"))


@query("degenerate_output", "F15", r"""SELECT doc_id, t = '' OR length(regexp_replace(t, '[\p{L}\p{Nd}\p{Nl}\p{No}\s]', '', 'g')) > 0.6 * length(t) OR regexp_full_match(t, '[!?.`~_\-=\s]+') AS degenerate
FROM (SELECT doc_id, trim(text) AS t FROM documents)""")
def degenerate_output(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", T.looks_degenerate(F.col("text")).alias("degenerate"))


@query("safe_name", "F12", r"SELECT p_partkey, lower(regexp_replace(regexp_replace(p_name || ' (' || p_brand || ')', '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS name FROM part")
def safe_name(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select("p_partkey", T.safe_name(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("name"))


@query("family_key", "F21", "SELECT p_partkey, lower(replace(replace(replace(p_brand || '-' || p_type, '_', ''), '-', ''), '.', '')) AS family FROM part")
def family_key(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select("p_partkey", T.family_key(F.concat_ws("-", "p_brand", "p_type")).alias("family"))


@query("mock_confidence", "F26", """SELECT doc_id, round_even(0.55 + CAST('0x' || substr(sha256(doc_id || ':None:' || lang), 1, 4) AS BIGINT) / 65535.0 * 0.4, 4) AS confidence FROM documents""")
def mock_confidence(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.mock_confidence(F.col("doc_id").cast("string"), F.lit(None).cast("string"), F.col("lang")).alias("confidence"))


@query("manifest", "P1 W3 O1", "SELECT printf('parsing-%06d', row_number() OVER (ORDER BY url)) AS id, url AS image, 'parsing' AS task, '' AS query FROM (SELECT DISTINCT url FROM pages)")
def manifest(spark, sf_dir):
    return align.numbered_manifest(V.table(spark, sf_dir, "pages").select(F.col("url").alias("path")).distinct())


@query("natural_sort_half", "O2 P16", """WITH k AS (SELECT url, list_transform(regexp_extract_all(lower(url), '[0-9]+|[^0-9]+'), lambda p: {'k': CASE WHEN regexp_full_match(p, '[0-9]+') THEN 0 ELSE 1 END,
  'n': coalesce(TRY_CAST(p AS HUGEINT), 0), 't': CASE WHEN regexp_full_match(p, '[0-9]+') THEN '' ELSE p END}) AS key FROM (SELECT DISTINCT url FROM pages))
SELECT url, n % 2 = 1 AS kept FROM (SELECT url, row_number() OVER (ORDER BY key, url) AS n FROM k)""")
def natural_sort_half(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages").select("url").distinct().withColumn("key", T.natural_text(F.col("url")))
    return align.global_position(p, "key").select("url", (F.col("position") % 2 == 1).alias("kept"))


@query("similarity_match", "J10", None)
def similarity_match(spark, sf_dir):
    """Names of 40 parts each against the types of the same parts, in the order of their keys, greedily by similarity."""
    p = V.table(spark, sf_dir, "part").withColumn("sample", F.floor(F.col("p_partkey") / 40))
    of = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", c))), lambda x: x[c])
    names = p.groupBy("sample").agg(of("p_name").alias("names"), of("p_type").alias("types"))
    pairs = names.select("sample", F.posexplode(match.by_similarity(F.col("names"), F.col("types"), 0.4)).alias("nth", "r"))
    return pairs.select("sample", "nth", "r.ref", "r.best", F.round("r.similarity", R).alias("similarity"), "r.matched")
