"""Queries of array mathematics; vectors stand for scores of a vocabulary of 64."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import logits as L
from tessera.operators import series
from tessera.plans import views as V
from tessera.plans.catalogue import query

R = 6

ROWS_SQL = """lr AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS s, CAST(b.embedding AS DOUBLE[]) AS r, a.label FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
e AS (SELECT vec_id, label, unnest(s) AS s, unnest(r) AS r, unnest(range(0, 64)) AS i FROM lr),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i) AS ns, row_number() OVER (PARTITION BY vec_id ORDER BY r DESC, i) AS nr FROM e)"""


def kl_sql(source: str, t: float) -> str:
    """Token loss by vec_id over rows (vec_id, s, r)."""
    return f"""(SELECT vec_id, {t * t} * 0.5 * (sum(pr * (lr - ls)) + sum(ps * (ls - lr))) AS loss, {t * t} * sum(pr * (lr - ls)) AS forward FROM (SELECT vec_id, ls, lr, exp(ls) AS ps, exp(lr) AS pr FROM (
  SELECT vec_id, s / {t} - ms - ln(sum(exp(s / {t} - ms)) OVER w) AS ls, r / {t} - mr - ln(sum(exp(r / {t} - mr)) OVER w) AS lr FROM (SELECT *, max(s / {t}) OVER w AS ms, max(r / {t}) OVER w AS mr FROM ({source}) WINDOW w AS (PARTITION BY vec_id)) WINDOW w AS (PARTITION BY vec_id))) GROUP BY vec_id)"""


def rows(spark, sf_dir):
    return V.logit_rows(spark, sf_dir)


S, REF = "student", "reference"


@query("topk", "O5 L1", f"WITH {ROWS_SQL} SELECT vec_id, ns AS rank, i AS idx, round(s, 6) AS val FROM k WHERE ns <= 8")
def topk(spark, sf_dir):
    t = rows(spark, sf_dir).select("vec_id", F.posexplode(L.top_k(F.col(S), 8)).alias("rank", "e"))
    return t.select("vec_id", (F.col("rank") + 1).cast("long").alias("rank"), F.col("e.idx").cast("long").alias("idx"), F.round("e.val", R).alias("val"))


@query("dense_logits", "L1 F44", f"WITH {ROWS_SQL} SELECT vec_id, i, CASE WHEN ns <= 8 THEN round(s, 6) ELSE -1e9 END AS val FROM k")
def dense_logits(spark, sf_dir):
    t = rows(spark, sf_dir).select("vec_id", F.posexplode(L.dense(L.top_k(F.col(S), 8), F.lit(64), -1e9)).alias("i", "val"))
    return t.select("vec_id", F.col("i").cast("long").alias("i"), F.round("val", R).alias("val"))


KNEE = 32


@query("kneedle_k", "O6", f"""WITH {ROWS_SQL}, c AS (SELECT vec_id, ns, s, max(s) OVER w AS a, min(s) OVER w AS b FROM k WHERE ns <= {KNEE} WINDOW w AS (PARTITION BY vec_id)),
g AS (SELECT vec_id, ns, round((s - b) / (a - b) - (1.0 - (ns - 1) / {KNEE - 1}.0), 9) AS score FROM c)
SELECT vec_id, least(greatest(arg_min(ns, ROW(-score, ns)), 4), 24) AS token_k FROM g GROUP BY 1""")
def kneedle_k(spark, sf_dir):
    return rows(spark, sf_dir).select("vec_id", L.knee_k(F.col(S), KNEE, 4, 24).cast("long").alias("token_k"))


@query("softmax", "L2", f"WITH {ROWS_SQL} SELECT vec_id, i, round(exp(s / 2 - m) / sum(exp(s / 2 - m)) OVER (PARTITION BY vec_id), 6) AS p FROM (SELECT *, max(s / 2) OVER (PARTITION BY vec_id) AS m FROM e)")
def softmax(spark, sf_dir):
    return rows(spark, sf_dir).select("vec_id", F.posexplode(L.softmax(F.col(S), 2.0)).alias("i", "p")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("p", R).alias("p"))


@query("entropy_k", "O7 L3", f"""WITH {ROWS_SQL}, p AS (SELECT vec_id, exp(10 * s - m) / sum(exp(10 * s - m)) OVER (PARTITION BY vec_id) AS p FROM (SELECT *, max(10 * s) OVER (PARTITION BY vec_id) AS m FROM e)),
h AS (SELECT vec_id, -sum(p * ln(greatest(p, 1e-12))) AS h FROM p GROUP BY 1)
SELECT vec_id, round(h, 6) AS entropy, round(1 / (1 + greatest(h, 0)), 6) AS weight, CASE WHEN h < 1 THEN 4 WHEN h < 2.5 THEN 16 ELSE 24 END AS k FROM h""")
def entropy_k(spark, sf_dir):
    t = rows(spark, sf_dir).select("vec_id", L.entropy(F.col(S), 0.1).alias("h"))
    return t.select("vec_id", F.round("h", R).alias("entropy"), F.round(L.entropy_weight(F.col("h")), R).alias("weight"), L.entropy_k(F.col("h"), 16, 24).alias("k"))


@query("kl_union", "L4 U4 A21", f"WITH {ROWS_SQL} SELECT vec_id, round(loss, 6) AS loss, round(forward, 6) AS forward FROM {kl_sql('SELECT vec_id, s, r FROM k WHERE ns <= 8 OR nr <= 8', 2.0)}")
def kl_union(spark, sf_dir):
    return rows(spark, sf_dir).select("vec_id", F.round(L.top_divergence(F.col(S), F.col(REF), 8, 2.0), R).alias("loss"), F.round(L.top_divergence(F.col(S), F.col(REF), 8, 2.0, "forward"), R).alias("forward"))


@query("sparse_kl", "L5 J13", f"""WITH {ROWS_SQL}, f AS (SELECT vec_id, min(r) FILTER (WHERE nr <= 8) - 5.0 AS f FROM k GROUP BY 1)
SELECT vec_id, round(loss, 6) AS loss FROM {kl_sql('SELECT k.vec_id, s, CASE WHEN nr <= 8 THEN r ELSE f END AS r FROM k JOIN f ON k.vec_id = f.vec_id WHERE ns <= 8 OR nr <= 8', 2.0)}""")
def sparse_kl(spark, sf_dir):
    return rows(spark, sf_dir).select("vec_id", F.round(L.sparse_divergence(F.col(S), L.top_k(F.col(REF), 8), 8, 5.0, 2.0), R).alias("loss"))


@query("informative_filter", "L6", f"""WITH {ROWS_SQL}, p AS (SELECT *, exp(s - ms) / sum(exp(s - ms)) OVER w AS ps, exp(r - mr) / sum(exp(r - mr)) OVER w AS pr FROM (SELECT *, max(s) OVER w AS ms, max(r) OVER w AS mr FROM k WINDOW w AS (PARTITION BY vec_id)) WINDOW w AS (PARTITION BY vec_id))
SELECT vec_id, count(*) FILTER (WHERE ps > 0.0175 OR pr > 0.0175) AS kept, round(min(s) FILTER (WHERE ps > 0.0175 OR pr > 0.0175) - 5.0, 6) AS floor FROM p GROUP BY 1 HAVING count(*) FILTER (WHERE ps > 0.0175 OR pr > 0.0175) < 64""")
def informative_filter(spark, sf_dir):
    t = rows(spark, sf_dir).select("vec_id", "student", L.informative(F.col(S), F.col(REF), 0.0175, 5.0)["student"].alias("s"))
    kept = F.size(F.filter(F.zip_with("student", "s", lambda a, b: a == b), lambda x: x)).cast("long")
    return t.select("vec_id", kept.alias("kept"), F.round(F.array_min("s"), R).alias("floor")).filter("kept < 64")


@query("pairwise_kl", "L7 L8", f"""WITH {ROWS_SQL},
a AS (SELECT x.vec_id, x.s - y.s AS s, x.r - y.r AS r FROM k x JOIN k y ON x.vec_id = y.vec_id AND x.nr <= 6 AND y.nr <= 6 AND x.nr < y.nr),
b AS (SELECT x.vec_id, x.s - y.s AS s, x.r - y.r AS r FROM k x JOIN k y ON x.vec_id = y.vec_id AND x.ns <= 6 AND y.ns <= 6 AND x.ns < y.ns)
SELECT p.vec_id, round(p.forward + q.forward, 6) AS loss FROM {kl_sql('SELECT * FROM a', 2.0)} p JOIN {kl_sql('SELECT * FROM b', 2.0)} q ON p.vec_id = q.vec_id""")
def pairwise_kl(spark, sf_dir):
    return rows(spark, sf_dir).select("vec_id", F.round(L.pairwise_divergence(F.col(S), F.col(REF), 6, 2.0), R).alias("loss"))


@query("cross_entropy", "L9 W6", f"WITH {ROWS_SQL} SELECT vec_id, CASE WHEN label > 0 THEN round(ln(sum(exp(s))) - max(s) FILTER (WHERE i = label), 6) END AS loss FROM e GROUP BY vec_id, label")
def cross_entropy(spark, sf_dir):
    label = F.when(F.col("label") > 0, F.col("label")).otherwise(-100)
    return rows(spark, sf_dir).select("vec_id", F.round(L.cross_entropy(F.col(S), label), R).alias("loss"))


@query("suffix_align", "L10 L13", f"WITH {ROWS_SQL} SELECT vec_id, i - 10 + (vec_id % 7) AS pos, round(s, 6) AS val FROM e WHERE i >= 10 AND i - 10 + (vec_id % 7) < 50")
def suffix_align(spark, sf_dir):
    t = rows(spark, sf_dir).select("vec_id", F.posexplode("student").alias("i", "val"))
    t = t.select("vec_id", L.suffix_positions(F.col("i"), F.lit(10), F.col("vec_id") % 7).cast("long").alias("pos"), F.round("val", R).alias("val"))
    return t.filter("pos is not null and pos < 50")


@query("vocab_remap", "L11", f"WITH {ROWS_SQL} SELECT vec_id, count(*) FILTER (WHERE i < 48) AS kept, CAST(coalesce(sum(i) FILTER (WHERE i < 48), 0) AS BIGINT) AS index_sum FROM k WHERE ns <= 8 GROUP BY 1")
def vocab_remap(spark, sf_dir):
    t = rows(spark, sf_dir).select("vec_id", L.remap(L.top_k(F.col(S), 8), 48).alias("m"))
    return t.select("vec_id", F.size("m").cast("long").alias("kept"), F.aggregate("m", F.lit(0).cast("long"), lambda a, e: a + e["idx"]).alias("index_sum"))


@query("first_mismatch", "W7 V5", """WITH t AS (SELECT conv_id, turn, string_split(text, '') AS a, string_split(coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), '') AS b FROM conversations),
m AS (SELECT conv_id, turn, a, b, list_filter(range(0, least(len(a), len(b))), lambda i: a[i + 1] <> b[i + 1]) AS d FROM t)
SELECT conv_id, turn, CASE WHEN len(d) > 0 THEN d[1] WHEN len(a) <> len(b) THEN least(len(a), len(b)) END AS at FROM m WHERE len(b) > 1""")
def first_mismatch(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = V.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", "").alias("a"), F.split(F.coalesce(F.lead("text").over(w), F.lit("")), "").alias("b"))
    return t.filter(F.size("b") > 1).select("conv_id", "turn", L.first_mismatch(F.col("a"), F.col("b")).alias("at"))


@query("early_stop", "W5 T3", """WITH RECURSIVE x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT event_type, CAST(1 AS BIGINT) AS n, value AS best, 0 AS bad, CAST(NULL AS BIGINT) AS stopped_at FROM x WHERE n = 1
  UNION ALL SELECT f.event_type, x.n, CASE WHEN x.value < f.best - 0.01 THEN x.value ELSE f.best END, CASE WHEN x.value < f.best - 0.01 THEN 0 ELSE f.bad + 1 END,
  CASE WHEN x.value >= f.best - 0.01 AND f.bad + 1 >= 40 THEN x.n END FROM f JOIN x ON x.event_type = f.event_type AND x.n = f.n + 1 WHERE f.stopped_at IS NULL)
SELECT event_type, round(arg_max(best, n), 6) AS best, arg_max(bad, n) AS bad, max(stopped_at) AS stopped_at FROM f GROUP BY 1""")
def early_stop(spark, sf_dir):
    x = series.early_stops(V.table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value", 40, 0.01)
    return x.select("event_type", F.round("best", R).alias("best"), "bad", "stopped_at")
