"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Each rule rejects a text whose feature is above a cutoff. For every stratum, rule and cutoff of a fixed grid, labelled
good documents tell how many the rule would reject; an exact binomial test says whether a false rejection rate of
``alpha`` or more can be ruled out. The cutoffs of a rule are tested from lenient to strict up to the first that fails,
so they share one level, and only strata and rules divide ``delta`` (Bonferroni). A stricter cutoff rejects what a more
lenient one does and more, so p-values grow along the grid and those that pass are those before the first failure.
The strictest cutoff that passes and whose rejections are mostly of bad documents is used; a stratum or rule without
one rejects nothing. The rate is shared out among the rules, so all rules together reject at most ``alpha`` of the good
documents of a stratum, with probability 1 - ``delta`` for all strata at once. Copies of a text are no independent
trials, so each distinct text of a stratum counts once; the rate is one of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, table, words_of, written

#: Rule to its grid of cutoffs, most lenient last.
GRID = {
    "symbols_per_word": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0],
    "dup_line_share": [0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9],
    "repeat_share": [0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.42, 0.44, 0.46, 0.48],
    "long_words": [6.0, 6.5, 7.0, 7.5, 8.0, 8.5, 9.0, 10.0, 11.0, 12.0, 14.0, 17.0, 20.0],
    "short_words": [0.2, 0.22, 0.24, 0.26, 0.28, 0.3, 0.33, 0.37, 0.4, 0.45, 0.5, 0.6, 0.8],
}
#: Most of the good documents of a stratum that may be rejected, and the chance that this is exceeded anywhere.
ALPHA, DELTA = 0.05, 0.05
#: Least share of bad documents among the labelled ones that a cutoff rejects.
PRECISION = 0.5
BROADCAST_STRATA = 100_000


def repeat_words(words: Column) -> Column:
    """Number of words that lie in a window of three words found twice or more."""

    def spread(win: Column) -> Column:
        by_hash = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda j, h: F.coalesce(F.get(s, j)["h"] == h, F.lit(False))
            marked = F.transform(s, lambda e, j: F.when(same(j - 1, e["h"]) | same(j + 1, e["h"]), e["i"]))
            return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))

        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        add = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
        return F.aggregate(let(by_hash, twice), start, add, lambda a: a["n"])

    def count(hashed: Column) -> Column:
        n = F.size(hashed)
        all_windows = F.transform(hashed, lambda h, i: F.xxhash64(h, F.get(hashed, i + 1), F.get(hashed, i + 2)))
        windows = F.slice(all_windows, F.lit(1), F.greatest(n - 2, F.lit(0)))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(spread(w)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), count)


def measured(text: Column) -> Column:
    """Struct of the counts of a text; null text: all 0."""
    text = F.coalesce(text, F.lit(""))
    gaps = " \t\n\x0b\x0c\r"
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, gaps, "") != "")
    counted = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    return F.struct(
        counted.alias("c"),
        line.alias("line"),
        F.length(F.translate(text, gaps, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(doc_id, stratum, text_key, the counts, base_failed): one row a row of ``docs``; texts end here."""
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    m = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("stratum"), key.alias("text_key"), measured(F.col(text_col)).alias("m"))
    m = m.select("doc_id", "stratum", "text_key", "m.c.n_words", "m.word_chars", "m.n_symbols", F.col("m.line.dup").alias("n_dup_lines"), F.col("m.c.n_repeat_words").alias("n_repeat_words"), F.col("m.line.n").alias("n_lines"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return m.withColumn("base_failed", failed)


def rule_values() -> dict[str, Column]:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbols_per_word": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "long_words": share("word_chars", "n_words"),
        "short_words": share("n_words", "word_chars"),
    }


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial (n, p), exactly summed in logarithms; 1 where k >= n * p, as no test passes there."""
    odds = F.ln(F.lit(p / (1 - p)))
    start = F.struct((n * F.ln(F.lit(1 - p))).alias("term"), (n * F.ln(F.lit(1 - p))).alias("sum"))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] + F.ln((n - i + 1) / i) + odds
        top = F.greatest(term, a["sum"])
        return F.struct(term.alias("term"), (top + F.ln(F.exp(term - top) + F.exp(a["sum"] - top))).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(F.aggregate(steps, start, add, lambda a: a["sum"])))


def thresholds(measured_rows: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, precision: float = PRECISION) -> DataFrame:
    """(stratum, cutoffs: map of rule to cutoff), from labelled rows (doc_id, quality) joined with their counts.

    A text of a stratum is one trial, bad if any of its labels says so; rows without text_key are texts of their own.
    """
    good = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = written(good, "quality-labels")  # one row a document, so the other side may be split where rows repeat
    held = measured_rows.filter(~F.col("base_failed")).join(good, "doc_id")
    # cell: how many cutoffs of the grid are below the value
    cell = lambda v, grid: sum(((v > F.lit(g)).cast("int") for g in grid), F.lit(0))
    cells = F.array(*[F.struct(F.lit(r).alias("rule"), cell(v, GRID[r]).alias("cell")) for r, v in rule_values().items()])
    if "text_key" in held.columns:
        texts = held.groupBy("stratum", "text_key").agg(F.min("quality").alias("quality"), F.first(cells).alias("cells"))
    else:
        texts = held.select("stratum", "quality", cells.alias("cells"))
    counts = (
        texts.select("stratum", "quality", F.explode("cells").alias("x"))
        .groupBy("stratum", "x.rule", "x.cell")
        .agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("bad"))
    )
    strata = counts.agg(F.count_distinct(F.coalesce(F.concat(F.lit("="), F.col("stratum").cast("string")), F.lit("")))).first()[0]
    tests = max(1, strata * len(GRID))  # one sequence of nested cutoffs each
    grid = F.create_map(*[x for r, g in GRID.items() for x in (F.lit(r), F.array(*[F.lit(c) for c in g]))])
    # one row for each stratum and rule: the counts by cell, at most one for each cutoff and one more
    per_rule = counts.groupBy("stratum", "rule").agg(F.collect_list(F.struct("cell", "good", "bad")).alias("cells"), F.sum("good").alias("n"))
    at = per_rule.select("stratum", "rule", "n", "cells", F.posexplode(grid[F.col("rule")]).alias("nth", "cutoff"))
    above = lambda what: F.aggregate(F.filter("cells", lambda c: c["cell"] > F.col("nth")), F.lit(0).cast("long"), lambda a, c: a + c[what])
    at = at.withColumn("lost", above("good")).withColumn("caught", above("bad"))
    sure = binomial_cdf(F.col("lost"), F.col("n"), alpha / len(GRID)) <= delta / tests
    useful = (F.col("caught") > 0) & (F.col("caught") >= precision * (F.col("caught") + F.col("lost")))
    best = at.filter(sure & useful).groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **risk) -> DataFrame:
    """One row a row of ``docs``: doc_id, the counts, base_failed, kept.

    Null or empty text: all counts 0, so base_failed. A null stratum is one of its own. A document labelled more than
    once counts as bad if any label says so; unlabelled strata and an empty label table reject by the base rules only.
    Repeated rows are judged alike. An empty table gives no rows. Other columns are dropped.
    """
    rows = written(features(docs, id_col, text_col, stratum_col), "quality-features")
    cut = written(thresholds(rows, labels.select("doc_id", "quality"), **risk).withColumnRenamed("stratum", "of"), "quality-cutoffs")
    small = cut.count() <= BROADCAST_STRATA
    out = rows.join(F.broadcast(cut) if small else cut, F.col("stratum").eqNullSafe(F.col("of")), "left")
    over = F.lit(False)
    for rule, value in rule_values().items():
        over = over | F.coalesce(value > F.element_at("cutoffs", F.lit(rule)), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~over).alias("kept"))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    return quality_filter(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
