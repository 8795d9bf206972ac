"""Quality classifier: a sparse ensemble of rules over statistics of a text, as one Spark column.

Shallow trees are grown on the statistics of a bounded sample of labelled rows; every path from a root to a node is a
rule, a conjunction of bounds. A logistic regression with an L1 penalty weighs the rules and drops most of them. What is
left compiles into a column: the logistic function of the sum of the weights of the rules that hold. Scoring is one
pass of expressions over whole texts, without a shuffle and without a Python worker.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, table, words_of, written
from tessera.llm.toxicity import held_out

#: Expected number of rows of each label in the sample that the fit uses; all rows where there are no more.
SAMPLE = 3000
TREES, DEPTH, SEED = 20, 3, 13
#: Weight of the L1 penalty on the rules, and most rules that the lasso chooses from, the widest first.
PENALTY, RULES = 0.002, 400
THRESHOLD = 0.7
#: Partitions of the sample: it is small, and each step of a fit is a job.
PARTS = 4

GAPS = " \t\n\x0b\x0c\r"
MARKS = "#*$%&|<>"


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def statistics(text: Column) -> Column:
    """Struct of the statistics of a text, all of them numbers; null or empty text: all 0."""
    text = F.coalesce(text, F.lit(""))
    share = lambda a, b: a / F.greatest(b, F.lit(1))
    taken = lambda t, characters: F.length(t) - F.length(without(t, characters))

    def of_words(w: Column) -> Column:
        n = F.size(w)
        repeated = F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False))))
        closed = F.size(F.filter(w, lambda x: F.right(x, F.lit(1)).isin(*"!#*$%&|<>")))
        return F.struct(n.cast("double").alias("words"), share(F.size(F.array_distinct(w)), n).alias("distinct_words"), share(repeated, n).alias("adjacent_words"),
                        share(closed, n).alias("marked_words"), share(F.size(F.filter(w, lambda x: F.length(x) == 1)), n).alias("single_letters"))

    def of_lines(x: Column) -> Column:
        n = F.size(x)
        marked = F.coalesce(F.array_max(F.transform(x, lambda s: share(taken(s, MARKS + "!"), F.length(s)))), F.lit(0.0))
        return F.struct(n.cast("double").alias("lines"), share(F.size(F.array_distinct(x)), n).alias("distinct_lines"), marked.alias("worst_line"))

    length = F.length(text)
    lines = F.filter(F.split(text, "\n"), lambda s: without(s, GAPS) != "")
    parts = F.struct(
        let(words_of(text), of_words).alias("w"), let(lines, of_lines).alias("l"), length.cast("double").alias("n"), F.length(without(text, GAPS)).cast("double").alias("solid"),
        taken(text, MARKS).alias("marks"), taken(text, "!").alias("shouts"), taken(text, "0123456789").alias("digits"), taken(text, ".,;:?").alias("stops"),
        F.length(F.regexp_replace(text, r"\P{Lu}+", "")).alias("capitals"),
    )
    return let(parts, lambda p: F.struct(
        p["n"].alias("characters"), *(p["w"][c].alias(c) for c in ("words", "distinct_words", "adjacent_words", "marked_words", "single_letters")),
        *(p["l"][c].alias(c) for c in ("lines", "distinct_lines", "worst_line")), share(p["solid"], p["w"]["words"]).alias("word_length"),
        share(p["w"]["words"], p["l"]["lines"]).alias("line_words"), *(share(p[c], p["solid"]).alias(c) for c in ("marks", "shouts", "digits", "stops", "capitals")),
    ))


NAMES = (
    "characters", "words", "distinct_words", "adjacent_words", "marked_words", "single_letters", "lines", "distinct_lines", "worst_line", "word_length", "line_words",
    "marks", "shouts", "digits", "stops", "capitals",
)


@dataclass(frozen=True)
class Rule:
    """A conjunction: for some statistics, (name, above or not, bound), in the order of the names, each side at most once."""

    bounds: tuple[tuple[str, bool, float], ...]

    def holds(self, stats: Column) -> Column:
        out = None
        for name, above, bound in self.bounds:
            one = stats[name] > bound if above else stats[name] <= bound
            out = one if out is None else out & one
        return out

    def __str__(self) -> str:
        return " and ".join(f"{name} {'>' if above else '<='} {bound:.6g}" for name, above, bound in self.bounds)


def tightest(bounds) -> Rule:
    """The rule of a path; of several bounds of one side of a statistic only the tightest says anything."""
    kept: dict[tuple[str, bool], float] = {}
    for name, above, bound in bounds:
        old = kept.get((name, above))
        kept[name, above] = bound if old is None else max(old, bound) if above else min(old, bound)
    return Rule(tuple((name, above, bound) for (name, above), bound in sorted(kept.items())))


BRANCH = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def paths(described: str, names=NAMES) -> list[Rule]:
    """The rules of a tree, one for each node but the root, from its description: nested lines with a test each."""
    out, path = [], []
    for line in described.splitlines():
        m = BRANCH.match(line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, (names[int(m[2])], m[3] == ">", float(m[4])))]
        out.append(tightest(test for _, test in path))
    return out


@dataclass(frozen=True)
class Model:
    """Weighted rules and a bias: some hundred numbers, whatever the corpus."""

    weights: tuple[tuple[Rule, float], ...]
    bias: float

    def score(self, stats: Column) -> Column:
        """Probability of label 1 for a struct of ``statistics``."""
        total = F.lit(self.bias)
        for rule, weight in self.weights:
            total = total + F.when(rule.holds(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[DataFrame, float]:
    """((label, stats) of the sampled rows, share of label 1 among all training rows).

    The sample takes the rows of a label whose id hash lies below a bound, which the number of its rows sets.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    n = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("label") == 1, sample / max(n.get(1, 0), sample)).otherwise(sample / max(n.get(0, 0), sample))
    chosen = F.broadcast(known.filter(draw < rate))  # about two times `sample` rows
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(chosen, "id")
    rows = texts.select("label", "id", statistics(F.col("text")).alias("stats"))
    rows = rows.groupBy("id", "label").agg(F.min("stats").alias("stats")).select("label", "stats")
    total = sum(n.values())
    return rows, n.get(1, 0) / total if total else 0.0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, penalty: float = PENALTY) -> Model:
    """A model from the labelled rows of ``docs`` that are not held out.

    A document labelled more than once is of label 0 if any label says so; of rows with equal ids the smallest
    statistics count; null ids and labels are skipped, null texts are empty. Without rows of both labels no rule is
    fitted, and the score of every text is the share of label 1.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows, share = sampled(docs, labels, id_col, text_col, label_col, sample)
    vector = array_to_vector(F.array(*(F.col("stats")[c] for c in NAMES)))
    rows = written(rows.select("label", "stats").coalesce(PARTS), "quality-sample")
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    bounded = min(max(share, 1e-6), 1 - 1e-6)
    prior = math.log(bounded / (1 - bounded))
    if not (sizes.get(0) and sizes.get(1)):
        return Model((), prior)
    # row weights bring the sample back to the shares of the labels
    weight = F.when(F.col("label") == 1, share / sizes[1]).otherwise((1 - share) / sizes[0]) * sum(sizes.values())
    even = F.when(F.col("label") == 1, 0.5 / sizes[1]).otherwise(0.5 / sizes[0]) * sum(sizes.values())
    label = F.col("label").cast("double").alias("label")
    forest = RandomForestClassifier(labelCol="label", featuresCol="x", weightCol="even", numTrees=TREES, maxDepth=DEPTH, subsamplingRate=0.5, featureSubsetStrategy="onethird", minInstancesPerNode=5, seed=SEED)
    grown = forest.fit(rows.select(label, vector.alias("x"), even.alias("even")))
    rules = sorted({r for tree in grown.trees for r in paths(tree.toDebugString)}, key=lambda r: (len(r.bounds), str(r), r.bounds))[:RULES]
    if not rules:
        return Model((), prior)
    held = array_to_vector(F.array(*(r.holds(F.col("stats")).cast("double") for r in rules)))
    lasso = LogisticRegression(labelCol="label", featuresCol="x", weightCol="weight", regParam=penalty, elasticNetParam=1.0, maxIter=60)
    fitted = lasso.fit(rows.select(label, held.alias("x"), weight.alias("weight")))
    weights = fitted.coefficients.toArray()
    return Model(tuple((r, float(w)) for r, w in zip(rules, weights) if w), float(fitted.intercept))


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """``docs`` with a score from 0 to 1; a column of that name is replaced, all others stay.

    Null and empty texts are scored by statistics that are all 0; equal texts score the same; an empty table gives no rows.
    """
    return docs.withColumn(score_col, let(statistics(F.col(text_col)), model.score))


def op13_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")), score_col="score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
