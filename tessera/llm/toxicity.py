"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed character 4- and 5-grams that a text holds at least once. The fit takes a bounded sample of
labelled rows (``SAMPLE`` of each label at most, those with the smallest hashes of their ids), counts documents by
feature and label on the executors, keeps the features that tell the labels apart, scales each by its log-count ratio and fits a
logistic regression on them; row weights restore the share of toxic rows among all training rows. Scoring reads whole
texts, one after the other, and holds one text at a time.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, table, written

#: Most rows of each label that the fit uses.
SAMPLE = 3000
SIZES, BITS = (4, 5), 20
#: A feature is kept if its share among toxic and other rows differs by so many standard errors; so many are kept at most.
LEAST_Z, FEATURES = 3.0, 8192
PENALTY, STEPS, RATE = 1e-3, 300, 0.03
#: Texts are hashed in blocks of so many characters, which overlap so that no n-gram is lost.
BLOCK = 1 << 20
THRESHOLD = 0.3


def hashed(text: str):
    """Feature numbers of all n-grams of the text with a blank at either end, block by block."""
    import numpy as np

    text = f" {text.lower()} "
    for at in range(0, len(text), BLOCK):
        block = text[at : at + BLOCK + max(SIZES) - 1]
        code = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        for n in SIZES:
            size = min(len(code) - n + 1, BLOCK)  # n-grams that begin beyond the block belong to the next one
            if size <= 0:
                continue
            h = np.full(size, n, np.uint64)
            for j in range(n):
                h = (h + code[j : j + size]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
            yield (h >> np.uint64(64 - BITS)).astype(np.int32)


def featured(text: str):
    """Distinct feature numbers of a text, ascending; at most 2**BITS are held beside a block."""
    import numpy as np

    out = np.zeros(0, np.int32)
    for part in hashed(text):
        out = np.union1d(out, part)
    return out


def held_out(id_col: Column) -> Column:
    """Whether the row is kept from training: crc32 of the id as text, mod 4, is 2; null id: no."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def counted(batches):
    """Documents by feature and label: (feature, toxic ones, others), summed up for each batch."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        n = np.zeros((2, 1 << BITS), np.int32)
        for label, f in zip(batch.column(0).to_pylist(), batch.column(1)):
            n[label][np.frombuffer(f.as_py(), np.int32)] += 1
        some = np.flatnonzero(n.any(0)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[1][some]), pa.array(n[0][some])], names=["feature", "p", "q"])


def fit(rows: list[tuple[object, int]], kept, p, q, toxic_share: float):
    """(feature weights of length 2**BITS, bias) from (features among the kept ones, label) rows and the kept ones' counts."""
    import numpy as np

    weights = np.zeros(1 << BITS, np.float32)
    y = np.array([r[1] for r in rows], float)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    share = min(max(toxic_share, 1e-6), 1 - 1e-6)
    bias = float(np.log(share / (1 - share)))
    if not n1 or not n0 or not len(kept):
        return weights, bias
    ratio = np.log((p + 1) / (n1 + 2)) - np.log((q + 1) / (n0 + 2))
    cols = [np.searchsorted(kept, f) for f, _ in rows]
    row, col = np.repeat(np.arange(len(rows)), [len(c) for c in cols]), np.concatenate(cols)
    value = ratio[col]
    each = np.where(y == 1, share * len(y) / n1, (1 - share) * len(y) / n0) / len(y)
    w = np.zeros(len(kept) + 1)
    w[-1] = bias
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        s = np.bincount(row, value * w[col], minlength=len(y)) + w[-1]
        e = each * (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y)
        g = np.append(np.bincount(col, value * e[row], minlength=len(kept)) + PENALTY * w[:-1], e.sum())
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        w -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    weights[kept] = ratio * w[:-1]
    return weights, float(w[-1])


@functools.lru_cache(maxsize=2)
def _table(features: bytes, values: bytes):
    import numpy as np

    weights = np.zeros(1 << BITS, np.float32)
    weights[np.frombuffer(features, np.int32)] = np.frombuffer(values, np.float32)
    return weights


class Model:
    """A fitted classifier: at most ``FEATURES`` weights and a bias, small enough for every task."""

    def __init__(self, weights, bias: float):
        import numpy as np

        kept = np.flatnonzero(weights).astype(np.int32)
        self.features, self.values, self.bias = kept.tobytes(), weights[kept].astype(np.float32).tobytes(), bias

    def score(self, text: str | None) -> float:
        """Probability of the toxic label; null text: as empty, the share that the bias stands for."""
        import numpy as np

        weights = _table(self.features, self.values)
        hits = [np.unique(f[weights[f] != 0]) for f in hashed(text or "")]
        hit = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int32)
        s = float(weights[hit].astype(np.float64).sum()) + self.bias
        return float(1 / (1 + np.exp(-min(max(s, -30.0), 30.0))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from the labelled rows of ``docs`` that are not held out.

    A document labelled more than once is toxic if any label says so; of rows with equal ids the smallest text counts;
    null labels and ids are skipped, null texts are empty. Without rows of both labels the score is the share of toxic rows for every text.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    known = known.join(docs.select(F.col(id_col).alias("id")).filter(F.col("id").isNotNull()).distinct(), "id")
    labelled = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64("id")
    # at most `sample` rows of either label, so the broadcast is bounded
    chosen = known.filter("label = 1").orderBy(order, "id").limit(sample).unionByName(known.filter("label = 0").orderBy(order, "id").limit(sample))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id", "label").agg(F.min("text").alias("text"))

    import numpy as np

    def make(batches):
        import pyarrow as pa

        for batch in batches:
            made = [featured(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["label", "features"])

    rows = written(map_arrow(texts.select("label", "text"), make, "label int, features binary"), "toxicity-sample")
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    p, q = F.col("p"), F.col("q")
    spread = F.sqrt((p + q) / float(max(1, n1 + n0)) * (1 / max(1, n1) + 1 / max(1, n0)))
    z = F.abs(p / float(max(1, n1)) - q / float(max(1, n0))) / spread
    counts = map_arrow(rows, counted, "feature int, p int, q int").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    top = counts.withColumn("z", z).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(FEATURES).collect()
    top.sort(key=lambda r: r.feature)
    kept = np.array([r.feature for r in top], np.int32)
    known_features = kept.tobytes()

    def reduced(batches):
        import pyarrow as pa

        wanted = np.frombuffer(known_features, np.int32)
        for batch in batches:
            made = [np.intersect1d(np.frombuffer(f.as_py(), np.int32), wanted, assume_unique=True).tobytes() for f in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["label", "features"])

    got = map_arrow(rows, reduced, "label int, features binary").collect()
    data = sorted((bytes(r.features), r.label) for r in got)
    total = sum(labelled.values())
    share = labelled.get(1, 0) / total if total else 0.0
    return Model(*fit([(np.frombuffer(f, np.int32), label) for f, label in data], kept, np.array([r.p for r in top], float), np.array([r.q for r in top], float), share))


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` with a score from 0 to 1; a column of that name is replaced, all others stay."""
    own = docs.drop(score_col)
    at = own.columns.index(text_col)
    fields = own.schema.fields

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            scores = pa.array([model.score(t.as_py()) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, score_col])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return map_arrow(own, run, StructType([*fields, StructField(score_col, DoubleType())]))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **columns) -> DataFrame:
    """``docs`` without those that the classifier rejects."""
    out = scored(docs, train(docs, labels, **columns), score_col="__toxicity")
    return out.filter(F.col("__toxicity") < threshold).drop("__toxicity")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = _digest(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _digest(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): texts do not come back from the workers."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")
