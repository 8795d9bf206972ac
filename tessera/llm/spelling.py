"""Spelling variants: words that differ by one letter, grouped under the most frequent form.

Of two words with one error one half agrees exactly. Each word goes to the tasks of both halves, once for each length
that the shorter word of a pair may have. A task holds the minimal acyclic automaton of its words, forward for first
halves and backward for second ones, follows the exact half of each word and completes the rest with one error; the
perfect-hash number of what it reads tells the word. A pair that agrees in its first half is not reported by the second
one, so every link comes once. A half that too many words share is halved again: one half of what is left
agrees as well, until a group fits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.acyclic import Acyclic
from tessera.llm.common import drop, map_arrow, table, written

#: Letters of a word, and the shortest word.
RUN, SHORTEST = "[A-Za-zÀ-ÿ]{%d,}", 7
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least occurrences of a word, and how many times as frequent as a word its form is.
OCCURRENCES, RATIO = 2, 10
#: One run in so many loses a letter, told by the hash of its document and itself.
DAMAGED = 31
#: A half that more words share is halved again. What is left at last is one letter, so with 126 letters 16,002 words.
GROUP = 50_000
#: Words that one automaton holds beside a last whole group.
CHUNK = 20_000
#: At most so many keys of large groups are broadcast; beyond that they are joined by a shuffle.
BROADCAST_KEYS = 100_000


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word): every run of letters of ``SHORTEST`` or more, A-Z lower-cased, one in ``DAMAGED`` without one letter.

    Null text: none. A null id hashes as an empty one. Whole texts; other columns are dropped.
    """
    found = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN % SHORTEST), F.lit(0)))
    run = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), found.alias("run")).select("id", F.translate("run", CAPITALS, SMALL).alias("run"))
    hashed = run.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.col("h") % F.length("run")
    cut = F.concat(F.substr("run", F.lit(1), at.cast("int")), F.substr("run", (at + 2).cast("int")))
    return hashed.select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= SHORTEST)


def vocabulary(words: DataFrame, least: int = OCCURRENCES) -> DataFrame:
    """(word, n): distinct words that occur ``least`` times or more; counted before they are shuffled."""
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def routed(words: DataFrame) -> DataFrame:
    """(word, n, short, path, lo, hi, key): a row for each length of the shorter word and each half.

    ``short`` is the length of the shorter word of a pair, ``lo`` to ``hi`` the part of it that holds the error, ``path``
    the halvings that led there: L where the left half agrees, R where the right one does and the left does not.
    """
    shorts = F.filter(F.array(F.length("word"), F.length("word") - 1), lambda k: k >= SHORTEST)
    whole = words.select("word", "n", F.explode(shorts).alias("short")).withColumn("path", F.lit("")).withColumn("lo", F.lit(0)).withColumn("hi", F.col("short"))
    return halved(whole)


def halved(rows: DataFrame) -> DataFrame:
    """Each row twice: the left half of its part agrees, or the right half."""
    mid = F.expr("lo + (hi - lo) div 2").cast("int")
    sides = F.array(
        F.struct(F.concat("path", F.lit("L")).alias("path"), mid.alias("lo"), F.col("hi").alias("hi")),
        F.struct(F.concat("path", F.lit("R")).alias("path"), F.col("lo").alias("lo"), mid.alias("hi")),
    )
    out = rows.select("word", "n", "short", F.explode(sides).alias("side")).select("word", "n", "short", "side.*")
    behind = F.col("hi") + 1 + (F.length("word") - F.col("short"))
    key = F.concat_ws(" ", "short", "path", F.substr("word", F.lit(1), F.col("lo")), F.substr("word", behind))
    return out.withColumn("key", key)


def grouped(words: DataFrame, group: int = GROUP) -> DataFrame:
    """Routes in groups of at most ``group`` words where halving allows it; a group is the rows of a key."""
    done, rows = [], written(routed(words), "spelling-routes")
    while True:
        large = written(rows.groupBy("key").agg(F.count("*").alias("size"), F.max(F.col("hi") - F.col("lo")).alias("open")).filter((F.col("size") > group) & (F.col("open") > 1)).select("key"), "spelling-large")
        n = large.count()
        if not n:
            drop(large)
            return union([*done, rows])
        keys = F.broadcast(large) if n <= BROADCAST_KEYS else large
        done.append(rows.join(keys, "key", "left_anti").select(rows.columns))
        rows = written(halved(rows.join(keys, "key", "left_semi").drop("key")), "spelling-routes")


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def belongs(a: str, b: str, short: int, path: str) -> bool:
    """Whether the halvings of ``path`` are those of the pair: the left half wherever it agrees, else the right one."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) != short:
        return False
    more, lo, hi = len(b) - short, 0, short
    for step in path:
        mid = lo + (hi - lo) // 2
        left = a[lo:mid] == b[lo:mid]
        if left != (step == "L"):
            return False
        if left:
            lo = mid
        elif a[mid:hi] == b[mid + more : hi + more]:
            hi = mid
        else:
            return False
    return True


def links_of(rows: list[tuple[str, int, int, str]], backward: bool):
    """(word, near word, its n) of rows (word, n, short, path) whose paths begin with the same half."""
    turned = (lambda w: w[::-1]) if backward else (lambda w: w)
    counts = {turned(word): n for word, n, _, _ in rows}
    words = sorted(counts)
    known = Acyclic(words)
    for word, _, short, path in rows:
        exact = short - short // 2 if backward else short // 2
        equal = len(word) == short
        for number in known.one_error(turned(word), exact, equal, equal, not equal):
            found = words[number]
            other = turned(found)
            if belongs(word, other, short, path):
                yield word, other, counts[found]


def near(words: DataFrame, group: int = GROUP, chunk: int = CHUNK) -> DataFrame:
    """(word, near, near_n): each pair of words with exactly one error, in both orders, once.

    ``words`` has a row (word, n) for each distinct word; words shorter than ``SHORTEST`` have no links.
    """
    backward = F.substring("path", 1, 1) == "R"
    rows = grouped(words.filter(F.length("word") >= SHORTEST), group).select("word", "n", "short", "path", backward.alias("backward"), "key")
    rows = rows.repartition("key").sortWithinPartitions("backward", "key")

    def run(batches):
        import pyarrow as pa

        def pairs(held, backward):
            made = list(links_of(held, backward))
            for at in range(0, len(made), 10_000):
                word, other, n = zip(*made[at : at + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(other, pa.string()), pa.array(n, pa.int64())], names=["word", "near", "near_n"])

        held, last = [], None
        for batch in batches:
            for word, n, short, path, backward, key in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None and (last[0] != backward or (last[1] != key and len(held) >= chunk)):
                    yield from pairs(held, last[0])
                    held = []
                held.append((word, n, short, path))
                last = backward, key
        if held:
            yield from pairs(held, last[0])

    return map_arrow(rows, run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of the chain of forms of each word that has one.

    Each form is ``RATIO`` times as frequent as its word, so a chain of counts below 2**63 has fewer than 20 steps, and
    five doublings reach its end.
    """
    at = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        drop(at)
        at = new
        if at.filter("moved").isEmpty():
            return at.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, group: int = GROUP, chunk: int = CHUNK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n).

    The form of a word is its most frequent near word, of equal ones the smallest, if that is ``ratio`` times as frequent;
    else null. The root follows forms to the last; a word without a form is its own. An empty vocabulary gives no rows.
    """
    words = written(words.select("word", "n"), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    about = near(words, group, chunk).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    form = F.coalesce(-F.col("best.n") >= F.try_multiply(F.lit(ratio).cast("long"), "n"), F.lit(False))
    out = words.join(about, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("best.word")).alias("form"), F.when(form, -F.col("best.n")).alias("form_n"))
    out = written(out, "spelling-forms")
    ends = roots(out.filter(F.col("form").isNotNull()))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(vocabulary(runs(table(spark, sf_dir, "documents"))))
