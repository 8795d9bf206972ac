"""Digest of a set of ids as a tree: equal sets have equal roots, and a change is found along one path.

The tree has a node for each prefix of the hex digests of the ids. A leaf hashes its ids in the order of their digests,
a parent the digests of its children; leaves are made where the rows are, and each level is 16 times smaller than
the one below. Nothing depends on the partitioning or on the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids that a leaf holds, about.
LEAF = 1000
FAN = "0123456789abcdef"
TREE = "level int, node string, rows long, digest string"


def depth_of(rows: int) -> int:
    """Levels below the root, so that a leaf has about ``LEAF`` ids."""
    depth = 0
    while 16**depth * LEAF < rows:
        depth += 1
    return depth


def tree(df: DataFrame, id_col: str = "id", depth: int | None = None) -> DataFrame:
    """(level, node, rows, digest) of all nodes; the root is level 0. Null ids count as empty ones, repeated ids each.

    Without a depth the rows are counted first; to compare trees, give them the same depth. No ids: a root of no rows.
    A leaf is an array of its ids, so many rows of one id make a large one; sets have none.
    """
    depth = depth_of(df.count()) if depth is None else depth
    ids = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id")).withColumn("h", F.md5(F.col("id").cast("binary")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("h", "id"))), lambda x: x["id"]), "\n")
    level = ids.groupBy(F.substring("h", 1, depth).alias("node")).agg(F.count("*").alias("rows"), F.sha2(text, 256).alias("digest"))
    out = level.select(F.lit(depth).alias("level"), "node", "rows", "digest")
    for d in range(depth - 1, -1, -1):
        parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "digest"))), lambda x: F.concat(x["node"], F.lit(" "), x["digest"])), "\n")
        level = level.groupBy(F.substring("node", 1, d).alias("node")).agg(F.sum("rows").alias("rows"), F.sha2(parts, 256).alias("digest"))
        out = out.unionByName(level.select(F.lit(d).alias("level"), "node", "rows", "digest"))
    return out


def root(nodes: DataFrame) -> tuple[int, str]:
    """(rows, digest) of a tree; of no ids: 0 and the digest of nothing."""
    r = nodes.filter("level = 0").first()
    return (r.rows, r.digest) if r else (0, "")


def first_difference(left: DataFrame, right: DataFrame) -> list[dict]:
    """The path from the root to the first leaf in which two trees of equal depth differ; empty: they are equal.

    A step reads the children of one node on either side, at most 16 rows each. Each entry of the path has level, node,
    and rows and digest of both sides, 0 and null where a side lacks the node.
    """
    depths = [t.agg(F.max("level")).first()[0] for t in (left, right)]
    if None not in depths and depths[0] != depths[1]:
        raise ValueError("the trees have different depths")
    path, above = [], None
    for level in range((max(d for d in depths if d is not None) if any(d is not None for d in depths) else -1) + 1):
        names = [""] if above is None else [above + c for c in FAN]
        a, b = ({r.node: r for r in t.filter((F.col("level") == level) & F.col("node").isin(names)).collect()} for t in (left, right))
        differ = [n for n in names if (a[n].digest if n in a else None) != (b[n].digest if n in b else None)]
        if not differ:
            return path
        above = differ[0]
        x, y = a.get(above), b.get(above)
        path.append({"level": level, "node": above, "left_rows": x.rows if x else 0, "right_rows": y.rows if y else 0, "left": x.digest if x else None, "right": y.digest if y else None})
    return path


def changed(left: DataFrame, right: DataFrame, path: list[dict], id_col: str = "id") -> DataFrame:
    """(id, side) of the ids of the leaf that the path ends in which one side alone has, left or right."""
    node = path[-1]["node"]

    def own(df: DataFrame, side: str) -> DataFrame:
        ids = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id")).filter(F.substring(F.md5(F.col("id").cast("binary")), 1, len(node)) == node)
        return ids.withColumn("side", F.lit(side))

    both = own(left, "left").unionByName(own(right, "right")).groupBy("id").agg(F.count_if(F.col("side") == "left").alias("l"), F.count_if(F.col("side") == "right").alias("r"))
    return both.filter("l <> r").select("id", F.when(F.col("l") > F.col("r"), "left").otherwise("right").alias("side"))
