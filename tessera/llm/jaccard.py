"""Near-duplicate groups by an exact Jaccard join on five-word shingles, found by signature trees.

1. Classes. Documents with the same set are one node, so copies cost nothing further. A count sketch over all
   documents (fixed size) tells rare shingles from those that many documents share.
2. Routing. A set of n shingles sends its n - ceil(t n) + 1 rarest to the task of their hash. Two sets of similarity t
   or more share one of these (prefix filter), whatever the counts in the sketch say. The members of a shingle, cut
   where sizes leave a gap no link can cross, form a bucket; equal buckets are one. The buckets whose smallest node,
   their lead, is the same go into one signature tree.
3. Trees. The dual traversal of each tree yields pairs that may link, each of which joins two parts of the tree, so
   fewer than it has sets; they are verified. A tree whose pairs all are links is done: what it did not join cannot link.
4. Trees again. Where a pair was none, and where a tree was cut into blocks, the traversal is repeated with the components
   known by then, and yields all pairs of different ones that may link. Pairs inside a component need no check.
5. Components by contraction: every node hooks onto its smallest neighbour until no edge is left. All tables stay
   distributed; the driver holds the sketch and counts only.

Every candidate comes from the traversal of a tree. A shingle that very many sets route, and a lead with very many or
very long sets, are cut into blocks: blocks are traversed one by one, each with the lead, and then pair by pair.

Verification is exact on 64-bit shingle hashes; a set is known by 128 bits. Tables between the steps are written to the
shared folder and deleted when later ones replace them.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop, map_arrow, table, written

#: Similarity as a ratio.
NUM, DEN = 80, 100
#: Rows and counters of the sketch: 1 MB in all, whatever the input.
DEPTH, WIDTH = 2, 1 << 17
SLICES = 32
#: Routed shingles to a task, about.
TASK_TOKENS = 500_000
BUFFER = 1 << 20
#: A shingle that more sets than this hold beyond the usual, by the sketch, is dealt over all tasks; the sets of a lead's
#: tree hold about so many shingles, of one to two bytes each in its bitmaps; larger trees are cut into blocks.
HOT_TOKEN, TREE_SHINGLES = 1_000_000, 30_000_000
#: Bits of a node's number; sets that share a number get others by their second signature.
NODE_BITS = 64
#: Rows to a file of the narrow tables between the steps, about.
FILE_ROWS = 250_000
#: Up to so many ids (8 bytes each) are broadcast to pick texts; beyond, they are joined by shuffle.
BROADCAST_IDS = 1_000_000


def _columns(arrays, schema: str):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(a, kinds[k]) for a, (_, k) in zip(arrays, names)], names=[n for n, _ in names])


SCAN = "kind int, doc_id long, n long, s1 long, s2 long, cells binary"


MARKED = SCAN + ", mark long"


def scan(batches, schema: str = SCAN):
    """Kind 0: a document's size and signature, and its third column where the schema is MARKED; kind 1: a slice of the
    task's sketch."""
    from tessera.llm.shingles import shingles, signature

    counts = np.zeros((DEPTH, WIDTH), np.uint32)
    waiting, held = [], 0

    def count():
        tokens = np.concatenate(waiting) if waiting else np.zeros(0, np.uint64)
        for d in range(DEPTH):
            counts[d] += np.bincount(cell(tokens, d), minlength=WIDTH).astype(np.uint32)
        waiting.clear()

    for batch in batches:
        rows = ([], [], [], [], [], [])
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            s = shingles(text.as_py())
            for column, value in zip(rows, (0, doc_id, len(s), *signature(s), None)):
                column.append(value)
            waiting.append(s)
            held += len(s)
            if held > BUFFER:
                count()
                held = 0
        yield _columns((*rows, *[c.to_pylist() for c in batch.columns[2:]]), schema)
    count()
    part = counts.reshape(SLICES, -1)
    no_mark = [[None] * SLICES] * (schema == MARKED)
    yield _columns(([1] * SLICES, list(range(SLICES)), [0] * SLICES, [0] * SLICES, [0] * SLICES, [zlib.compress(p.tobytes(), 1) for p in part], *no_mark), schema)


def cell(tokens, d: int):
    return ((tokens >> np.uint64(17 * d)) & np.uint64(WIDTH - 1)).astype(np.int64)


def add_slices(batches):
    """Sums of the slices of the sketch; holds one array a slice."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(zlib.decompress(cells), np.uint32).astype(np.uint64)
            sums[k] = sums[k] + part if k in sums else part
    yield _columns((list(sums), [zlib.compress(v.tobytes(), 1) for v in sums.values()]), "doc_id long, cells binary")


def ranks(counts):
    """A byte for each counter: 0 for what chance makes of rare shingles, else the logarithm of the excess."""
    counts = counts.astype(np.float64).reshape(DEPTH, WIDTH)
    usual = np.median(counts, axis=1, keepdims=True)
    over = counts - usual
    return np.where(over > 8 * np.sqrt(usual) + 8, np.log2(np.maximum(over, 1)), 0).astype(np.uint8)


def commonness(s, order):
    """The rank of each shingle: the smaller of its counters'."""
    common = order[0][cell(s, 0)]
    for d in range(1, DEPTH):
        common = np.minimum(common, order[d][cell(s, d)])
    return common


def prefix(s, order):
    """The n - ceil(t n) + 1 shingles that come first: rare before common, then by hash."""
    size = len(s) + (-NUM * len(s) // DEN) + 1
    common = commonness(s, order)
    return s[np.argsort(common, kind="stable")[:size]] if common.any() else s[:size]


def number(s, bits: int, others: dict[tuple[int, int], int]) -> int:
    """The node of a set."""
    from tessera.llm.shingles import signature

    s1, s2 = signature(s)
    s1 >>= 64 - bits
    return others.get((s1, s2), s1) if others else s1


ROUTED = "part long, data binary"
ENTRY = np.dtype([("token", "<u8"), ("node", "<i8"), ("n", "<u4")])


def router(order_bytes: bytes, parts: int, hot: int, node_of):
    """Entries by task; those of shingles of rank ``hot`` or more are dealt by node as well, to parts from ``parts`` on."""

    def route(batches):
        from tessera.llm.shingles import mix, shingles

        order = np.frombuffer(zlib.decompress(order_bytes), np.uint8).reshape(DEPTH, WIDTH)
        seen: set[int] = set()
        waiting, held = [], 0

        def flush():
            entries = np.concatenate(waiting)
            part = (mix(entries["token"]) % np.uint64(parts)).astype(np.int64)
            spread = commonness(entries["token"], order) >= hot
            if spread.any():
                part[spread] = parts + (mix(entries["token"][spread] + entries["node"][spread].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            entries = entries[np.argsort(part, kind="stable")]
            ends = np.cumsum(np.bincount(part, minlength=2 * parts))
            starts = np.append(0, ends[:-1])
            some = np.flatnonzero(ends > starts)
            waiting.clear()
            return _columns((some, [entries[starts[k] : ends[k]].tobytes() for k in some]), ROUTED)

        for batch in batches:
            for text in batch.column(1):
                s = shingles(text.as_py())
                if len(s) * (DEN - NUM) < NUM:  # one more or one fewer shingle is too much: links equal sets only
                    continue
                node = node_of(s)
                if node in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(node)
                p = prefix(s, order)
                e = np.empty(len(p), ENTRY)
                e["token"], e["node"], e["n"] = p, node, len(s)
                waiting.append(e)
                held += len(p)
                if held > BUFFER:
                    yield flush()
                    held = 0
        if waiting:
            yield flush()

    return route


BUCKETS = "kind int, bucket long, lead long, nodes binary, sizes binary"


def gatherer(parts: int):
    """Kind 0: buckets, known by a hash of their members; kind 1: slices of the buckets of hot shingles, known by the
    shingle, without a lead."""

    def gather(batches):
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(k, []).append(data)
        while held:
            k, blobs = held.popitem()
            e = np.frombuffer(b"".join(blobs), ENTRY)
            blobs = None
            yield from slices_of(e) if k >= parts else buckets_of(e)

    return gather


def distinct_entries(e):
    """Entries by token, size and node, each once."""
    e = e[np.lexsort((e["node"], e["n"], e["token"]))]
    return e[~np.append(False, (e["token"][1:] == e["token"][:-1]) & (e["node"][1:] == e["node"][:-1]))]


def bucket_rows(kind: int, names, leads, e, start, size):
    """Rows of BUCKETS, the members of each bucket as bytes."""
    nodes, sizes = np.ascontiguousarray(e["node"]), np.ascontiguousarray(e["n"])
    for at in range(0, len(size), 20_000):
        some = range(at, min(at + 20_000, len(size)))
        rows = [nodes[start[k] : start[k] + size[k]].tobytes() for k in some], [sizes[start[k] : start[k] + size[k]].tobytes() for k in some]
        yield _columns(([kind] * len(some), names[at : at + 20_000], leads[at : at + 20_000], *rows), BUCKETS)


def slices_of(e):
    e = distinct_entries(e)
    start = np.flatnonzero(np.append(True, e["token"][1:] != e["token"][:-1]))
    size = np.diff(np.append(start, len(e)))
    yield from bucket_rows(1, e["token"][start].view(np.int64), [None] * len(start), e, start, size)


def buckets_of(e):
    from tessera.llm.shingles import mix

    e = distinct_entries(e)
    # a new bucket where the token changes, or the size by more than a link allows
    n = e["n"].astype(np.int64)
    new = np.append(True, (e["token"][1:] != e["token"][:-1]) | (n[:-1] * DEN < n[1:] * NUM))
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(e)))
    e, start, size = e[np.repeat(size > 1, size)], start[size > 1], size[size > 1]
    if not len(size):
        return
    start = np.append(0, np.cumsum(size)[:-1])
    h = np.add.reduceat(mix(np.ascontiguousarray(e["node"]).view(np.uint64)), start)
    h = mix(h + size.astype(np.uint64))
    _, one = np.unique(h, return_index=True)
    kept = np.zeros(len(size), bool)
    kept[one] = True
    e, size, h = e[np.repeat(kept, size)], size[kept], h[kept]
    start = np.append(0, np.cumsum(size)[:-1])
    yield from bucket_rows(0, h.view(np.int64), np.minimum.reduceat(e["node"], start), e, start, size)


MEMBERS = "bucket long, lead long, node long, n long"


def members(batches):
    import pyarrow as pa

    for batch in batches:
        for k in range(batch.num_rows):
            nodes, sizes = np.frombuffer(batch.column(2)[k].as_py(), np.int64), np.frombuffer(batch.column(3)[k].as_py(), np.uint32)
            same = [pa.repeat(batch.column(c)[k], len(nodes)) for c in (0, 1)]
            yield _columns((*same, nodes, sizes.astype(np.int64)), MEMBERS)


BITS = "node long, bits binary"
SETS = "node long, tokens binary"


def bits_maker(node_of):
    def bits_of(batches):
        from tessera.llm.shingles import shingles
        from tessera.llm.signature_tree import bitmap

        for batch in batches:
            sets = [shingles(text.as_py()) for text in batch.column(1)]
            yield _columns(([node_of(s) for s in sets], [bitmap(s) for s in sets]), BITS)

    return bits_of


def sets_maker(node_of):
    def sets_of(batches):
        from tessera.llm.shingles import shingles

        for batch in batches:
            sets = [shingles(text.as_py()) for text in batch.column(1)]
            yield _columns(([node_of(s) for s in sets], [s.tobytes() for s in sets]), SETS)

    return sets_of


LINKS = "a long, b long"


def verify(batches):
    """The pairs (a, b, tokens of a, tokens of b) that are similar enough."""
    for batch in batches:
        found = ([], [])
        for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            i = int((both[1:] == both[:-1]).sum())
            if DEN * i >= NUM * (len(x) + len(y) - i):
                found[0].append(a)
                found[1].append(b)
        yield _columns(found, LINKS)


PAIRS = LINKS + ", lead long"


def by_tree(batches, made, schema: str):
    """What ``made`` yields for the rows of each tree, (lead, one, two) in order; the rows of one tree are held at a time."""

    def pairs(at, rows):
        for a, b in made(at, rows):
            if len(a):
                yield _columns((a, b, [at[0]] * len(a))[: len(schema.split(", "))], schema)

    at, held = None, []
    for batch in batches:
        for lead, one, two, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (lead, one, two) != at:
                if held:
                    yield from pairs(at, held)
                at, held = (lead, one, two), []
            held.append(tuple(row))
    if held:
        yield from pairs(at, held)


def forest_pairs(batches):
    """Pairs that may link and join all that may in each tree; rows (lead, block, block, node, n, bits)."""
    from tessera.llm.signature_tree import forest, pair_may_link

    def made(_, rows):
        if len(rows) == 2:  # the root of a tree of two sets has one pair below it
            (i, n, x), (j, m, y) = rows
            if pair_may_link(n, m, x, y, NUM, DEN):
                yield np.array([min(i, j)]), np.array([max(i, j)])
            return
        ids, sizes = (np.array([r[k] for r in rows], np.int64) for k in range(2))
        yield from forest(ids, sizes, [r[2] for r in rows], NUM, DEN)

    yield from by_tree(batches, made, PAIRS)


def tree_pairs(batches):
    """Pairs of different components that may link, from the dual traversal of each tree, or of two blocks of one.

    Rows are (lead, one, two, node, n, component, bits, block), where one and two are the blocks of a lead that meet.
    """
    from tessera.llm.signature_tree import candidates, pair_may_link

    def made(at, rows):
        _, one, two = at
        if len(rows) == 2 and one == two:
            (i, n, c, x, _), (j, m, d, y, _) = rows
            if c != d and pair_may_link(n, m, x, y, NUM, DEN):
                yield np.array([min(i, j)]), np.array([max(i, j)])
            return
        ids, sizes, groups = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        _, groups = np.unique(groups, return_inverse=True)  # numbers from 0, as -1 stands for mixed
        side = None if one == two else np.array([r[4] == two for r in rows], np.int64)
        yield from candidates(ids, sizes, [r[3] for r in rows], groups.astype(np.int64), NUM, DEN, side)

    yield from by_tree(batches, made, LINKS)


def large_leads(rows: DataFrame) -> DataFrame:
    """(of, blocks): the leads whose sets hold more shingles than one tree does."""
    large = rows.groupBy(F.col("lead").alias("of")).agg(F.ceil(F.sum("n") / TREE_SHINGLES).cast("int").alias("blocks"))
    return written(large.filter("blocks > 1"), "near-large")


def blocked(rows: DataFrame, large: DataFrame, pairs: bool) -> DataFrame:
    """``rows`` (lead, node, ...) with one, two and block: the blocks of its lead in which a row takes part. Blocks alone,
    each with the lead itself, or with ``pairs`` all pairs of blocks."""
    zero = F.lit(0).alias
    n_large = large.count()
    if not n_large:
        return rows.withColumns({"one": zero("one"), "two": zero("two"), "block": zero("block")})
    out = rows.join(F.broadcast(large) if n_large <= BROADCAST_IDS else large, F.col("lead") == F.col("of"), "left").drop("of").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    out = out.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    each = F.sequence(F.lit(0), F.col("blocks") - 1)
    if pairs:
        out = out.withColumn("other", F.explode(each)).withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")}).drop("other")
    else:
        out = out.withColumn("one", F.explode(F.when(F.col("node") == F.col("lead"), each).otherwise(F.array("block")))).withColumn("two", F.col("one"))
    return out.drop("blocks")


def with_both(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs (a, b) with the facts of either side: each as na, nb, then xa, xb and so on by column."""
    out = pairs
    for side in ("a", "b"):
        f = facts.select(F.col("node").alias("of"), *[F.col(c).alias(f"{c}_{side}") for c in facts.columns if c != "node"])
        out = out.join(f, F.col(side) == F.col("of")).drop("of")
    return out.select("a", "b", *[f"{c}_{side}" for c in facts.columns if c != "node" for side in ("a", "b")])


def files(rows: int) -> int:
    return rows // FILE_ROWS + 1


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, component) of every node with a link; component is the smallest node of each connected component."""
    edges = written(links.select("a", "b").filter("a <> b").distinct(), f"{name}-edges")
    ends = lambda e: e.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("to")))
    n = files(2 * edges.count())
    labels = written(ends(edges).select("node").distinct().withColumn("component", F.col("node")).coalesce(n), f"{name}-labels")
    while not edges.isEmpty():
        # every node hooks onto its smallest neighbour; the edge to it is carried over, so no connection is lost
        up = written(ends(edges).groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("up")).coalesce(n), f"{name}-up")
        new = written(labels.join(up.withColumnRenamed("node", "of"), F.col("component") == F.col("of"), "left").select(labels["node"], F.coalesce("up", "component").alias("component")).coalesce(n), f"{name}-labels")
        moved = edges.join(up.withColumnsRenamed({"node": "na", "up": "ua"}), F.col("a") == F.col("na")).join(up.withColumnsRenamed({"node": "nb", "up": "ub"}), F.col("b") == F.col("nb"))
        moved = moved.filter("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        left = written(moved.coalesce(n), f"{name}-edges")
        drop(labels, edges, up)
        labels, edges = new, left
    drop(edges)
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): one row a row of ``docs``.

    component_id is the smallest id reachable by links, the row's own included. Texts without words, null among them,
    have an empty set, link with nothing and are their own component. Repeated rows are copies of one another. Rows
    with a null id take part; their component is that of the smallest id they reach, null if there is none. An empty
    table gives no rows; other columns are dropped.
    """
    full = written(grouped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))), "near-full")
    # one row a component, written: the join's other side may then be split where a component is large
    least = full.filter("component is not null").groupBy(F.col("component").alias("of")).agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows"))
    least = written(least.filter("rows > 1").drop("rows"), "near-least")
    out = full.join(least, F.col("component") == F.col("of"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("of").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def other_numbers(heads: DataFrame, clash: DataFrame) -> dict[tuple[int, int], int]:
    """Numbers for the sets whose first signature ``clash`` (of, low) says another set has, but the one of the smallest
    second signature: (s1, s2) to a number that no first signature is.

    Such sets are few whatever the input, about n * n / 2**65 of n sets.
    """
    from tessera.llm.shingles import mix

    rest = heads.filter("n > 0").join(F.broadcast(clash), (F.col("s1") == F.col("of")) & (F.col("s2") != F.col("low"))).select("s1", "s2").distinct()
    others: dict[tuple[int, int], int] = {}
    todo = sorted((r.s1, r.s2) for r in rest.collect())
    step = 0
    while todo:
        step += 1
        tried = {}
        for s1, s2 in todo:
            x = np.array([s1 & (2**64 - 1)], np.uint64) * np.uint64(3) + np.array([s2 & (2**64 - 1)], np.uint64) + np.uint64(step)
            tried[s1, s2] = int(mix(x).view(np.int64)[0])
        ids = list(tried.values())
        taken = {r[0] for r in heads.filter(F.col("s1").isin(ids)).select("s1").distinct().collect()} | {x for x in ids if ids.count(x) > 1} | set(others.values())
        others |= {k: v for k, v in tried.items() if v not in taken}
        todo = [k for k in todo if k not in others]
    return others


def numbered(heads: DataFrame) -> tuple[DataFrame, DataFrame, dict[tuple[int, int], int]]:
    """``heads`` with node in place of the signatures, the nodes (node, doc_id, n) of non-empty sets, and the numbers of the
    sets whose first signature another set has."""
    heads = heads.withColumn("s1", F.shiftright("s1", 64 - NODE_BITS))
    some = lambda by: heads.filter("n > 0").groupBy(by).agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.min("s2").alias("low"), F.max("s2").alias("high"))
    nodes = written(some(F.col("s1").alias("node")), "near-nodes")
    clash = nodes.filter("low <> high").select(F.col("node").alias("of"), "low")
    if clash.isEmpty():
        return heads.withColumn("node", F.col("s1")).drop("s1", "s2"), nodes.drop("low", "high"), {}
    others = other_numbers(heads, clash)
    rows = heads.sparkSession.createDataFrame([(*k, v) for k, v in others.items()], "x1 long, x2 long, other long")
    heads = heads.join(F.broadcast(rows), (F.col("s1") == F.col("x1")) & (F.col("s2") == F.col("x2")), "left").withColumn("node", F.coalesce("other", "s1"))
    nodes = written(some("node"), "near-nodes")
    return heads.drop("s1", "s2", "x1", "x2", "other"), nodes.drop("low", "high"), others


def grouped(texts: DataFrame, marked: bool = False) -> DataFrame:
    """(doc_id, n, component) of each row (doc_id, text): its set's size and the smallest node of its component, null for
    an empty set. ``marked``: rows have a third column, the long ``mark``, which is handed on."""
    spark = texts.sparkSession
    marks = ["mark"] if marked else []
    schema = MARKED if marked else SCAN
    scanned = written(map_arrow(texts, lambda batches: scan(batches, schema), schema), "near-scan")
    heads = scanned.filter("kind = 0").select("doc_id", "n", "s1", "s2", *marks)
    slices = map_arrow(scanned.filter("kind = 1").select("doc_id", "cells").repartition(SLICES, "doc_id"), add_slices, "doc_id long, cells binary")
    by_slice = {r.doc_id: np.frombuffer(zlib.decompress(bytes(r.cells)), np.uint64) for r in slices.collect()}
    if not by_slice:
        return heads.select("doc_id", "n", F.lit(None).cast("long").alias("component"), *marks)
    order = ranks(np.concatenate([by_slice[k] for k in range(SLICES)]))
    hot = max(1, int(np.ceil(np.log2(HOT_TOKEN)))) if HOT_TOKEN > 1 else 0

    heads, nodes, others = numbered(heads)
    node_bits = NODE_BITS
    node_of = lambda s: number(s, node_bits, others)
    n_nodes, tokens = nodes.agg(F.count("*"), F.sum(F.floor(F.col("n") * (DEN - NUM) / DEN) + 1)).first()

    parts = max(2 * spark.sparkContext.defaultParallelism, (tokens or 0) // TASK_TOKENS + 1)
    routed = map_arrow(texts, router(zlib.compress(order.tobytes(), 6), parts, hot, node_of), ROUTED).repartition(parts, "part")
    gathered = written(map_arrow(routed, gatherer(parts), BUCKETS), "near-buckets")
    plain = gathered.filter("kind = 0").groupBy("bucket").agg(*[F.first(c).alias(c) for c in ("lead", "nodes", "sizes")])
    inside = map_arrow(plain, members, MEMBERS)
    spread = gathered.filter("kind = 1")
    if not spread.isEmpty():
        # the bucket of a hot shingle is dealt over all tasks, which agree on its lead; a shingle is one row here
        loose = map_arrow(spread.select("bucket", "lead", "nodes", "sizes"), members, MEMBERS).drop("lead")
        leads = written(loose.groupBy(F.col("bucket").alias("of")).agg(F.min("node").alias("lead")), "near-leads")
        n_leads = leads.count()
        loose = loose.join(F.broadcast(leads) if n_leads <= BROADCAST_IDS else leads, F.col("bucket") == F.col("of"))
        inside = inside.unionByName(loose.select("bucket", "lead", "node", "n"))
    # buckets of one lead mostly hold the same nodes and go into one tree; more nodes lose no pair
    inside = written(inside.select("lead", "node", "n").distinct(), "near-members")
    drop(gathered)

    def made(wanted: DataFrame, run, schema: str, name: str) -> DataFrame:
        """What ``run`` makes of the texts of the wanted nodes, one row a node."""
        ids = wanted.join(nodes.select(F.col("node").alias("of"), "doc_id"), F.col("node") == F.col("of")).select(F.col("doc_id").alias("id"))
        ids = written(ids.coalesce(files(n_nodes)), "near-ids")
        small = ids.count() <= BROADCAST_IDS
        picked = texts.join(F.broadcast(ids) if small else ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
        # equal or null ids may bring texts that were not asked for, and a set more than once
        out = map_arrow(picked, run, schema)
        out = written(out.groupBy("node").agg(*[F.first(c).alias(c) for c in out.columns if c != "node"]), name)
        drop(ids)
        return out

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among pairs that passed their bitmaps; only the sets of their nodes are made."""
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        sets = made(ends, sets_maker(node_of), SETS, "near-sets")
        out = written(map_arrow(with_both(pairs, sets), verify, LINKS), "near-links")
        drop(sets)
        return out

    def treed(rows: DataFrame, run, schema: str, pairs: bool) -> DataFrame:
        """What ``run`` finds in the trees of ``rows`` (lead, node, ...)."""
        rows = blocked(rows, large, pairs).join(bits.select(F.col("node").alias("of"), "bits"), F.col("node") == F.col("of")).drop("of")
        last = ["component", "bits", "block"] if pairs else ["bits"]
        rows = rows.select("lead", "one", "two", "node", "n", *last)
        at = ["lead", "one", "two"]
        return map_arrow(rows.repartition(*at).sortWithinPartitions(*at), run, schema)

    bits = made(inside.select("node").distinct(), bits_maker(node_of), BITS, "near-bits")
    large = large_leads(inside)
    joining = written(treed(inside, forest_pairs, PAIRS, False), "near-joining")
    links = verified(joining.select("a", "b").distinct())
    first = components(links, "near-first")
    failed = joining.join(links.withColumnsRenamed({"a": "la", "b": "lb"}), (F.col("a") == F.col("la")) & (F.col("b") == F.col("lb")), "left_anti")
    again = written(failed.select(F.col("lead").alias("again")).unionByName(large.select(F.col("of").alias("again"))).distinct(), "near-again")
    few = again.count() <= BROADCAST_IDS
    own = inside.join(F.broadcast(again) if few else again, F.col("lead") == F.col("again"), "left_semi")
    own = own.join(first.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("lead", "node", "n", F.coalesce("component", "node").alias("component"))
    own = written(own.coalesce(files(n_nodes)), "near-own")
    open_leads = own.groupBy(F.col("lead").alias("open")).agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("open")
    rest = written(own.join(open_leads, F.col("lead") == F.col("open"), "left_semi"), "near-rest")
    more = treed(rest, tree_pairs, LINKS, True).distinct()
    more = more.join(joining.select(F.col("a").alias("sa"), F.col("b").alias("sb")).distinct(), (F.col("a") == F.col("sa")) & (F.col("b") == F.col("sb")), "left_anti")
    more = written(more, "near-pairs")
    extra = verified(more)
    drop(inside, bits, large, joining, links, again, own, rest, more)
    # components of the components that the second links join
    lift = lambda e, c: e.join(first.select(F.col("node").alias("of"), F.col("component").alias("up")), F.col(c) == F.col("of"), "left").withColumn(c, F.coalesce("up", c)).drop("of", "up")
    second = components(lift(lift(extra, "a"), "b"), "near-second")
    top = first.select("node", "component").unionByName(second.join(first, "node", "left_anti"))
    top = top.join(second.withColumnsRenamed({"node": "of", "component": "up"}), F.col("component") == F.col("of"), "left").select(F.col("node").alias("of"), F.coalesce("up", "component").alias("component"))
    top = written(top.coalesce(files(n_nodes)), "near-top")
    drop(first, second, extra, nodes)

    full = heads.join(top, F.col("node") == F.col("of"), "left")
    return full.select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("component"), *marks)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: bool = True) -> DataFrame:
    """``docs`` with one document of each group: the one of the smallest id, null last, and of its texts the one of the
    smallest hash. An empty text stays once an id. Repetitions of a kept row, equal in id and text, stay with
    ``repeats``; without, the one of the smallest hash of all columns does.
    """
    mark = F.xxhash64(F.col(text_col))
    found = grouped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), mark.alias("mark")), marked=True)
    # rows equal in id and text have one set, so one component
    keys = found.groupBy("doc_id", "mark").agg(F.first("component").alias("component"), F.count("*").alias("times"))
    # an empty set links with nothing: those of different ids stay
    own = F.when(F.col("component").isNull(), F.struct("doc_id"))
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "times")
    kept = keys.groupBy("component", own.alias("own")).agg(F.min(key).alias("k")).select(F.col("k.doc_id").alias("kept_id"), F.col("k.mark").alias("kept_mark"), "k.times")
    kept = written(kept, "near-kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), mark.alias("mark"))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("mark") == F.col("kept_mark"))
    many = kept.filter("times > 1")
    n_many = 0 if repeats else many.count()
    if not n_many:
        return rows.join(kept, same, "left_semi").select("row.*")
    # a row may be repeated without bound, so its repetitions are combined where they are read
    repeated = rows.join(F.broadcast(many) if n_many <= BROADCAST_IDS else many, same, "left_semi")
    once = repeated.groupBy("id", "mark").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return rows.join(kept.filter("times = 1"), same, "left_semi").select("row.*").unionByName(once.select("row.*"))


def op6_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
