"""Signature trees: nodes hold OR-combined token bitmaps and size ranges; a dual traversal yields the pairs that may link.

A set of n tokens sets bits in a bitmap of a power of two of at least 8n bits, so bitmaps fold onto smaller ones by OR.
For x below node A and y below node B, every bit of x outside the common bits of both nodes stands for a token that y
lacks, so |x & y| <= |x| - (bits of x - common bits). With the size ranges this bounds the similarity of all pairs
below two nodes; pairs of nodes whose bound is too low, and nodes whose members are all in one known component, are
not opened. Nothing that could link is ever left out.

Where all sets may be of one group, the traversal keeps a union-find of the pairs that it yields: nodes whose members it
has joined are not opened against each other, so it yields fewer pairs than there are sets. If all of them prove to be
links, the tree is done; if one does not, what it had joined must be looked at again.
"""

from __future__ import annotations

import numpy as np

FANOUT = 16
LEAST_BITS, MOST_BITS = 64, 1 << 18
#: Bits a token, so that half a per cent of similarity tells.
FINE = 8
#: Pairs of nodes looked at together, and bytes of bitmaps.
CHUNK, BYTES = 1 << 15, 1 << 22


def width(n: int, each: int = FINE) -> int:
    """Bits of the bitmap of a set of n tokens."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (each * max(n, 1) - 1).bit_length()))


def bitmap(tokens, each: int = FINE) -> bytes:
    w = width(len(tokens), each)
    bits = np.zeros(w, np.uint8)
    bits[(tokens & np.uint64(w - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(words, to: int):
    """Bitmaps (rows of 64-bit words) folded to ``to`` words a row."""
    while words.shape[1] > to:
        half = words.shape[1] // 2
        words = words[:, :half] | words[:, half:]
    return words


class Tree:
    """Levels of nodes over sets sorted by size; level 0 are the sets themselves."""

    def __init__(self, ids, sizes, words, groups):
        order = np.lexsort((ids, *(words[:, j] for j in range(min(2, words.shape[1]))), sizes))
        self.ids = ids[order]
        sizes, words, groups = sizes[order], words[order], groups[order]
        count = np.bitwise_count(words).sum(1).astype(np.int64)
        self.levels = [(words, sizes, sizes, count, groups)]
        while len(self.levels[-1][1]) > 1:
            words, low, high, count, groups = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            first = groups[at]
            same = np.logical_and.reduceat(groups == np.repeat(first, np.diff(np.append(at, len(low)))), at)
            self.levels.append((
                np.bitwise_or.reduceat(words, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                np.minimum.reduceat(count, at), np.where(same, first, np.int64(-1)),
            ))

    def top(self) -> int:
        return len(self.levels) - 1


def may_link(a, b, i, j, num: int, den: int):
    """For pairs of nodes (i of level a, j of level b): whether a pair below them may reach num / den."""
    wa, la, ha, ca, ga = a
    wb, lb, hb, cb, gb = b
    fits = (lb[j] * num <= ha[i] * den) & (la[i] * num <= hb[j] * den) & ((ga[i] != gb[j]) | (ga[i] < 0))
    out = np.zeros(len(i), bool)
    every = np.flatnonzero(fits)
    step = max(1, BYTES // (8 * wa.shape[1]))
    for k in range(0, len(every), step):
        at = every[k : k + step]
        x, y = i[at], j[at]
        common = np.bitwise_count(wa[x] & wb[y]).sum(1).astype(np.int64)
        most = np.minimum(ha[x] - np.maximum(ca[x] - common, 0), hb[y] - np.maximum(cb[y] - common, 0))
        out[at] = den * most >= num * (la[x] + lb[y] - most)
    return out


def pair_may_link(na: int, nb: int, x: bytes, y: bytes, num: int, den: int) -> bool:
    """The bound for two sets of sizes na and nb with bitmaps x and y."""
    if min(na, nb) * den < max(na, nb) * num:
        return False
    a, b = np.frombuffer(x, np.uint64)[None, :], np.frombuffer(y, np.uint64)[None, :]
    to = min(a.shape[1], b.shape[1])
    a, b = fold(a, to), fold(b, to)
    common = int(np.bitwise_count(a & b).sum())
    most = min(na - max(int(np.bitwise_count(a).sum()) - common, 0), nb - max(int(np.bitwise_count(b).sum()) - common, 0))
    return den * most >= num * (na + nb - most)


def dual(s: Tree, t: Tree, num: int, den: int):
    """Arrays (ids of s, ids of t) of all pairs that may link, chunk by chunk; for s is t each pair once."""
    same = s is t
    stack = [(s.top(), t.top(), np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        p, q, i, j = stack.pop()
        if len(i) > CHUNK:
            stack += [(p, q, i[k : k + CHUNK], j[k : k + CHUNK]) for k in range(0, len(i), CHUNK)]
            continue
        kept = may_link(s.levels[p], t.levels[q], i, j, num, den)
        i, j = i[kept], j[kept]
        if not len(i):
            continue
        if p == 0 and q == 0:
            if same:
                i, j = i[i != j], j[i != j]
            if len(i):
                yield s.ids[i], t.ids[j]
            continue
        # open the higher node, both of equal height
        open_s, open_t = p >= q and p > 0, q >= p and q > 0
        if open_s:
            i, j = children(i, j, len(s.levels[p - 1][1]))
        if open_t:
            j, i = children(j, i, len(t.levels[q - 1][1]))
        if same:
            i, j = i[i <= j], j[i <= j]
        stack.append((p - open_s, q - open_t, i, j))


def closeness(a, b, i, j):
    """The bound of ``may_link`` for pairs of sets (i of level 0 of a tree, j of another), as a similarity."""
    wa, la, _, ca, _ = a
    wb, lb, _, cb, _ = b
    out = np.empty(len(i))
    step = max(1, BYTES // (8 * wa.shape[1]))
    for k in range(0, len(i), step):
        x, y = i[k : k + step], j[k : k + step]
        common = np.bitwise_count(wa[x] & wb[y]).sum(1).astype(np.int64)
        most = np.minimum(la[x] - np.maximum(ca[x] - common, 0), lb[y] - np.maximum(cb[y] - common, 0))
        out[k : k + step] = most / (la[x] + lb[y] - most)
    return out


class Joined:
    """A union-find over positions from 0."""

    def __init__(self, n: int):
        self.up, self.label, self.changed = list(range(n)), np.arange(n), False

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        self.changed = True
        return True

    def labels(self):
        """The root of every position."""
        if self.changed:
            self.label, self.changed = np.array(self.up), False
            while not np.array_equal(self.label, above := self.label[self.label]):
                self.label = above
        return self.label


def regroup(tree: Tree, labels) -> None:
    """Gives the nodes of a tree over positions the label that all sets below them have, or -1."""
    groups = labels[tree.ids]
    for k, level in enumerate(tree.levels):
        if k:
            at = np.arange(0, len(groups), FANOUT)
            first = groups[at]
            same = np.logical_and.reduceat(groups == np.repeat(first, np.diff(np.append(at, len(groups)))), at)
            groups = np.where(same, first, np.int64(-1))
        tree.levels[k] = (*level[:4], groups)


def spanning(s: Tree, t: Tree, joined: Joined, num: int, den: int):
    """Arrays (positions, positions) of pairs that may link, each of which joins two parts; for s is t within one tree.

    What lies below one node is joined before nodes meet, the closest pairs of a chunk first.
    """
    same = s is t
    stack = [(s.top(), t.top(), np.zeros(1, np.int64), np.zeros(1, np.int64))]
    stale = True
    while stack:
        p, q, i, j = stack.pop()
        step = CHUNK if p == q == 0 else max(1, CHUNK // FANOUT**2)
        if len(i) > step:
            stack.append((p, q, i[step:], j[step:]))
            i, j = i[:step], j[:step]
        if stale or joined.changed:
            labels, stale = joined.labels(), False
            for tree in (s,) if same else (s, t):
                regroup(tree, labels)
        kept = may_link(s.levels[p], t.levels[q], i, j, num, den)
        i, j = i[kept], j[kept]
        if not len(i):
            continue
        if p == 0 and q == 0:
            if same:
                i, j = i[i != j], j[i != j]
            order = np.argsort(-closeness(s.levels[0], t.levels[0], i, j), kind="stable")
            a, b = s.ids[i[order]].tolist(), t.ids[j[order]].tolist()
            made = [(x, y) for x, y in zip(a, b) if joined.join(x, y)]
            if made:
                yield tuple(np.array(x) for x in zip(*made))
            continue
        open_s, open_t = p >= q and p > 0, q >= p and q > 0
        if open_s:
            i, j = children(i, j, len(s.levels[p - 1][1]))
        if open_t:
            j, i = children(j, i, len(t.levels[q - 1][1]))
        if same:
            own = i == j
            for part in (i < j, own):  # the last goes first
                if part.any():
                    stack.append((p - open_s, q - open_t, i[part], j[part]))
        else:
            stack.append((p - open_s, q - open_t, i, j))


def children(parent, other, count: int):
    """The children of each parent with the parent's other side."""
    child = (parent[:, None] * FANOUT + np.arange(FANOUT)[None, :]).ravel()
    other = np.repeat(other, FANOUT)
    real = child < count
    return child[real], other[real]


def trees(ids, sizes, maps: list[bytes], groups) -> dict[int, tuple]:
    """What makes a tree (ids, sizes, words, groups) of the sets of each width, by bytes of a bitmap."""
    widths = np.array([len(m) for m in maps])
    out: dict[int, tuple] = {}
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        words = np.frombuffer(b"".join(maps[k] for k in at), np.uint64).reshape(len(at), -1)
        out[int(w)] = (ids[at], sizes[at], words, groups[at])
    return out


def folded(parts: tuple, w: int) -> Tree:
    """The tree of sets with bitmaps of twice ``w`` bytes, folded to ``w``."""
    ids, sizes, words, groups = parts
    return Tree(ids, sizes, fold(words, w // 8), groups)


def forest(ids, sizes, maps: list[bytes], num: int = 80, den: int = 100):
    """Pairs (smaller id, larger id) that may reach num / den, at most one fewer than there are sets: any two sets that
    may link are joined by them."""
    at, joined = np.arange(len(ids)), Joined(len(ids))
    parts = trees(at, sizes, maps, at)
    for w, made in parts.items():
        tree = Tree(*made)
        met = [(tree, tree)] + ([(tree, folded(parts[2 * w], w))] if 2 * w in parts else [])
        for s, t in met:
            yield from ordered((ids[a], ids[b]) for a, b in spanning(s, t, joined, num, den))


def candidates(ids, sizes, maps: list[bytes], groups, num: int = 80, den: int = 100, side=None):
    """Pairs (smaller id, larger id) of sets that may reach num / den and are not of one group, chunk by chunk.

    ``side``: 0 or 1 for each set, where only pairs of a set of side 0 with one of side 1 are asked for.
    """
    if side is not None:
        one, two = (trees(ids[side == k], sizes[side == k], [m for m, x in zip(maps, side) if x == k], groups[side == k]) for k in (0, 1))
        for w, made in one.items():
            tree = Tree(*made)
            if w in two:
                yield from ordered(dual(tree, Tree(*two[w]), num, den))
            if 2 * w in two:
                yield from ordered(dual(tree, folded(two[2 * w], w), num, den))
            if w // 2 in two:
                yield from ordered(dual(folded(made, w // 2), Tree(*two[w // 2]), num, den))
        return
    parts = trees(ids, sizes, maps, groups)
    for w, made in parts.items():
        tree = Tree(*made)
        yield from ordered(dual(tree, tree, num, den))
        if 2 * w in parts:  # sets of twice the bits may be of nearly equal size; those of four times are not
            yield from ordered(dual(tree, folded(parts[2 * w], w), num, den))


def ordered(pairs):
    for a, b in pairs:
        yield np.minimum(a, b), np.maximum(a, b)
