"""Matching of one large sample in bounded memory: numpy over the arrays of a row, inside the tasks that hold it."""

from __future__ import annotations

import heapq


def overlap(box, boxes):
    """Intersection over union of a box with each of an array of boxes, as ``geometry.iou`` has it."""
    import numpy as np

    w = np.maximum(0, np.minimum(box[2], boxes[:, 2]) - np.maximum(box[0], boxes[:, 0]))
    h = np.maximum(0, np.minimum(box[3], boxes[:, 3]) - np.maximum(box[1], boxes[:, 1]))
    both = w * h
    union = (box[2] - box[0]) * (box[3] - box[1]) + (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1]) - both
    return both / np.where(union > 0, union, np.inf)


#: Pairs of boxes of which overlaps are computed at once, in some 30 MB.
AT_ONCE = 1 << 18


def all_overlaps(p_boxes, r_boxes, p_own, r_own, of_text, starts):
    """(overlaps, predictions, references) of few boxes: the overlapping pairs in order, each taken if both of its boxes are free.

    ``p_own`` are the predictions to match and ``r_own`` the references with a box, by text; of each of ``p_own``, ``of_text``
    counts the references of its text, which begin at ``starts``.
    """
    import numpy as np

    ps = np.repeat(p_own, of_text)
    rs = r_own[np.arange(len(ps)) + np.repeat(starts - (np.cumsum(of_text) - of_text), of_text)]
    v = overlap(p_boxes[ps].T, r_boxes[rs])
    some = np.flatnonzero(v > 0)
    v, ps, rs = v[some], ps[some], rs[some]
    order = np.lexsort((rs, ps, -v))
    used_p, used_r, kept = bytearray(len(p_boxes)), bytearray(len(r_boxes)), []
    for k, i, j in zip(order.tolist(), ps[order].tolist(), rs[order].tolist()):
        if not used_p[i] and not used_r[j]:
            used_p[i] = used_r[j] = 1
            kept.append(k)
    return v[kept], ps[kept], rs[kept]


def best_overlaps(p_boxes, r_boxes):
    """(overlap, prediction, reference) of the pairs taken when the best overlap above 0 goes first, ties by position.

    Each prediction waits in a heap with its best free reference; one whose reference was taken looks again. So memory
    is that of the elements, and no pair is stored.
    """
    import numpy as np

    order = np.argsort(r_boxes[:, 0], kind="stable")  # by left edge: a box overlaps none that begins right of its end
    sorted_boxes, left = r_boxes[order], r_boxes[order, 0]
    free = np.ones(len(order), bool)

    def best(i):
        end = int(np.searchsorted(left, p_boxes[i, 2]))
        at = np.flatnonzero(free[:end])
        if not len(at):
            return None
        v = overlap(p_boxes[i], sorted_boxes[at])
        top = v.max()
        if top <= 0:
            return None
        ties = at[v == top]
        return -float(top), i, int(order[ties].min())

    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    heap = [b for b in map(best, range(len(p_boxes))) if b]
    heapq.heapify(heap)
    while heap:
        v, i, r = heap[0]
        if free[place[r]]:
            heapq.heappop(heap)
            free[place[r]] = False
            yield -v, i, r
            continue
        again = best(i)
        if again:
            heapq.heapreplace(heap, again)
        else:
            heapq.heappop(heap)


def greedy(pred, ref):
    """(tp, iou_sum, boxes) of two lists of usable elements (text, box): the same as the fold of ``match.greedy``."""
    import numpy as np

    number: dict[str, int] = {}
    sides = []
    for elements in (pred, ref):
        texts = np.array([number.setdefault(e["text"], len(number)) for e in elements], np.int64)
        sides += [texts, np.array([e["box"] or (0, 0, 0, 0) for e in elements], np.int64).reshape(-1, 4)]
    return greedy_arrays(*sides)


def greedy_arrays(p_text, p_boxes, r_text, r_boxes):
    """``greedy`` of elements as arrays: the numbers of their texts, from 0, and their boxes in rows of four, zeros for none.

    Elements of one text may match; pairs that overlap are taken from the best on, the rest of a text pairs up by rank.
    Texts of few pairs go together, ``AT_ONCE`` pairs at most; one of more is matched alone, without a list of its pairs.
    """
    import numpy as np

    n = 1 + max(p_text.max(initial=-1), r_text.max(initial=-1))
    by_text = lambda text, some: some[np.argsort(text[some], kind="stable")]
    p_ok, r_ok = p_boxes[:, 2] > 0, r_boxes[:, 2] > 0
    p_own, r_own = by_text(p_text, np.flatnonzero(p_ok)), by_text(r_text, np.flatnonzero(r_ok))
    p_n, r_n = np.bincount(p_text[p_own], minlength=n), np.bincount(r_text[r_own], minlength=n)
    p_end, r_end, pairs = np.cumsum(p_n), np.cumsum(r_n), p_n * r_n
    taken = []

    def together(texts):
        own = p_own if len(texts) == n else np.concatenate([p_own[p_end[t] - p_n[t]:p_end[t]] for t in texts])
        t = p_text[own]
        taken.append(all_overlaps(p_boxes, r_boxes, own, r_own, r_n[t], r_end[t] - r_n[t]))

    few, size = [], 0
    for t, more in enumerate(pairs.tolist()):
        if more > AT_ONCE:
            ps, rs = p_own[p_end[t] - p_n[t]:p_end[t]], r_own[r_end[t] - r_n[t]:r_end[t]]
            v, i, j = np.array(list(best_overlaps(p_boxes[ps], r_boxes[rs])), float).reshape(-1, 3).T
            taken.append((v, ps[i.astype(np.int64)], rs[j.astype(np.int64)]))
            continue
        if size + more > AT_ONCE:
            together(few)
            few, size = [], 0
        few.append(t)
        size += more
    if size:
        together(few)
    p_free, r_free = np.ones(len(p_text), bool), np.ones(len(r_text), bool)
    total = 0.0
    if taken:
        v, i, j = map(np.concatenate, zip(*taken))
        p_free[i] = r_free[j] = False
        if len(v):
            total = float(np.cumsum(v[np.lexsort((j, i, -v))])[-1])  # one after the other, as the fold adds
    p_rest, r_rest = by_text(p_text, np.flatnonzero(p_free)), by_text(r_text, np.flatnonzero(r_free))
    p_n, r_n = np.bincount(p_text[p_rest], minlength=n), np.bincount(r_text[r_rest], minlength=n)

    def ranked(text, rest, own, other):
        """Those of the rest whose rank in their text is one of the other side too."""
        t = text[rest]
        return rest[np.arange(len(rest)) - (np.cumsum(own) - own)[t] < other[t]]

    ps, rs = ranked(p_text, p_rest, p_n, r_n), ranked(r_text, r_rest, r_n, p_n)
    matched = len(p_text) - int(p_free.sum())
    return matched + len(ps), total, matched + int((p_ok[ps] & r_ok[rs]).sum())


# ---- names


class Names:
    """The distinct candidates of a sample, as ``text.strong_normalize`` leaves them, ready to be compared with a name.

    A name is compared with all distinct candidates at once, letter by letter over those that hold the letter; words
    count where one is shared, containment is looked at where the smaller name has no letter of its own. Memory is that
    of the distinct names.
    """

    def __init__(self, names: list[str]):
        import numpy as np

        self.distinct = sorted(set(names))
        letters: dict[str, tuple[list, list]] = {}
        self.by_word: dict[str, list[int]] = {}
        self.words = []
        sizes = []
        for k, name in enumerate(self.distinct):
            solid = name.replace(" ", "")
            sizes.append(len(solid))
            for c in set(solid):
                at, n = letters.setdefault(c, ([], []))
                at.append(k)
                n.append(solid.count(c))
            self.words.append({w for w in name.split(" ") if w})
            for w in self.words[-1]:
                self.by_word.setdefault(w, []).append(k)
        self.letters = {c: (np.array(at), np.array(n)) for c, (at, n) in letters.items()}
        self.sizes = np.array(sizes, np.int64)
        number = {n: k for k, n in enumerate(self.distinct)}
        self.places: list[list[int]] = [[] for _ in self.distinct]  # positions of each distinct name, the first last
        for i in range(len(names) - 1, -1, -1):
            self.places[number[names[i]]].append(i)
        self.next = np.array([p[-1] for p in self.places], np.int64)
        self.open = np.ones(len(self.distinct), bool)
        self._last: tuple[str, object] | None = None

    def similarity(self, own: str):
        """Of a name with each distinct candidate, as ``text.name_similarity`` has it."""
        import numpy as np

        if self._last and self._last[0] == own:
            return self._last[1]
        out = np.zeros(len(self.distinct))
        if own:
            solid, common = own.replace(" ", ""), np.zeros(len(self.distinct), np.int64)
            for c in set(solid):
                if c in self.letters:
                    at, n = self.letters[c]
                    common[at] += np.minimum(n, solid.count(c))
            out = 2.0 * common / np.maximum(len(solid) + self.sizes, 1)
            words = {w for w in own.split(" ") if w}
            shared: dict[int, int] = {}
            for w in words:
                for k in self.by_word.get(w, ()):
                    shared[k] = shared.get(k, 0) + 1
            for k, n in shared.items():
                out[k] = max(out[k], n / len(words | self.words[k]))
            for k in np.flatnonzero((common == np.minimum(len(solid), self.sizes)) & (self.sizes > 0)):
                other = self.distinct[k]
                if other in own or own in other:
                    out[k] = 1.0 if other == own else 0.9
            out[self.sizes == 0] = 0.0
        self._last = own, out
        return out

    def best(self, name: str):
        """(number, position, similarity) of the most similar candidate that is free, the first of equal ones; None: none is."""
        import numpy as np

        at = np.flatnonzero(self.open)
        if not len(at):
            return None
        v = self.similarity(name)[at]
        top = v.max()
        ties = at[v == top]
        k = int(ties[np.argmin(self.next[ties])])
        return k, int(self.next[k]), float(top)

    def take(self, k: int) -> None:
        self.places[k].pop()
        if self.places[k]:
            self.next[k] = self.places[k][-1]
        else:
            self.open[k] = False


def by_similarity(refs, candidates, own_refs, own_candidates, threshold: float):
    """(ref, best, similarity, matched) of each reference in turn; a candidate is taken only where it matches.

    ``own_refs`` and ``own_candidates`` are the names as ``text.strong_normalize`` leaves them.
    """
    names = Names(own_candidates)
    for ref, own in zip(refs, own_refs):
        found = names.best(own) if names.distinct else None
        if found is None:
            yield {"ref": ref, "best": None, "similarity": 0.0, "matched": False}
            continue
        k, at, similarity = found
        matched = similarity >= threshold
        if matched:
            names.take(k)
        yield {"ref": ref, "best": candidates[at], "similarity": similarity, "matched": matched}
