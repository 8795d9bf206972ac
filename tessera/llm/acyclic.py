"""Minimal acyclic automata whose words are numbered, and the search in them with one error."""

from __future__ import annotations


class Acyclic:
    """The minimal automaton of distinct words in ascending order; the n-th of them has the number n.

    ``edges[state]`` maps a letter to (next state, number of words passed over): the sum along a path numbers its word.
    """

    def __init__(self, words):
        self.edges: list[dict] = [{}]
        self.final = [False]
        self._words = [0]  # words that can be read from a state
        self._known: dict = {}
        last, path = "", [0]  # path: states of the last word, not yet merged
        for word in words:
            shared = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                shared += 1
            self._merge(path, last, shared)
            for c in word[shared:]:
                self.edges.append({})
                self.final.append(False)
                self._words.append(0)
                new = len(self.edges) - 1
                self.edges[path[-1]][c] = new
                path.append(new)
            self.final[path[-1]] = True
            last = word
        self._merge(path, last, 0)
        self._number(0)
        del self._words, self._known

    def _number(self, state: int) -> None:
        total = int(self.final[state])
        for c, to in self.edges[state].items():  # letters were added in ascending order
            self.edges[state][c] = (to, total)
            total += self._words[to]
        self._words[state] = total

    def _merge(self, path: list[int], word: str, keep: int) -> None:
        """Closes the states beyond the first ``keep`` letters: each becomes the known state of the same future, or a new one."""
        while len(path) > keep + 1:
            state = path.pop()
            own = (self.final[state], tuple(self.edges[state].items()))
            known = self._known.get(own)
            if known is None:
                self._known[own] = state
                self._number(state)
                known = state
            elif state == len(self.edges) - 1:  # the newest state goes at once
                self.edges.pop()
                self.final.pop()
                self._words.pop()
            self.edges[path[-1]][word[len(path) - 1]] = known

    def follow(self, state: int, number: int, word: str, at: int) -> tuple[int, int] | None:
        """(state, number) after ``word[at:]``."""
        edges = self.edges
        for i in range(at, len(word)):
            step = edges[state].get(word[i])
            if step is None:
                return None
            state = step[0]
            number += step[1]
        return state, number

    def number(self, word: str) -> int | None:
        end = self.follow(0, 0, word, 0)
        return end[1] if end and self.final[end[0]] else None

    def one_error(self, word: str, exact: int, same: bool, longer: bool, shorter: bool):
        """Numbers of the words that begin with the first ``exact`` letters of ``word`` and differ by one replaced, added or
        missing letter behind them, each once: an added or missing letter of a run of equal ones counts as its last."""
        begin = self.follow(0, 0, word[:exact], 0)
        if begin is None:
            return
        (state, number), size = begin, len(word)
        for i in range(exact, size + 1):
            own = word[i] if i < size else None
            for c, (to, skipped) in self.edges[state].items():
                if c == own:
                    continue
                if same and own is not None:
                    end = self.follow(to, number + skipped, word, i + 1)
                    if end and self.final[end[0]]:
                        yield end[1]
                if longer:
                    end = self.follow(to, number + skipped, word, i)
                    if end and self.final[end[0]]:
                        yield end[1]
            if own is None:
                return
            if shorter and (i + 1 == size or word[i + 1] != own):
                end = self.follow(state, number, word, i + 1)
                if end and self.final[end[0]]:
                    yield end[1]
            step = self.edges[state].get(own)
            if step is None:
                return
            state = step[0]
            number += step[1]
