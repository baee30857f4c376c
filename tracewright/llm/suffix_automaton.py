"""Suffix automata over words: every run of words of some references, with the least owner of each."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

#: Owner of no reference; above all others.
NOBODY = (1 << 63) - 1


class SuffixAutomaton:
    """All runs of words of the references added so far. Words are integers; owners are compared as integers.

    A state stands for the runs that end at the same places. size is the length of its longest run, up the state of its
    longest run that ends at more places, and least the smallest owner of any of its runs once settle() has been called.
    """

    def __init__(self) -> None:
        self.then: list[dict[int, int]] = [{}]
        self.up = [-1]
        self.size = [0]
        self.least = [NOBODY]

    def _state(self, then: dict[int, int], up: int, size: int) -> int:
        self.then.append(then)
        self.up.append(up)
        self.size.append(size)
        self.least.append(NOBODY)
        return len(self.size) - 1

    def _split(self, above: int, word: int) -> int:
        """The state of the longest run of `above` with the word after it, apart from longer runs."""
        whole = self.then[above][word]
        if self.size[whole] == self.size[above] + 1:
            return whole
        part = self._state(dict(self.then[whole]), self.up[whole], self.size[above] + 1)
        self.up[whole] = part
        while above >= 0 and self.then[above].get(word) == whole:
            self.then[above][word] = part
            above = self.up[above]
        return part

    def add(self, words: Sequence[int], owner: int) -> None:
        last = 0
        for word in words:
            if word in self.then[last]:
                last = self._split(last, word)
            else:
                new, at = self._state({}, 0, self.size[last] + 1), last
                while at >= 0 and word not in self.then[at]:
                    self.then[at][word] = new
                    at = self.up[at]
                if at >= 0:
                    self.up[new] = self._split(at, word)
                last = new
            self.least[last] = min(self.least[last], owner)

    def settle(self) -> None:
        """Hands owners on from longer runs to those that they end with."""
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            up = self.up[state]
            self.least[up] = min(self.least[up], self.least[state])

    def statistics(self, words: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
        """For each word, the length (at most `most`) of the longest run that ends there and a reference holds, and its least owner."""
        at, length = 0, 0
        for word in words:
            while at and word not in self.then[at]:
                at = self.up[at]
                length = self.size[at]
            if word in self.then[at]:
                at, length = self.then[at][word], length + 1
            if length >= most:
                length = most
                while self.size[self.up[at]] >= most:
                    at = self.up[at]
            yield length, self.least[at] if length else NOBODY
