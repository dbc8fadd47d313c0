"""Suffix automata of sequences of numbers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class Automaton:
    """The suffix automaton of some sequences: where each state goes on (``goes``), the state of its longest suffix that occurs elsewhere too
    (``back``), the length of its longest stretch (``size``), where its stretches end first in their sequence (``ends``), and the state of
    each whole sequence (``whole``)."""

    def __init__(self, sequences: Iterable[Sequence[int]]):
        self.goes: list[dict[int, int]] = [{}]
        self.back, self.size, self.ends = [-1], [0], [-1]
        self.whole = [self._insert(x) for x in sequences]

    def _state(self, goes: dict[int, int], size: int, back: int, end: int) -> int:
        self.goes.append(goes)
        self.size.append(size)
        self.back.append(back)
        self.ends.append(end)
        return len(self.size) - 1

    def _part(self, at: int, mark: int, longer: int) -> int:
        """Gives the stretches that ``at`` and what lies behind it reach by ``mark`` a state of their own, apart from ``longer`` ones."""
        goes, back = self.goes, self.back
        to = self._state(dict(goes[longer]), self.size[at] + 1, back[longer], self.ends[longer])
        back[longer] = to
        while at >= 0 and goes[at].get(mark) == longer:
            goes[at][mark] = to
            at = back[at]
        return to

    def _insert(self, marks: Sequence[int]) -> int:
        goes, back, size = self.goes, self.back, self.size
        whole = 0
        for i, mark in enumerate(marks):
            to = goes[whole].get(mark)
            if to is not None:  # another sequence has this stretch
                whole = to if size[to] == size[whole] + 1 else self._part(whole, mark, to)
                continue
            at, whole = whole, self._state({}, i + 1, 0, i)
            while at >= 0 and mark not in goes[at]:
                goes[at][mark] = whole
                at = back[at]
            if at >= 0:
                to = goes[at][mark]
                back[whole] = to if size[to] == size[at] + 1 else self._part(at, mark, to)
        return whole
