"""How many elements sets have in common, for blocks of sets in memory, and which of them hang together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Overlaps:
    """The sets of a block by their elements. Elements that the same sets hold are one column with a weight, so
    near copies cost little; elements of one set alone are left out."""

    def __init__(self, elements: np.ndarray, owner: np.ndarray, sets: int):
        """``owner`` has the number of the set of each element; repeated elements of a set count once."""
        order = np.lexsort((owner, elements))
        elements, owner = elements[order], owner[order]
        new = np.ones(len(elements), bool)
        new[1:] = (elements[1:] != elements[:-1]) | (owner[1:] != owner[:-1])
        elements, owner = elements[new], owner[new]
        self.sets, self.size = sets, np.bincount(owner, minlength=sets)
        first = np.flatnonzero(np.concatenate(([True], elements[1:] != elements[:-1]))) if len(elements) else np.zeros(0, int)
        held = np.diff(np.concatenate((first, [len(elements)]))) if len(first) else np.zeros(0, int)
        weight = np.ones(len(first), int)
        if len(first):
            marks = np.random.default_rng(7).integers(1, 1 << 63, sets, dtype=np.uint64)
            _, kept, weight = np.unique(np.where(held > 1, np.add.reduceat(marks[owner], first), np.uint64(0)), return_index=True, return_counts=True)
            shared = held[kept] > 1
            kept, self.weight = kept[shared], weight[shared]
            first, held = first[kept], held[kept]
        else:
            self.weight = weight
        self.held = held
        total = int(held.sum())
        column = np.repeat(np.arange(len(first)), held)
        self.rows = owner[np.repeat(first - np.concatenate(([0], np.cumsum(held)[:-1])), held) + np.arange(total)] if total else np.zeros(0, int)
        by_set = np.argsort(self.rows, kind="stable")
        self.columns, self.cuts = column[by_set], np.searchsorted(self.rows[by_set], np.arange(sets + 1))
        self.starts = np.concatenate(([0], np.cumsum(held)))

    def count(self, i: int) -> np.ndarray | None:
        """The elements that set ``i`` has in common with each set; None if with none but itself."""
        own = self.columns[self.cuts[i] : self.cuts[i + 1]]
        if not len(own):
            return None
        lengths = self.held[own]
        at = np.repeat(self.starts[own] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(int(lengths.sum()))
        return np.bincount(self.rows[at], np.repeat(self.weight[own], lengths), self.sets).astype(np.int64)


class Links:
    """Counts of links and the groups that they form, without a list of pairs."""

    def __init__(self, sets: int):
        self.n, self.root = np.zeros(sets, np.int64), list(range(sets))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def add(self, i: int, partners: np.ndarray) -> None:
        self.n[i] += len(partners)
        self.n[partners] += 1
        for j in partners.tolist():
            a, b = self.find(i), self.find(j)
            if a != b:
                self.root[max(a, b)] = min(a, b)

    def rows(self, ids: list[int]) -> Iterator[tuple[int, int, int]]:
        """(id, its links, smallest id that it is linked to through others) for those that have links."""
        linked = np.flatnonzero(self.n).tolist()
        least: dict[int, int] = {}
        for i in linked:
            r = self.find(i)
            least[r] = min(least.get(r, ids[i]), ids[i])
        for i in linked:
            yield ids[i], int(self.n[i]), least[self.find(i)]
