"""A bidirectional FM-index over integer symbols, for runs of bounded length.

Places are ordered by the symbols that follow them, up to a given depth; ties keep the order of
the text. The symbols before the places in that order are the transform, and where a place moves
when its symbol is put in front is the rank of that symbol plus the start of its range. A second
index holds the text backwards. A run is an interval in both, and is made longer on either side
by what the transform of that side holds: the interval there follows from ranks, the other one
from how many smaller symbols there are. All intervals of one length are extended together.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


def _order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places by the ``depth`` or more symbols that follow them; beyond the end is smaller than all symbols."""
    n = len(symbols)
    rank, span = symbols.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while span < depth:
        width = np.int64(rank.max(initial=0) + 2)
        second = np.zeros(n, dtype=np.int64)
        second[: max(0, n - span)] = rank[span:] + 1
        key = rank * width + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1]))) if n else order
        span *= 2
    return order


class _OneWay(NamedTuple):
    before: np.ndarray
    moves: np.ndarray

    @staticmethod
    def of(symbols: np.ndarray, depth: int) -> _OneWay:
        order = _order(symbols, depth)
        before = symbols[order - 1]  # the text is a circle, and begins with a break
        moves = np.empty(len(symbols), dtype=np.int64)
        moves[np.argsort(before, kind="stable")] = np.arange(len(symbols))
        return _OneWay(before, moves)


class Runs(NamedTuple):
    """Runs of one length: their symbols, and where each begins in both orders, and how often it occurs."""

    symbols: np.ndarray
    left: np.ndarray
    right: np.ndarray
    count: np.ndarray


def _spread(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows of intervals, and the interval of each."""
    owner = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    return np.arange(len(owner)) - first[owner] + begin[owner], owner


class FmIndex:
    """Symbols are 1 and more; 0 is a break that no run reaches over."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.symbols = np.concatenate(([0], np.asarray(symbols, dtype=np.int64)))
        self.forward = _OneWay.of(self.symbols, depth)
        # Backwards, the break stays in front.
        self.backward = _OneWay.of(np.concatenate(([0], self.symbols[:0:-1])), depth)

    def single(self) -> Runs:
        """Runs of one symbol; their interval is the same in both orders."""
        found, count = np.unique(self.symbols, return_counts=True)
        begin = np.cumsum(count) - count
        kept = found > 0
        return Runs(found[kept][:, None], begin[kept], begin[kept], count[kept])

    def longer(self, runs: Runs, side: str) -> Runs:
        """Each run with one more symbol on the ``left`` or ``right``, as often as that occurs; without those that never do."""
        way, own, other = (self.forward, runs.left, runs.right) if side == "left" else (self.backward, runs.right, runs.left)
        rows, owner = _spread(own, runs.count)
        added = way.before[rows]
        order = np.lexsort((added, owner))
        rows, owner, added = rows[order], owner[order], added[order]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (added[1:] != added[:-1])
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(rows)))
        first_of_owner = np.cumsum(runs.count) - runs.count
        own = way.moves[rows[at]]
        other = other[owner[at]] + at - first_of_owner[owner[at]]
        kept = added[at] > 0
        old, put = runs.symbols[owner[at]][kept], added[at][kept][:, None]
        symbols = np.hstack((put, old) if side == "left" else (old, put))
        own, other, count = own[kept], other[kept], count[kept]
        return Runs(symbols, own, other, count) if side == "left" else Runs(symbols, other, own, count)


def enumerate_runs(symbols: np.ndarray, longest: int) -> list[Runs]:
    """All distinct runs of 2 to ``longest`` symbols with their counts, by length; extended right and left in turn."""
    index = FmIndex(symbols, longest)
    runs, found = index.single(), []
    for n in range(2, longest + 1):
        runs = index.longer(runs, "right" if n % 2 == 0 else "left")
        found.append(runs)
    return found
