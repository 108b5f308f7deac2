"""Peak search in pieces of a series, in numpy: helpers of the functions in ``peaks``."""

from __future__ import annotations

import numpy as np


class Search:
    """Where a series first rises above, or sinks to, a level; by the extremes of its blocks."""

    def __init__(self, v: np.ndarray, block: int = 128):
        self.v, self.block = v, block
        starts = np.arange(0, len(v), block)
        self.high, self.low = np.maximum.reduceat(v, starts), np.minimum.reduceat(v, starts)

    def first(self, start: int, level: float, above: bool) -> int:
        """The first place from ``start`` on whose value is above the level (else: at it or below); -1: none."""
        fits = (lambda x: x > level) if above else (lambda x: x <= level)
        b = start // self.block
        hit = np.flatnonzero(fits(self.v[start : (b + 1) * self.block]))
        if len(hit):
            return start + int(hit[0])
        blocks = np.flatnonzero(fits((self.high if above else self.low)[b + 1 :]))
        if not len(blocks):
            return -1
        a = (b + 1 + int(blocks[0])) * self.block
        return a + int(np.flatnonzero(fits(self.v[a : a + self.block]))[0])


def level_runs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], np.diff(v) != 0]))
    return starts, np.concatenate([starts[1:], [len(v)]])


def summits(v: np.ndarray) -> np.ndarray:
    """The middles of the runs that are higher than both neighbours; the first and last run have but one."""
    starts, ends = level_runs(v)
    if len(starts) < 3:
        return np.zeros(0, np.int64)
    level = v[starts]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    return (starts[top] + ends[top] - 1) // 2


def settle(p: np.ndarray, v: np.ndarray, fate: np.ndarray, distance: int, lo: float, hi: float) -> np.ndarray:
    """Which of the summits at ``p`` (ascending) stay if, from the highest on and of equals from the later
    on, each one that stays removes those closer than ``distance``: 1 stays, -1 goes, 0 can't be told yet.

    ``fate`` holds what is known already. Summits between ``lo`` and ``hi`` are all given; what hangs on
    others stays open.
    """
    order = np.lexsort((p, v))[::-1]
    rank = np.empty(len(p), np.int64)
    rank[order] = np.arange(len(p))
    fate = fate.copy()
    first, last = np.searchsorted(p, p - distance, "right"), np.searchsorted(p, p + distance, "left")
    for k in order.tolist():
        if fate[k]:
            continue
        near = slice(first[k], last[k])
        if (fate[near] == 1).any():
            fate[k] = -1
        elif ((fate[near] == 0) & (rank[near] < rank[k])).any() or p[k] - distance < lo or p[k] + distance > hi:
            continue
        else:
            fate[k] = 1
    return fate


def ends_of_runs(chunks: list[dict], size: int) -> list[tuple[int, float]]:
    """Summits in runs that touch a border between chunks, from each chunk's first and last run, in order."""
    out: list[tuple[int, float]] = []
    run: tuple[int, float, float | None] | None = None  # start, value, the value before it

    def close(end: int, after: float) -> None:
        start, value, before = run
        if before is not None and value > before and value > after:
            out.append(((start + end) // 2, value))

    for ch in chunks:
        base, single = ch["c"] * size, ch["first_len"] == ch["len"]
        if run is None or run[1] != ch["first"]:
            if run is not None:
                close(base - 1, ch["first"])
            run = (base, ch["first"], None if run is None else run[1])
        if not single:
            close(base + ch["first_len"] - 1, ch["after"])
            run = (base + ch["len"] - ch["last_len"], ch["last"], ch["before"])
    return out
