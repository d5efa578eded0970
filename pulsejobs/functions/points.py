"""Interest points of cycles: maxima and minima of the first and second derivative, told by a table of searches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import types as T

from .vec import ampd, kernel_udf

NAMES = ("w", "y", "z", "a", "b", "c", "d", "e")
#: The share of the second derivative in which waves and troughs are looked for, and how far a stretch reaches into the rest.
SHOWN, REACH = 0.6, 0.4

Points = dict[str, np.ndarray]
Bound = Callable[[Points], np.ndarray | int]


@dataclass(frozen=True)
class Search:
    """One way to find a point, in all cycles of a stack at once.

    ``kind``: ``scale`` looks at the multi-scale maxima, ``local`` at the
    strict maxima of the stretch alone (a plateau counts at its middle, what
    touches an end does not count), ``sample`` at every sample of the stretch.
    Minima are maxima of the curve times ``sign``. ``start`` (in) and ``stop``
    (out) bound the stretch; places must also lie strictly between
    ``after`` and ``before``. The highest place is taken, or with ``first``
    the first; ``shift`` is added to it.
    """

    kind: str
    sign: int
    start: Bound
    stop: Bound
    after: Bound = lambda p: -1
    before: Bound = lambda p: p["end"]
    first: bool = False
    shift: int = 0


def _reach(start: str) -> Bound:
    return lambda p: p[start] + ((p["end"] - p[start]) * REACH).astype(int)


#: For each point the searches in the order in which they are tried. ``end`` is the length of the curve, ``shown`` of its part in view.
VELOCITY: dict[str, list[Search]] = {
    "w": [Search("sample", 1, lambda p: 0, lambda p: p["peak"])],
    "y": [
        Search("scale", -1, lambda p: 0, lambda p: p["end"], after=lambda p: p["peak"], first=True),
        Search("sample", -1, lambda p: p["peak"], _reach("peak")),
    ],
    "z": [Search("sample", 1, lambda p: p["y"], _reach("y"))],
}
ACCELERATION: dict[str, list[Search]] = {
    "a": [
        Search("scale", 1, lambda p: 0, lambda p: p["shown"], before=lambda p: p["peak"] + 1, first=True),
        Search("sample", 1, lambda p: 0, lambda p: p["peak"]),
    ],
    "e": [
        Search("scale", 1, lambda p: 0, lambda p: p["shown"], after=lambda p: p["y"]),
        Search("sample", 1, lambda p: p["y"] + 1, lambda p: p["end"], shift=-1),
    ],
    "b": [
        Search("local", -1, lambda p: 0, lambda p: p["shown"], after=lambda p: np.maximum(p["a"], p["w"]), before=lambda p: np.minimum(p["e"], p["peak"] - 2), first=True),
        Search("local", -1, lambda p: p["w"], lambda p: p["upstroke"], first=True),
        Search("sample", -1, lambda p: p["w"], lambda p: p["upstroke"]),
    ],
    "d": [
        Search("local", -1, lambda p: p["peak"], lambda p: p["e"]),
        Search("sample", -1, lambda p: p["peak"], lambda p: p["e"]),
    ],
    "c": [
        Search("local", 1, lambda p: p["b"], lambda p: p["d"] + 1),
        Search("sample", 1, lambda p: p["b"], lambda p: p["d"]),
    ],
}


def plateaus(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For stacked rows: first and last sample of the plateau whose middle a place is, where it is a strict maximum; -1 elsewhere."""
    rows, n = x.shape
    first, last = np.full((rows, n), -1), np.full((rows, n), -1)
    if n < 3:
        return first, last
    begins = np.ones((rows, n), bool)
    begins[:, 1:] = x[:, 1:] != x[:, :-1]
    at = np.flatnonzero(begins)
    stop = np.append(at[1:], rows * n) - 1
    flat = x.ravel()
    inside = (at % n > 0) & (stop % n < n - 1)
    left, right = flat[np.maximum(at - 1, 0)], flat[np.minimum(stop + 1, rows * n - 1)]
    top = inside & (flat[at] > left) & (flat[at] > right)
    middle = (at[top] + stop[top]) // 2
    first.ravel()[middle], last.ravel()[middle] = at[top] % n, stop[top] % n
    return first, last


def _column(bound: np.ndarray | int, rows: int) -> np.ndarray:
    return np.broadcast_to(np.asarray(bound), rows)[:, None]


def _scale_maxima(x: np.ndarray) -> np.ndarray:
    found = np.zeros(x.shape, bool)
    if x.shape[1] > 2:
        for r, at in enumerate(ampd(x, max(1, x.shape[1] // 2))):
            found[r, at] = True
    return found


class Curve:
    """A stack of curves of one length, with the maxima that searches ask for computed once."""

    def __init__(self, x: np.ndarray, shown: int) -> None:
        self.x, self.shown = x, shown
        self._scale: dict[tuple[int, int], np.ndarray] = {}
        self._plateaus: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def places(self, s: Search, p: Points) -> np.ndarray:
        """Which places of each row the search may take."""
        rows, n = self.x.shape
        at = np.arange(n)
        start, stop = _column(s.start(p), rows), _column(s.stop(p), rows)
        found = (at >= start) & (at < stop) & (at > _column(s.after(p), rows)) & (at < _column(s.before(p), rows))
        if s.kind == "scale":
            seen = (s.sign, int(np.max(stop, initial=0)))
            if seen not in self._scale:
                self._scale[seen] = _scale_maxima(s.sign * self.x[:, : seen[1]])
            found[:, : seen[1]] &= self._scale[seen]
            found[:, seen[1] :] = False
        elif s.kind == "local":
            if s.sign not in self._plateaus:
                self._plateaus[s.sign] = plateaus(s.sign * self.x)
            first, last = self._plateaus[s.sign]
            found &= (first > start) & (last < stop - 1)
        return found

    def find(self, s: Search, p: Points) -> np.ndarray:
        """The place by row, -1 where there is none."""
        if not self.x.shape[1]:
            return np.full(len(self.x), -1)
        places = self.places(s, p)
        worth = np.where(places, 0.0 if s.first else s.sign * self.x, -np.inf)
        return np.where(places.any(axis=1), worth.argmax(axis=1) + s.shift, -1)


def locate(curve: Curve, table: dict[str, list[Search]], p: Points, wanted: Callable[[str, Points], np.ndarray]) -> np.ndarray:
    """Adds the points of a table to ``p``, and which search found each (its number; -1: none); returns the rows in which a wanted point was not found. Unwanted ones are 0."""
    failed = np.zeros(len(curve.x), bool)
    for name, searches in table.items():
        place, how = np.full(len(curve.x), -1), np.full(len(curve.x), -1)
        for number, s in enumerate(searches):
            open_rows = how < 0
            found = curve.find(s, p)
            # a shifted place may be -1 as well, so the row is told by its places
            hit = open_rows & (curve.places(s, p).any(axis=1) if curve.x.shape[1] else False)
            place[hit], how[hit] = found[hit], number
        need = wanted(name, p)
        failed |= need & (how < 0)
        p[name], p[f"how_{name}"] = np.where(need & (how >= 0), place, 0), np.where(need, how, -1)
    return failed


def stacked_points(cycles: np.ndarray, peaks: np.ndarray) -> tuple[Points, np.ndarray]:
    """All points of cycles of one length, and the rows that have none because a search had an empty stretch.

    w: steepest rise before the peak. y: first fall after it. z: steepest rise
    in the next two fifths after y. If the first 60 % of the second
    derivative show no wave or no trough, a to e are 0; without a trough
    behind a and w all but a are. a: first wave, or the highest sample before
    the peak if that wave comes later. e: highest wave after y. b: first
    trough up to shortly before the peak. d: lowest trough between the peak
    and e. c: highest wave from b to d. The tables give what counts
    where such a wave or trough is missing.
    """
    velocity = np.diff(cycles, axis=1)
    peaks = peaks.astype(int)
    p: Points = {"peak": peaks, "end": np.full(len(cycles), velocity.shape[1])}
    failed = locate(Curve(velocity, velocity.shape[1]), VELOCITY, p, lambda name, p: np.ones(len(cycles), bool))
    second = np.diff(velocity, axis=1)
    n = second.shape[1]
    shown = int(n * SHOWN)
    # shortly before the peak; for a peak at the second sample this counts from the end
    p |= {"end": np.full(len(cycles), n), "shown": np.full(len(cycles), shown), "upstroke": np.where(peaks < 2, n + peaks - 2, peaks - 2)}
    curve = Curve(second, shown)
    trough = Search("local", -1, lambda p: 0, lambda p: p["shown"])
    if n:
        in_view = _scale_maxima(second[:, :shown]).any(axis=1) & curve.places(trough, p).any(axis=1)
    else:
        in_view = np.zeros(len(cycles), bool)

    def wanted(name: str, p: Points) -> np.ndarray:
        if name == "a":
            return in_view
        behind = Search("local", -1, lambda p: 0, lambda p: p["shown"], after=lambda p: np.maximum(p["a"], p["w"]))
        return in_view & (curve.places(behind, p).any(axis=1) if n else False)

    return p, failed | locate(curve, ACCELERATION, p, wanted)


def points(cycle: np.ndarray, peak: int) -> tuple[int, ...] | None:
    """All points of a cycle, or None if it gives no features."""
    p, failed = stacked_points(np.asarray(cycle, float)[None], np.array([peak]))
    return None if failed[0] else tuple(int(p[n][0]) for n in NAMES)


@kernel_udf(T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in NAMES])))
def cycle_points(cycles: pd.Series, peaks: pd.Series) -> pd.Series:
    """Points of each cycle of a list with its peak; the cycles of a batch are stacked by length."""
    out: list[list] = []
    stacks: dict[int, list[tuple[int, int]]] = {}
    for row, (cs, ps) in enumerate(zip(cycles, peaks, strict=True)):
        n = min(len(cs), len(ps)) if cs is not None and ps is not None else 0
        out.append([None] * n)
        for k in range(n):
            stacks.setdefault(len(cs[k]), []).append((row, k))
    for members in stacks.values():
        stack = np.stack([np.asarray(cycles.iloc[r][k], float) for r, k in members])
        p, failed = stacked_points(stack, np.array([int(peaks.iloc[r][k]) for r, k in members]))
        for i in np.flatnonzero(~failed):
            r, k = members[i]
            out[r][k] = {n: int(p[n][i]) for n in NAMES}
    return pd.Series(out)
