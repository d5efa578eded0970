"""Interest points against loops over single cycles; every search of the tables must have been needed."""

import numpy as np
import pytest

from pulsejobs.functions import points as P
from pulsejobs.functions.vec import ampd


def hills(x):
    """Places of strict maxima inside a list; a plateau at its middle."""
    out, i = [], 1
    while i < len(x) - 1:
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            out.append((i + j) // 2)
        i = j + 1
    return out


def scale_hills(x):
    return list(ampd(np.array(x)[None], max(1, len(x) // 2))[0]) if len(x) > 2 else []


def best(places, x):
    return max(places, key=lambda i: (x[i], -i))


def only(items):
    """The items, or an error like that of an empty search."""
    if not items:
        raise ValueError("empty")
    return items


def by_definition(cycle, peak):
    v = [b - a for a, b in zip(cycle, cycle[1:], strict=False)]
    minus = [-x for x in v]
    w = best(only(range(min(peak, len(v)))), v)
    later = [i for i in scale_hills(minus) if i > peak]
    y = later[0] if later else best(only(range(peak, min(len(v), peak + int((len(v) - peak) * 0.4)))), minus)
    z = best(only(range(y, min(len(v), y + int((len(v) - y) * 0.4)))), v)
    q = [b - a for a, b in zip(v, v[1:], strict=False)]
    down = [-x for x in q]
    view = int(len(q) * 0.6)
    waves, troughs = scale_hills(q[:view]), hills(down[:view])
    if not waves or not troughs:
        return w, y, z, 0, 0, 0, 0, 0
    a = waves[0] if waves[0] <= peak else best(only(range(min(peak, len(q)))), q)
    troughs = [i for i in troughs if i > a and i > w]
    if not troughs:
        return w, y, z, a, 0, 0, 0, 0
    behind = [i for i in waves if i > y]
    e = best(behind, q) if behind else best(only(range(y + 1, len(q))), q) - 1
    early = [i for i in troughs if i < e and i < peak - 2]
    stretch = list(range(len(q)))[w : peak - 2]
    local = [stretch[i] for i in hills([down[j] for j in stretch])]
    b = early[0] if early else local[0] if local else best(only(stretch), down)
    stretch = list(range(len(q)))[peak:e]
    local = [stretch[i] for i in hills([down[j] for j in stretch])]
    d = best(local, down) if local else best(only(stretch), down)
    stretch = list(range(len(q)))[b : d + 1]
    local = [stretch[i] for i in hills([q[j] for j in stretch])]
    c = best(local, q) if local else best(only(list(range(len(q)))[b:d]), q)
    return w, y, z, a, b, c, d, e


def expected(cycle, peak):
    try:
        return by_definition(list(cycle), peak)
    except ValueError:
        return None


def cycles_of_all_kinds():
    rng = np.random.default_rng(17)
    out = []
    for _ in range(400):  # pulses: smooth, with a second wave, some with few levels so that plateaus come up
        n = int(rng.integers(20, 90))
        t = np.arange(n) / n
        x = np.exp(-(((t - rng.uniform(0.1, 0.5)) / rng.uniform(0.05, 0.2)) ** 2)) + rng.uniform(0, 0.8) * np.exp(-(((t - rng.uniform(0.3, 0.9)) / rng.uniform(0.05, 0.2)) ** 2))
        x = x + rng.normal(0, rng.choice([0, 0.002, 0.05]), n)
        out.append((np.round(x, int(rng.choice([1, 2, 12]))), int(np.argmax(x))))
    for _ in range(600):  # anything: short, flat, a peak at the edges
        n = int(rng.integers(2, 24))
        out.append((rng.integers(0, int(rng.choice([2, 4, 50])), n).astype(float), int(rng.integers(0, n))))
    return out


def test_points_are_those_of_the_definition():
    missing = 0
    for cycle, peak in cycles_of_all_kinds():
        assert P.points(cycle, peak) == expected(cycle, peak), (cycle.tolist(), peak)
        missing += expected(cycle, peak) is None
    assert missing > 50


def test_every_search_is_needed():
    used = {(n, k): 0 for table in (P.VELOCITY, P.ACCELERATION) for n, s in table.items() for k in range(len(s))}
    blank = 0
    for cycle, peak in cycles_of_all_kinds():
        p, failed = P.stacked_points(cycle[None], np.array([peak]))
        for n, k in used:
            used[n, k] += not failed[0] and p[f"how_{n}"][0] == k
        blank += not failed[0] and p["how_a"][0] < 0
    assert min(used.values()) > 0 and blank > 0, used


def test_stacks_and_lists_agree(spark):
    every = cycles_of_all_kinds()
    rows = [(i, [c.tolist() for c, _ in every[i : i + 5]], [k for _, k in every[i : i + 5]]) for i in range(0, 400, 5)]
    rows += [(9001, None, None), (9002, [], []), (9003, [[1.0, 2.0, 1.0]], []), (9004, [[]], [0])]
    df = spark.createDataFrame(rows, "i int, cs array<array<double>>, ks array<int>").withColumn("p", P.cycle_points("cs", "ks"))
    for r in df.collect():
        want = [expected(c, k) for c, k in zip(r.cs or [], r.ks or [], strict=False)]
        assert [None if x is None else tuple(x) for x in r.p] == want, r.i


@pytest.mark.parametrize("x", [[0, 1, 0], [0, 1, 1, 0], [1, 1, 0], [0, 2, 2, 2, 1, 3, 0], [1, 2], [0, 0, 0]])
def test_plateaus(x):
    first, last = P.plateaus(np.array([x, x[::-1]], float))
    assert np.flatnonzero(first[0] >= 0).tolist() == hills(x)
    assert np.flatnonzero(first[1] >= 0).tolist() == hills(x[::-1])
    assert all(x[i] == x[j] for i, j in zip(first[0], last[0], strict=True) if i >= 0)
