"""Extremely randomised trees against a plain recursive version, and odd tables."""

import hashlib

import numpy as np
import pytest

from scorewright.operators import trees

COLS = ["p", "q", "constant", "noise"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        p, q = float(rng.normal()), int(rng.integers(0, 9))
        rows.append((p, q, 1.0, None if i % 50 == 0 else float(rng.normal()), float((p > 0.3) + 2 * (q > 4)) if i % 40 else None))
    rows += [rows[3]] * 60  # repeated rows
    return rows, spark.createDataFrame(rows, "p double, q int, constant double, noise double, y double").repartition(6)


def plain(rows, tree, tries, depth, seed):
    """(node -> (feature, cut, n, n_left)) of one tree."""
    rows = [([0.0 if v is None else float(v) for v in r[:-1]], r[-1]) for r in rows if r[-1] is not None]
    out = {}

    def gini(part):
        ys = [y for _, y in part]
        return sum(ys.count(c) ** 2 for c in set(ys)) / len(ys)

    def grow(part, node, level):
        if level == depth or len({y for _, y in part}) < 2:
            return
        drawn = []
        for j in range(len(part[0][0])):
            vs = [x[j] for x, _ in part]
            if min(vs) < max(vs):
                d = hashlib.md5(f"{seed}:{tree}:{node}:{j}".encode()).hexdigest()
                drawn.append((d, j, min(vs) + int(d[24:], 16) / 2 ** 32 * (max(vs) - min(vs))))
        best = None
        for _, j, cut in sorted(drawn)[:tries]:
            a, b = [r for r in part if r[0][j] <= cut], [r for r in part if r[0][j] > cut]
            if a and b and (best is None or (gini(a) + gini(b), -j) > best[0]):
                best = (gini(a) + gini(b), -j), j, cut, a, b
        if best:
            _, j, cut, a, b = best
            out[node] = (j, round(cut, 9), len(part), len(a))
            grow(a, 2 * node + 1, level + 1)
            grow(b, 2 * node + 2, level + 1)

    grow(rows, 0, 0)
    return out


def test_trees_equal_a_plain_recursion(frame):
    rows, df = frame
    model = trees.fit(df, COLS, "y", trees=6, tries=2, depth=5, seed=7)
    for tree in range(6):
        got = {n: (f, round(c, 9), k, left) for t, n, f, c, _, k, left in model.splits if t == tree}
        assert got == plain(rows, tree, 2, 5, 7) and len(got) > 3
    share = model.importances()
    assert abs(sum(share) - 1) < 1e-9 and min(share) >= 0 and share[2] == 0
    assert share[0] > share[3] and share[1] > share[3]
    again = trees.fit(df.repartition(2), COLS, "y", trees=6, tries=2, depth=5, seed=7)
    assert sorted(again.splits) == sorted(model.splits)


def test_nothing_to_split(frame):
    _, df = frame
    for part in (df.limit(0), df.filter("y = 3"), df.filter("y is null")):
        model = trees.fit(part, COLS, "y", trees=3)
        assert model.splits == [] and model.importances() == [0.0] * 4
    assert trees.fit(df, ["constant"], "y", trees=2).splits == []
