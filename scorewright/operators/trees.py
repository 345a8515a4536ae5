"""Extremely randomised classification trees over all rows, grown level by level.

A node draws ``tries`` of the features that vary in it, and for each one cut uniformly between the
feature's smallest and largest value there; the cut with the largest fall of Gini impurity splits the node
(ties: the first feature).  Draws are read off md5("<seed>:<tree>:<node>:<feature>"), so they are the same
after a lost task, at any partitioning, and in SQL.  A node is split until it is pure, no feature varies in it
or it lies ``depth`` levels down.

A level takes two jobs for all trees at once: the ranges of all features per (tree, node), then the class
counts left of each cut per (tree, node, cut).  Both are sums of what each task finds in its rows, combined
before they are shuffled; a hot topic or score is one row per task.  Nodes are numbered as in a heap, so a
model is two arrays of trees x 2^(depth + 1) entries, and what a level sends out or returns is bounded by
trees x 2^depth x tries, whatever the input.  Null and NaN features count as 0; rows without a target are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Trees, features that a node tries (about the root of 28), levels below the root, seed.
TREES, TRIES, DEPTH, SEED = 100, 5, 10, 26


@dataclass
class Trees:
    """``feature`` (-1 for a leaf) and ``cut`` per tree and heap number; ``splits``: (tree, node, feature, cut, gain,
    n, n_left) of every split; ``n_rows`` that were learnt from."""
    features: list[str]
    feature: np.ndarray
    cut: np.ndarray
    splits: list[tuple]
    n_rows: int

    def importances(self) -> list[float]:
        """Falls of impurity by feature: shares within a tree, averaged over the trees that split at all."""
        fall = np.zeros((len(self.feature), len(self.features)))
        for tree, _, feature, _, gain, _, _ in self.splits:
            fall[tree, feature] += gain
        total = fall.sum(axis=1)
        share = fall[total > 0] / total[total > 0, None]
        return (share.mean(axis=0) if len(share) else fall.sum(axis=0)).tolist()


def _matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    return np.stack([batch[c].to_numpy(zero_copy_only=False) for c in features], 1)


def walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row in each tree after at most ``levels`` steps from the root; it stays where a leaf is."""
    node, rows, tree = np.zeros((len(x), len(feature)), np.int64), np.arange(len(x))[:, None], np.arange(len(feature))
    for _ in range(levels):
        f = feature[tree, node]
        node = np.where(f < 0, node, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > cut[tree, node]))
    return node


def _open_rows(x, feature, cut, level: int, is_open: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, tree * 2^level + place) for every row and tree in which the row lies in an open node of the level."""
    place = walk(x, feature, cut, level) - (2 ** level - 1)
    row, tree = np.nonzero((place >= 0) & is_open[np.arange(len(feature)), np.maximum(place, 0)])
    return row, tree * 2 ** level + place[row, tree]


def _ranges(features: list[str], feature, cut, level: int, is_open: np.ndarray):
    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.full((is_open.size, len(features)), np.inf)
        high = -low
        for batch in batches:
            x = _matrix(batch, features)
            row, key = _open_rows(x, feature, cut, level, is_open)
            if not len(key):
                continue
            order = np.argsort(key, kind="stable")
            key, row = key[order], row[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for j in range(len(features)):  # one column at a time: a batch's rows are never copied for all features
                v = x[row, j]
                low[key[first], j] = np.minimum(low[key[first], j], np.minimum.reduceat(v, first))
                high[key[first], j] = np.maximum(high[key[first], j], np.maximum.reduceat(v, first))
        some = np.flatnonzero(np.isfinite(low[:, 0]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), *(pa.array(low[some, j]) for j in range(len(features))),
             *(pa.array(high[some, j]) for j in range(len(features)))],
            ["key", *(f"low{j}" for j in range(len(features))), *(f"high{j}" for j in range(len(features)))])
    return ranges


def _counts(features: list[str], classes: list[float], feature, cut, level: int, tried: np.ndarray, at: np.ndarray):
    """``tried``, ``at``: features (-1 for none) and cuts per key of the level."""
    is_open = (tried[:, 0] >= 0).reshape(len(feature), -1)
    tries, k = tried.shape[1], len(classes)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, total = np.zeros(len(tried) * tries * k, np.int64), np.zeros(len(tried) * k, np.int64)
        for batch in batches:
            x, y = _matrix(batch, features), np.searchsorted(classes, batch["target"].to_numpy(zero_copy_only=False))
            row, key = _open_rows(x, feature, cut, level, is_open)
            total += np.bincount(key * k + y[row], minlength=len(total))
            for t in range(tries):
                f = tried[key, t]
                some = (f >= 0) & (x[row, np.maximum(f, 0)] <= at[key, t])
                left += np.bincount((key[some] * tries + t) * k + y[row[some]], minlength=len(left))
        key, t = np.nonzero(np.logical_and(tried >= 0, total.reshape(-1, k).any(axis=1)[:, None]))
        left, total = left.reshape(-1, tries, k)[key, t], total.reshape(-1, k)[key]
        yield pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(tried[key, t].astype(np.int64)), pa.array(at[key, t]),
             *(pa.array(left[:, c]) for c in range(k)), *(pa.array(total[:, c]) for c in range(k))],
            ["key", "feature", "cut", *(f"l{c}" for c in range(k)), *(f"t{c}" for c in range(k))])
    return counts


def draw(ranges: DataFrame, features: list[str], level: int, tries: int, seed: int) -> DataFrame:
    """(key, drawn): the features that a node tries, with their cuts, from its ``ranges``."""
    tree, node = F.floor(F.col("key") / 2 ** level), F.col("key") % 2 ** level + (2 ** level - 1)
    each = []
    for j in range(len(features)):
        digest = F.md5(F.concat_ws(":", F.lit(seed), tree, node, F.lit(j)))
        share = F.conv(F.substring(digest, 25, 8), 16, 10).cast("double") / 2.0 ** 32
        cut = F.col(f"low{j}") + share * (F.col(f"high{j}") - F.col(f"low{j}"))
        each.append(F.when(F.col(f"low{j}") < F.col(f"high{j}"), F.struct(
            digest.alias("digest"), F.lit(j).alias("feature"), cut.alias("cut"))))
    drawn = F.slice(F.array_sort(F.array_compact(F.array(*each))), 1, tries)
    return ranges.select("key", drawn.alias("drawn")).filter(F.size("drawn") > 0)


def best_splits(counts: DataFrame, k: int) -> DataFrame:
    """(key, feature, cut, gain, n, n_left, whether the left and the right part are pure): each node's best cut."""
    def total(cs):
        return sum(cs[1:], cs[0])

    left = [F.col(f"l{c}").cast("double") for c in range(k)]
    both = [F.col(f"t{c}").cast("double") for c in range(k)]
    right = [b - a for a, b in zip(left, both)]
    n_left, n, n_right = total(left), total(both), total(right)
    squares = [total([c * c for c in cs]) for cs in (left, right, both)]
    gain = squares[0] / n_left + squares[1] / n_right - squares[2] / n
    split = F.struct(gain.alias("gain"), (-F.col("feature")).alias("order"), F.col("feature"), F.col("cut"), n.alias("n"),
                     n_left.alias("n_left"), (F.greatest(*left, F.lit(0.0)) == n_left).alias("left_pure"),
                     (F.greatest(*right, F.lit(0.0)) == n_right).alias("right_pure"))
    return (counts.filter((n_left > 0) & (n_right > 0) & (F.greatest(*both, F.lit(0.0)) < n))
            .groupBy("key").agg(F.max(split).alias("s")).select("key", "s.*"))


def fit(df: DataFrame, features: list[str], target: str, trees: int = TREES, tries: int = TRIES, depth: int = DEPTH,
        seed: int = SEED) -> Trees:
    """Trees on ``features`` for the classes of ``target`` (a handful); ``df`` is read twice a level: stage it."""
    rows = df.select(F.col(target).cast("double").alias("target"), *(
        F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in features)).filter("target is not null")
    seen = sorted((r["target"], r["n"]) for r in rows.groupBy("target").agg(F.count("*").alias("n")).collect())
    classes = [c for c, _ in seen]
    size = 2 ** (depth + 1) - 1
    model = Trees(features, np.full((trees, size), -1, np.int64), np.zeros((trees, size)), [], sum(n for _, n in seen))
    is_open = np.full((trees, 1), len(classes) > 1)
    low, high = ([f"{s}{j}" for j in range(len(features))] for s in ("low", "high"))
    sums = [f"{s}{c}" for s in "lt" for c in range(len(classes))]
    for level in range(depth):
        if not is_open.any():
            break
        found = rows.mapInArrow(_ranges(features, model.feature, model.cut, level, is_open),
                                ", ".join(["key long", *(f"{c} double" for c in low + high)]))
        found = found.groupBy("key").agg(*(F.min(c).alias(c) for c in low), *(F.max(c).alias(c) for c in high))
        tried, at = np.full((is_open.size, tries), -1, np.int64), np.zeros((is_open.size, tries))
        for r in draw(found, features, level, tries, seed).collect():  # at most trees x 2^level rows
            for t, d in enumerate(r["drawn"]):
                tried[r["key"], t], at[r["key"], t] = d["feature"], d["cut"]
        counted = rows.mapInArrow(_counts(features, classes, model.feature, model.cut, level, tried, at), ", ".join(
            ["key long, feature long, cut double", *(f"{c} long" for c in sums)]))
        counted = counted.groupBy("key", "feature", "cut").agg(*(F.sum(c).alias(c) for c in sums))
        is_open = np.zeros((trees, 2 ** (level + 1)), bool)
        for r in best_splits(counted, len(classes)).collect():
            tree, place = divmod(r["key"], 2 ** level)
            node = place + 2 ** level - 1
            model.feature[tree, node], model.cut[tree, node] = r["feature"], r["cut"]
            model.splits.append((tree, node, r["feature"], r["cut"], r["gain"], int(r["n"]), int(r["n_left"])))
            is_open[tree, 2 * place], is_open[tree, 2 * place + 1] = not r["left_pure"], not r["right_pure"]
    return model
