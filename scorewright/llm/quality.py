"""Operator 4: quality by hierarchical empirical Bayes.

*Document evidence.*  For each label (good quality, toxic) a sparse logistic
regression over hashed words and shape features (shares of symbols, capitals and
digits, vocabulary richness, immediate repeats, length), fitted on a bounded
sample of labelled rows (``SAMPLE``), gives every document a probability.

*Sites.*  Grouped sums of these probabilities per path and host are shrunk
towards their parents: a host's posterior mean towards the global mean, a path's
towards its host's, with Beta prior strengths estimated from all hosts and paths
by moments.  A site with few documents hardly moves the estimate.

*Decision.*  The document's log-odds move by the difference between its path's
posterior log-odds and the global ones.  Bad means a posterior of good quality
under 1/2 or of toxicity over 1/2.

Null text counts as empty, null host or path as ''; null labels are no labels;
repeated rows and labels count each; without labels of both kinds a label's
probability is its mean (or 1/2, or never toxic) and nothing is rejected for it;
columns named like the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from scorewright.llm.common import prepare, stage
from scorewright.llm.superkmers import word_hashes, word_places

#: Labelled rows that a fit uses at most, hashed words, rows a word must occur in, penalties of
#: the two fits.
SAMPLE, WORDS, RARE, PENALTY, REFIT = 10_000, 1 << 18, 8, 2e-3, 1e-4
_SHAPES, _BINS = 8, 16
FEATURES = WORDS + _SHAPES * _BINS
_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_UPPER, _DIGIT = (bytes(range(*r)) for r in ((0x41, 0x5B), (0x30, 0x3A)))
_SYMBOL = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-")
_RESULTS = ["p_quality", "p_toxic", "host_quality", "path_quality", "path_toxic", "quality", "toxic", "kept"]


def _step(share: float) -> int:
    """A share as one of 16 steps, finer near zero."""
    return min(_BINS - 1, int(np.sqrt(max(0.0, share)) * _BINS))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) pairs, each once."""
    raws = [t.encode() for t in texts]
    data = b"\n".join(r.translate(_LETTERS) for r in raws)
    starts, ends = word_places(np.frombuffer(data, np.uint8))
    edges = np.cumsum([0] + [len(r) + 1 for r in raws])
    owner = np.searchsorted(edges, starts, side="right") - 1
    h = word_hashes(data, starts, ends) % np.uint64(WORDS)
    pairs = np.unique(owner.astype(np.int64) * WORDS + h.astype(np.int64)) if len(h) else np.zeros(0, np.int64)
    rows, cols = pairs // WORDS, pairs % WORDS
    words = np.bincount(owner, minlength=len(raws))
    distinct = np.bincount(rows, minlength=len(raws))
    again = np.flatnonzero((h[1:] == h[:-1]) & (owner[1:] == owner[:-1])) + 1
    repeats = np.bincount(owner[again], minlength=len(raws))
    shape = np.zeros((len(raws), _SHAPES), np.int64)
    for i, raw in enumerate(raws):
        n, w = max(1, len(raw)), max(1, words[i])
        shape[i] = (_step((n - len(raw.translate(None, _SYMBOL))) / n), _step((n - len(raw.translate(None, _UPPER))) / n),
                    _step((n - len(raw.translate(None, _DIGIT))) / n), _step(distinct[i] / w),
                    _step(distinct[i] / w) if w < 300 else 0, _step(repeats[i] / w),
                    min(_BINS - 1, int(np.log2(n))), _step(min(1.0, w / n * 2)))
    place = WORDS + np.arange(_SHAPES) * _BINS
    return (np.concatenate((rows, np.repeat(np.arange(len(raws)), _SHAPES))),
            np.concatenate((cols, (shape + place).ravel())))


def fit(rows: np.ndarray, cols: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sparse logistic regression: an L1 penalty chooses the features, then they are fitted with hardly any."""
    chosen, _, _ = _solve(rows, cols, y, PENALTY, 0.0)
    keep = np.isin(cols, chosen)
    return _solve(rows[keep], cols[keep], y, 0.0, REFIT)


def _solve(rows, cols, y, lasso: float, ridge: float, steps: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Penalised logistic regression by accelerated proximal steps: (features, weights, intercept)."""
    used, index, counts = np.unique(cols, return_inverse=True, return_counts=True)
    often = counts >= RARE
    keep = often[index]
    rows, index = rows[keep], (np.cumsum(often) - 1)[index[keep]]
    used = used[often]
    n, m = len(y), len(used)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(index, minlength=m) / n * 16))  # frequent features weigh less
    value = scale[index]
    v, norm = np.ones(m), 0.0  # largest eigenvalue of the curvature, for the step size
    for _ in range(12):
        u = np.bincount(rows, value * v[index], n)
        v = np.bincount(index, value * u[rows], m)
        norm = np.linalg.norm(v)
        v /= max(norm, 1e-12)
    size = 1 / (0.25 * (norm / n + 1) + ridge)
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    w, bias = np.zeros(m), np.log(share / (1 - share))
    z, zb, t = w.copy(), bias, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, value * z[index], n) + zb, -30, 30)))
        miss = (p - y) / n
        new = z - size * (np.bincount(index, value * miss[rows], m) + ridge * z)
        new = np.sign(new) * np.maximum(np.abs(new) - size * lasso, 0)
        new_bias = zb - size * miss.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / t2 * (new - w), new_bias + (t - 1) / t2 * (new_bias - bias)
        w, bias, t = new, new_bias, t2
    some = np.flatnonzero(w)
    return used[some], (w * scale)[some], float(bias)


def train(docs: DataFrame, labels: DataFrame) -> dict[str, tuple[np.ndarray, float]]:
    """A weight vector and an intercept for ``quality`` and for ``toxic``."""
    spark = docs.sparkSession
    chosen = (labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality"),
                            F.col("toxic").cast("int").alias("toxic"))
              .filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "quality", "toxic").limit(SAMPLE))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")

    def extract(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, col = features(part["text"].to_pylist())
                order = np.argsort(row, kind="stable")
                cuts = np.searchsorted(row[order], np.arange(1, part.num_rows))
                own = [c.astype("<i4").tobytes() for c in np.split(col[order], cuts)]
                for name in ("quality", "toxic"):
                    yield pa.RecordBatch.from_pydict({
                        "label": pa.array([name] * part.num_rows), "y": part[name], "features": pa.array(own, pa.binary())})

    def solve(table):
        name = table["label"][0].as_py()
        own = sorted(zip(table["features"].to_pylist(), table["y"].to_pylist()))[:SAMPLE]  # an order of its own
        y = np.array([v for _, v in own], float)
        lists = [np.frombuffer(f, "<i4") for f, _ in own]
        if 0 < y.mean() < 1:
            at, w, bias = fit(np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists), y)
        else:
            at, w, bias = np.zeros(0, np.int64), np.zeros(0), 30.0 * (2 * y.mean() - 1)
        return pa.table({"label": [name], "at": [at.astype("<i8").tobytes()], "w": [w.astype("<f8").tobytes()],
                         "bias": [bias]})

    fitted = (rows.mapInArrow(extract, "label string, y int, features binary").filter("y is not null")
              .groupBy("label").applyInArrow(solve, "label string, at binary, w binary, bias double").collect())
    model = {"quality": (np.zeros(FEATURES), 0.0), "toxic": (np.zeros(FEATURES), -30.0)}
    for r in fitted:
        weights = np.zeros(FEATURES)
        weights[np.frombuffer(r["at"], "<i8")] = np.frombuffer(r["w"], "<f8")
        model[r["label"]] = weights, r["bias"]
    return {k: (spark.sparkContext.broadcast(w), b) for k, (w, b) in model.items()}


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with p_quality and p_toxic, the documents' own evidence."""
    prepare(docs.sparkSession)
    docs = docs.drop("p_quality", "p_toxic")
    schema = StructType([*docs.schema.fields, StructField("p_quality", DoubleType()), StructField("p_toxic", DoubleType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, col = features([t or "" for t in part[text_col].to_pylist()])
                new = []
                for name in ("quality", "toxic"):
                    weights, bias = model[name]
                    total = np.bincount(row, weights.value[col], part.num_rows) + bias
                    new.append(pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30)))))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=schema.names)

    return docs.mapInArrow(run, schema)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, n: str, s: str, mean: Column) -> float:
    """Beta prior strength by moments: how much group means vary beyond what their sizes explain."""
    rate = F.col(s) / F.col(n)
    between, sizes, most = groups.agg(F.sum(F.col(n) * (rate - mean) ** 2) / F.sum(n),
                                      F.sum(mean * (1 - mean)) / F.sum(n), F.max(mean * (1 - mean))).first()
    if most is None:
        return 1.0
    return min(1e6, max(1.0, most / max(between - sizes, 1e-6) - 1))


def site_posteriors(scored: DataFrame, host: str, path: str) -> DataFrame:
    """(host, path, host_x, path_x, mean_x) for x in quality and toxic, from all scored rows."""
    labels = ("quality", "toxic")
    paths, _ = stage(scored.groupBy(host, path).agg(F.count("*").alias("n"), *[
        F.sum(f"p_{x}").alias(f"s_{x}") for x in labels]), "site-paths")
    hosts = paths.groupBy(host).agg(F.sum("n").alias("hn"), *[F.sum(f"s_{x}").alias(f"h_{x}") for x in labels])
    means = hosts.agg(*[F.sum(f"h_{x}") / F.sum("hn") for x in labels]).first()
    for x, mean in zip(labels, means):
        mean = F.lit(mean if mean is not None else 0.5)
        m = _strength(hosts, "hn", f"h_{x}", mean)
        hosts = hosts.withColumns({f"host_{x}": (F.col(f"h_{x}") + m * mean) / (F.col("hn") + m), f"mean_{x}": mean})
    out = paths.join(hosts, host)
    for x in labels:
        k = _strength(out, "n", f"s_{x}", F.col(f"host_{x}"))
        out = out.withColumn(f"path_{x}", (F.col(f"s_{x}") + k * F.col(f"host_{x}")) / (F.col("n") + k))
    return out.select(host, path, *[f"{k}_{x}" for x in labels for k in ("host", "path", "mean")])


def quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, text_col: str = "text",
            keep_text: bool = True) -> DataFrame:
    """``docs`` with the documents' own probabilities, the sites' posteriors, the combined ones and ``kept``.

    The scored rows are staged, so the texts are read twice (fit and score) and never shuffled;
    the sites' table is staged too, so Spark knows its size when it plans the join.
    """
    docs = docs.drop(*[c for c in docs.columns if c in _RESULTS])
    model = train(docs, labels)
    named = docs.withColumns({"_host": F.coalesce(host, F.lit("")), "_path": F.coalesce(path, F.lit(""))})
    scored = score(named, model, text_col)
    scored, _ = stage(scored if keep_text else scored.drop(text_col), "quality-scores")
    sites, _ = stage(site_posteriors(scored, "_host", "_path"), "quality-sites")
    out = scored.join(sites, ["_host", "_path"])
    for x in ("quality", "toxic"):
        own = F.least(F.greatest(F.col(f"p_{x}"), F.lit(1e-9)), F.lit(1 - 1e-9))
        moved = _logit(own) + _logit(F.col(f"path_{x}")) - _logit(F.col(f"mean_{x}"))
        out = out.withColumn(x, 1 / (1 + F.exp(-F.coalesce(F.nanvl(moved, F.lit(None)), _logit(own)))))
    kept = (F.col("quality") >= 0.5) & (F.col("toxic") <= 0.5)
    return out.withColumn("kept", kept).drop("_host", "_path", "mean_quality", "mean_toxic", "host_toxic")
