"""Least squares and elastic nets from one pass: cross-product matrices per group.

A linear model's optimum depends on the rows only through the sums of 1, x, y and
their products.  Each task adds up the matrix of its rows per group, the matrices
are summed over the tasks (in two steps, so no task reads more than ``FAN`` of them
at a time), and each group's small problem is solved exactly by its own task.  The
matrix has (features + 2) squared entries, a bound that parameters set (at most
2000 vocabulary terms and 30 predictors here), whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial matrices that one task of the first summing step reads.
FAN = 64
#: Rows of a matrix that are stored together.
BLOCK = 16
#: Least exactness of the optimality conditions in a search, relative to the largest correlation (the reference's 1e-4).
SEARCH_TOLERANCE = 1e-4
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def cross_products(df: DataFrame, features: str, label: str, groups: list[str]) -> DataFrame:
    """(groups..., i, m): blocks of rows, from row i on, of the sum of z z' over each group's rows, z = (1, x, y).

    ``features`` is an array column.  A block holds ``BLOCK`` matrix rows, so no row of the table is large."""
    key = F.to_json(F.struct(*groups)).alias("_g")

    def add(batches):
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for g, part in pdf.groupby("_g"):
                x = np.stack(part["_x"].to_numpy())
                z = np.column_stack((np.ones(len(x)), x, part["_y"].to_numpy(float)))
                sums[g] = sums.get(g, 0) + z.T @ z
        task = TaskContext.get().partitionId() // FAN
        for g, m in sums.items():
            for i in range(0, len(m), BLOCK):
                yield pd.DataFrame({"_g": [g], "_task": [task], "i": [i], "m": [m[i:i + BLOCK].tobytes()]})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[:1].copy()
        out["m"] = [sum(np.frombuffer(b) for b in pdf["m"]).tobytes()]
        return out

    schema = "_g string, _task long, i int, m binary"
    conf = df.sparkSession.conf  # wide rows: keep the batches that go to Python small
    conf.set(BATCH, str(min(int(conf.get(BATCH)), 256)))
    rows = df.select(key, F.col(features).alias("_x"), F.col(label).cast("double").alias("_y"))
    partial = rows.mapInPandas(add, schema).groupBy("_g", "_task", "i").applyInPandas(total, schema)
    sums = partial.groupBy("_g", "i").applyInPandas(total, schema)
    fields = ", ".join(f"{g} {df.schema[g].dataType.simpleString()}" for g in groups)
    return sums.select(F.from_json("_g", fields).alias("k"), "i", "m").select("k.*", "i", "m")


def square(pdf: pd.DataFrame) -> np.ndarray:
    """The whole matrix of one group's blocks."""
    flat = np.concatenate([np.frombuffer(b) for b in pdf.sort_values("i")["m"]])
    return flat.reshape(int(round(len(flat) ** 0.5)), -1)


def _system(m: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solution of a symmetric system, the smallest one if it is singular (least squares without a ridge)."""
    try:
        out = np.linalg.solve(m, rhs)
        if np.abs(m @ out - rhs).max(initial=0) < 1e-8 * max(1.0, np.abs(rhs).max(initial=0)):
            return out
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(m, rhs, rcond=None)[0]


def solve(z: np.ndarray, alpha: float, l1_ratio: float, tol: float = 1e-9, start: np.ndarray | None = None,
          rounds: int = 400) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) that minimise 1/(2n)|y - Xw - b|^2 + alpha r |w|_1 + alpha (1 - r)/2 |w|^2.

    ``z`` is the cross-product matrix of (1, x, y).  On the centred and scaled problem, accelerated
    proximal steps find which coefficients are not zero, and Newton steps solve the linear system of
    those and correct the choice.  The outcome is accepted only if it satisfies the optimality
    conditions; raises if that is never the case.
    """
    n = z[0, 0]
    mean = z[0, 1:] / n
    c = z[1:, 1:] / n - np.outer(mean, mean)
    g, b = c[:-1, :-1], c[:-1, -1]
    spread = np.sqrt(np.maximum(np.diag(g), 0))
    live = np.flatnonzero(spread > 1e-9 * max(1.0, spread.max(initial=0)))
    w = np.zeros(len(b)) if start is None else start.copy()
    w[spread <= 1e-9 * max(1.0, spread.max(initial=0))] = 0
    if len(live):
        g, b = g[np.ix_(live, live)], b[live]
        # from a strong penalty to the wanted one: each optimum is close to the next
        for strength in [*(alpha * 2.0 ** k for k in range(4, 0, -1) if alpha > 0), alpha]:
            # every coordinate scaled to unit curvature, its ridge included
            s = 1 / np.sqrt(np.diag(g) + strength * (1 - l1_ratio))
            a, rhs, v = g * np.outer(s, s), b * s, w[live] / s
            ridge, lasso = strength * (1 - l1_ratio) * s * s, strength * l1_ratio * s
            limit, size = tol * max(1.0, np.abs(rhs).max()), None
            for _ in range(rounds if strength == alpha else 1):
                found = _newton(a, rhs, ridge, lasso, v, limit)
                if found is not None:
                    v = found
                    break
                size = size or 1 / (1.2 * _largest(a) + ridge.max())
                v = _proximal(a, rhs, ridge, lasso, v, size, 100)
                v = _signs(a, rhs, ridge, lasso, v, limit)
                if _optimal(rhs - a @ v - ridge * v, lasso, v, limit):
                    found = v
                    break
            w[live] = v * s
        if found is None:
            raise ArithmeticError(f"elastic net not converged after {rounds} rounds")
    return w, float(mean[-1] - mean[:-1] @ w)


def _optimal(slope, lasso, v, limit: float) -> bool:
    """The optimality conditions: a zero's slope within the L1 penalty, another's equal to it, up to ``limit``."""
    on = v != 0
    return bool((np.abs(slope) <= lasso + limit).all() and (np.abs(slope - lasso * np.sign(v))[on] <= limit).all())


def _largest(a: np.ndarray) -> float:
    """Largest eigenvalue by power iterations (an estimate from below, used with room)."""
    v, top = np.random.default_rng(0).normal(size=len(a)), 1.0
    for _ in range(60):
        v = a @ v
        top = np.linalg.norm(v)
        v /= top
    return top


def _proximal(a, rhs, ridge, lasso, v, size: float, steps: int) -> np.ndarray:
    """Accelerated proximal steps with restarts."""
    u, t = v.copy(), 1.0
    for _ in range(steps):
        new = u - size * (a @ u + ridge * u - rhs)
        new = np.sign(new) * np.maximum(np.abs(new) - size * lasso, 0)
        if (u - new) @ (new - v) > 0:
            t = 1.0
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u = new + (t - 1) / t2 * (new - v)
        v, t = new, t2
    return v


def _signs(a, rhs, ridge, lasso, v, limit: float, steps: int = 200, most: int = 400) -> np.ndarray:
    """Feature-sign search from ``v``: solve for the non-zero ones with their signs fixed, go there or to the best
    sign change on the way, let in the zero that most wants to leave; each step lowers the objective."""
    if np.count_nonzero(v) > most:
        return v

    def height(x):
        return x @ (a @ x) / 2 + (ridge * x) @ x / 2 - rhs @ x + lasso @ np.abs(x)

    v, signs = v.copy(), np.sign(v)
    for _ in range(steps):
        slope = rhs - a @ v - ridge * v
        on = np.flatnonzero(signs)
        if not len(on) or np.abs(slope[on] - lasso[on] * signs[on]).max() <= limit:
            excess = np.where(signs == 0, np.abs(slope) - lasso, -np.inf)
            j = int(excess.argmax())
            if excess[j] <= limit or len(on) >= most:
                break
            signs[j] = np.sign(slope[j])
            on = np.flatnonzero(signs)
        goal = np.zeros(len(v))
        goal[on] = _system(a[np.ix_(on, on)] + np.diag(ridge[on]), rhs[on] - lasso[on] * signs[on])
        turns = np.flatnonzero((v != 0) & (np.sign(goal) != np.sign(v)))
        options = [goal]
        for i in turns:
            stop = v + (goal - v) * (v[i] / (v[i] - goal[i]))
            stop[i] = 0.0
            options.append(stop)
        best = min(options, key=height)
        if height(best) >= height(v) - 1e-15:
            break
        v, signs = best, np.sign(best)
    return v


def _newton(a, rhs, ridge, lasso, v, limit: float, steps: int = 12) -> np.ndarray | None:
    """Semi-smooth Newton steps from ``v``: the optimum, or None if the choice of non-zero ones keeps changing."""
    curve = 1 / (np.diag(a) + ridge)  # coordinates' own step sizes
    for _ in range(steps):
        trial = v + curve * (rhs - a @ v - ridge * v)
        on = np.flatnonzero(np.abs(trial) > curve * lasso)
        signs = np.sign(trial[on])
        exact = np.zeros(len(v))
        exact[on] = _system(a[np.ix_(on, on)] + np.diag(ridge[on]), rhs[on] - lasso[on] * signs)
        slope = rhs - a @ exact - ridge * exact
        if (exact[on] * signs >= 0).all() and (np.abs(slope) <= lasso + limit).all():
            return exact
        v = exact
    return None


def r_squared(z: np.ndarray, w: np.ndarray, b: float) -> float:
    """R^2 of a linear model on the rows behind a cross-product matrix; 0 where the label does not vary."""
    v = np.concatenate(([b], w, [-1.0]))
    total = z[-1, -1] - z[0, -1] ** 2 / z[0, 0]
    return float(1 - (v @ z @ v) / total) if total > 1e-9 else 0.0


def elastic_nets(train: DataFrame, features: list[str], label: str, groups: list[str], alpha: float,
                 l1_ratio: float) -> DataFrame:
    """(groups..., coefficients, intercept, n_train) per group; alpha 0 gives least squares."""
    x = F.array(*[F.col(f).cast("double") for f in features]).alias("_features")
    sums = cross_products(train.select(*groups, x, label), "_features", label, groups)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        z = square(pdf)
        w, b = solve(z, alpha, l1_ratio)
        out = pdf[groups].iloc[:1].copy()
        return out.assign(coefficients=[w.tolist()], intercept=b, n_train=int(z[0, 0]))

    fields = ", ".join(f"{g} {train.schema[g].dataType.simpleString()}" for g in groups)
    return sums.groupBy(*groups).applyInPandas(fit, f"{fields}, coefficients array<double>, intercept double, n_train long")


def predict(df: DataFrame, fits: DataFrame, features: list[str], groups: list[str]) -> DataFrame:
    """``df`` with ``prediction``; the fits (one row per group) are staged, so their size is known to the join."""
    from scorewright.sources.staging import stage
    x = F.array(*[F.col(f).cast("double") for f in features])
    dot = F.aggregate(F.zip_with(x, F.col("coefficients"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    out = df.join(stage(fits, "linear-fits"), groups).withColumn("prediction", dot + F.col("intercept"))
    return out.drop("coefficients", "intercept", "n_train")


def grid_search(train: DataFrame, features: str, label: str, group: str, fold: str, alphas: list[float],
                l1_ratios: list[float]) -> DataFrame:
    """(group, alpha, l1_ratio, cv_r2, best, coefficients, intercept): elastic nets over a grid, the best refitted.

    Every fold's matrix comes from the one pass; a training set is the sum of the others, and the
    held-out R^2 is read off the held-out matrix, so neither fits nor scores read rows again.  Ties go
    to the first pair of the grid.
    """
    sums = cross_products(train, features, label, [group, fold])
    grid = [(r, a) for r in l1_ratios for a in alphas]

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [square(part) for _, part in pdf.groupby(fold)]
        whole, scores = sum(parts), {pair: [] for pair in grid}
        for z in parts:
            for r in l1_ratios:
                w = None
                for a in sorted(alphas, reverse=True):  # each fit starts at the last
                    w, b = solve(whole - z, a, r, SEARCH_TOLERANCE, w)
                    scores[r, a].append(r_squared(z, w, b))
        means = [float(np.mean(scores[pair])) for pair in grid]
        top = int(np.argmax(means))
        w, b = solve(whole, grid[top][1], grid[top][0], SEARCH_TOLERANCE)
        return pd.DataFrame({
            group: pdf[group].iloc[0], "alpha": [a for _, a in grid], "l1_ratio": [r for r, _ in grid], "cv_r2": means,
            "best": [i == top for i in range(len(grid))],
            "coefficients": [w.tolist() if i == top else None for i in range(len(grid))],
            "intercept": [b if i == top else None for i in range(len(grid))]})

    kind = train.schema[group].dataType.simpleString()
    return sums.groupBy(group).applyInPandas(
        search, f"{group} {kind}, alpha double, l1_ratio double, cv_r2 double, best boolean, "
                "coefficients array<double>, intercept double")
