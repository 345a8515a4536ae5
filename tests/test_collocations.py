"""Collocations: planted pairs, counts taken off the single words, odd texts."""

import math

from pyspark.sql import functions as F

from scorewright.operators import vocab as V


def dunning(k, n1, n2, n):
    def ll(a, b, p):
        return a * math.log(max(p, 1e-10)) + (b - a) * math.log(max(1 - p, 1e-10))
    r, m, p = n2 - k, max(n - n1, 1), n2 / n
    return -2 * (ll(k, n1, p) + ll(r, m, p) - ll(k, n1, k / n1) - ll(r, m, r / m))


def test_planted_pairs_and_leftover_counts(spark):
    texts = ["green harbour " + " ".join(f"word{chr(97 + (i * 7 + j) % 23)}" for j in range(6)) for i in range(60)]
    texts += ["green lamp"] * 3 + ["echo echo echo echo echo"] * 20 + ["", " ", "one"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    words = df.select(F.filter(F.split("text", " "), lambda w: w != "").alias("w"))
    single, pairs = V.collocations(words)
    n = {r["word"]: r["n"] for r in single.collect()}
    got = {(r["a"], r["b"]): r for r in pairs.collect()}
    assert got["green", "harbour"]["n"] == 60 and got["echo", "echo"]["n"] == 80 and ("green", "lamp") not in got
    total = sum(n.values())
    for (a, b), r in got.items():
        assert abs(r["score"] - dunning(r["n"], n[a], n[b], total)) < 1e-6 and r["score"] > V.COLLOCATION
    cloud = {r["term"]: r["n"] for r in V.word_cloud_frequencies(df).collect()}
    assert cloud["green harbour"] == 60 and cloud["green"] == 3 and "harbour" not in cloud and "echo" not in cloud


def test_no_words(spark):
    df = spark.createDataFrame([(1, ""), (2, None)], "id long, text string")
    assert V.word_cloud_frequencies(df).count() == 0


def test_adjacent_words_without_a_lambda(spark):
    rows = [(0, None), (1, []), (2, ["x"]), (3, ["x", "y"]), (4, ["x", "y", "x", "x"])]
    frame = spark.createDataFrame(rows, "id long, w array<string>").select("id", V.adjacent("w").alias("p"))
    got = {r["id"]: [tuple(p) for p in r["p"] or []] for r in frame.collect()}
    assert got == {0: [], 1: [], 2: [], 3: [("x", "y")], 4: [("x", "y"), ("y", "x"), ("x", "x")]}
    assert "lambda" not in frame._jdf.queryExecution().toString()
