"""Ranking helpers against plain windows, filters, splits and sources (FIXTURES scores_edge, tsv_edge)."""

import os
import tempfile

from pyspark.sql import Window, functions as F

from scorewright.operators import relational as R, splits
from scorewright.sources import delimited


def test_row_number_by_matches_window(spark):
    rows = [("hot", i) for i in range(300)] + [("a", i) for i in range(7)] + [("b", 3), ("b", 1)]
    df = spark.createDataFrame(rows, "g string, k int").repartition(5)
    got = {(r.g, r.k): r.rn for r in R.row_number_by(df, ["g"], ["k"]).collect()}
    w = Window.partitionBy("g").orderBy("k")
    exp = {(r.g, r.k): r.rn for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert got == exp
    glob = {(r.g, r.k): r.rn for r in R.row_number_by(df, [], ["g", "k"]).collect()}
    exp2 = {(r.g, r.k): r.rn for r in df.withColumn("rn", F.row_number().over(Window.orderBy("g", "k"))).collect()}
    assert glob == exp2


def test_ntile_by_matches_window(spark):
    rows = [("x", i) for i in range(23)] + [("y", i) for i in range(4)]
    df = spark.createDataFrame(rows, "g string, k int")
    got = {(r.g, r.k): r.t for r in R.ntile_by(df, ["g"], ["k"], 5, "t").collect()}
    w = Window.partitionBy("g").orderBy("k")
    exp = {(r.g, r.k): r.t for r in df.withColumn("t", F.ntile(5).over(w)).collect()}
    assert got == exp


def test_score_range_drops_null_zero_and_high(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 1), (4, 10), (5, 11)], "id int, score int")
    assert sorted(r.id for r in R.filter_score_range(df).collect()) == [3, 4]


def test_drop_strict_raises(spark):
    df = spark.createDataFrame([(1,)], "a int")
    try:
        R.drop_strict(df, ["missing"])
    except KeyError:
        return
    raise AssertionError("expected KeyError")


def test_split_is_stable_and_proportional(spark):
    df = spark.range(0, 5000).toDF("id")
    a = splits.train_test(df, "id", 26)
    b = splits.train_test(df.repartition(7), "id", 26)
    assert {r.id for r in a.filter("split = 'train'").collect()} == {r.id for r in b.filter("split = 'train'").collect()}
    share = a.filter("split = 'train'").count() / 5000
    assert 0.67 < share < 0.73


def test_tsv_edge_cases(spark):
    d = tempfile.mkdtemp(prefix="sw-tsv-")
    path = os.path.join(d, "in.tsv")
    content = ('essay_id\tessay\tdomain1_score\n'
               '1\t"tab\there"\t3\n'
               '2\t"line one\nline two"\t\n'
               '3\t"say ""hi"" caf\xe9"\t4\n')
    with open(path, "wb") as fh:
        fh.write(content.encode("latin-1"))
    df = delimited.read_delimited(spark, path, "essay_id bigint, essay string, domain1_score int")
    rows = {r.essay_id: r for r in df.collect()}
    assert rows[1].essay == "tab\there"
    assert rows[2].essay == "line one\nline two" and rows[2].domain1_score is None
    assert rows[3].essay == 'say "hi" café'


def test_exact_quantiles_match_percentile(spark):
    from scorewright.operators import profile as P
    rows = [(float(i % 17), float(i * i % 101)) for i in range(503)] + [(None, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(4)
    got = P.exact_quantiles(df, ["a", "b"])
    exp = df.agg(F.percentile("a", [0.25, 0.5, 0.75]).alias("a"), F.percentile("b", [0.25, 0.5, 0.75]).alias("b")).first()
    for c in ["a", "b"]:
        assert all(abs(x - y) < 1e-12 for x, y in zip(got[c], exp[c]))


def test_sample_fraction_is_reproducible(spark):
    df = spark.range(0, 20000).toDF("id")
    a = {r.id for r in R.sample_fraction(df, 0.1, 7).collect()}
    b = {r.id for r in R.sample_fraction(df.repartition(5), 0.1, 7).collect()}
    assert a == b and 1700 < len(a) < 2300
