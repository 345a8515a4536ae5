"""The pipeline's stages against brute force on rows without an id and rows repeated under one id."""

import random

import pytest

import corpus_pipeline
from scorewright.llm.common import documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    """(folder, rows, what each of the stages exact, near and benchmark must leave)"""
    rng = random.Random(8)
    text = lambda k: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(k))
    a, b, c, d, item = text(60), text(60), text(60), text(60), text(20)
    near = lambda t: t + " changed"
    rows = [(1, a), (2, b), (None, a), (None, near(b)), (None, c), (None, c), (None, near(c)), (None, text(50)), (None, None),
            (None, ""), (3, item + " " + text(5)), (None, item + " " + text(6)), (3, text(40)), (4, a.replace(" ", "\n")),
            (4, text(30)), (5, d), (5, near(d)), (5, text(20)), (6, text(25)), (6, near(near(d))), (7, "one  two"), (7, "one two")]
    folder = str(tmp_path_factory.mktemp("rows"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(folder + "/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(folder + "/benchmark.parquet")
    spark.createDataFrame([(99, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    norm = lambda t: " ".join((t or "").split())
    exact = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        exact.setdefault(norm(t), (i, norm(t)))
    return folder, exact, (a, b, c, d, item), norm


def test_stages_decide_row_by_row(spark, case):
    folder, exact, (_, b, c, d, item), norm = case
    docs = documents(spark, folder)
    read = lambda df: sorted(((r["doc_id"], norm(r["text"])) for r in df.collect()), key=repr)
    one = corpus_pipeline.exact_copies(spark, docs, folder)
    assert read(one) == sorted(exact.values(), key=repr)
    two = corpus_pipeline.near_copies(spark, one, folder)
    left = [r for r in exact.values() if r[1] not in (b + " changed", d + " changed changed")]
    families = [{(None, c), (None, c + " changed")}, {(5, d), (5, d + " changed")}]
    got = read(two)
    assert all(len(f & set(got)) == 1 for f in families)
    assert sorted((r for r in got if not any(r in f for f in families)), key=repr) == sorted(
        (r for r in left if not any(r in f for f in families)), key=repr)
    three = read(corpus_pipeline.clean_of_benchmark(spark, two, folder))
    assert three == [r for r in got if not r[1].startswith(item)]


def test_clashing_columns_stay(spark, case):
    folder, exact, _, norm = case
    docs = documents(spark, folder).selectExpr("*", "n_chars AS _key", "1 AS _some", "2 AS `_KEY_`", "3 AS key")
    got = corpus_pipeline.exact_copies(spark, docs, folder)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], norm(r["text"])) for r in got.collect()), key=repr) == sorted(exact.values(), key=repr)
    assert all(r["_key"] == r["n_chars"] and (r["_some"], r["_KEY_"], r["key"]) == (1, 2, 3) for r in got.collect())
    near = corpus_pipeline.near_copies(spark, docs, folder)
    assert near.columns == docs.columns


def test_run_packs_what_stays(spark, case):
    folder, exact, _, _ = case
    packed = corpus_pipeline.run(spark, folder)
    assert packed.select("doc_id").distinct().count() >= 6
