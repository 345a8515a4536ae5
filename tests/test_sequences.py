"""Sequences: padding and truncation lengths, index cut at num_words (FIXTURES sequences_edge)."""

from pyspark.sql import functions as F

from scorewright.operators import vocab as V


def test_pad_lengths(spark):
    rows = [(n, list(range(1, n + 1))) for n in (0, 499, 500, 501)]
    df = spark.createDataFrame(rows, "id long, seq array<bigint>")
    out = {r.id: r.padded for r in V.pad_sequences(df).collect()}
    assert all(len(v) == 500 for v in out.values())
    assert out[0] == [0] * 500
    assert out[499][0] == 0 and out[499][1:] == list(range(1, 500))
    assert out[500] == list(range(1, 501))
    assert out[501] == list(range(2, 502))  # left truncation keeps the last 500


def test_index_cut_at_num_words(spark):
    words = spark.createDataFrame([(1, ["a", "b", "c", "a"])], "id long, words array<string>")
    index = spark.createDataFrame([("a", 4999), ("b", 5000), ("c", 1)], "term string, idx long")
    seq = V.encode_sequences(words, index, 5000).first().seq
    assert seq == [4999, 1, 4999]


def test_token_index_ties_first_seen(spark):
    words = spark.createDataFrame([(1, ["x", "y"]), (2, ["y", "x", "z"])], "id long, words array<string>")
    idx = {r.term: r.idx for r in V.token_index(words).collect()}
    assert idx == {"x": 1, "y": 2, "z": 3}


def test_encode_with_mask(spark):
    words = spark.createDataFrame([(1, ["a", "zz"]), (2, [])], "id long, words array<string>")
    index = spark.createDataFrame([("a", 1)], "term string, idx long")
    out = {r.id: r for r in V.encode_with_mask(words, index).collect()}
    assert out[1].input_ids == [1, 4, 3, 2] and out[1].attention_mask == [1, 1, 1, 1]
    assert out[2].input_ids == [1, 2, 0, 0] and out[2].attention_mask == [1, 1, 0, 0]


def test_average_word_vectors_known_only(spark):
    words = spark.createDataFrame([(1, ["a", "b", "unknown"]), (2, ["nope"])], "id long, words array<string>")
    vecs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0])], "word string, vector array<double>")
    out = {r.id: r.vector for r in V.average_word_vectors(words, vecs, 2).collect()}
    assert out[1] == [0.5, 1.5] and out[2] == [0.0, 0.0]


def test_average_word_vectors_repeats_and_gaps(spark):
    """Repeated keys share their words, a null key has none, a word with two vectors counts twice, whatever the blocks."""
    rows = [(1, ["a", "b"]), (1, ["a"]), (None, ["a"]), (2, None), (3, []), (4, ["b", "b", "x"])]
    words = spark.createDataFrame(rows + [(i, ["b"]) for i in range(10, 2500)], "id long, words array<string>")
    vecs = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [4.0, 0.0]), ("b", [0.0, 3.0]), ("x", None)], "word string, vector array<float>")
    out = sorted(((r.id or 0, r.vector) for r in V.average_word_vectors(words, vecs, 2).collect()))
    assert out[:6] == [(0, [0.0, 0.0]), (1, [2.0, 0.6]), (1, [2.0, 0.6]), (2, [0.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 3.0])]
    assert len(out) == len(rows) + 2490 and all(v == [0.0, 3.0] for _, v in out[6:])


def test_average_word_vectors_never_joins_vectors_to_occurrences(spark):
    """The vector table meets each block's distinct words; a join with every occurrence shuffled a vector per word."""
    words = spark.createDataFrame([(1, ["a", "b"])], "id long, words array<string>")
    vecs = spark.createDataFrame([("a", [1.0])], "word string, vector array<double>")
    plan = V.average_word_vectors(words, vecs, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "Aggregate [part" in plan


def test_encoder_holds_few_essays_at_a_time(spark):
    """A worker's memory follows the batch: no more than ENCODED_ROWS essays, fewer if the session asks for that."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    words = spark.createDataFrame([(i, ["a", "b"]) for i in range(50)], "id long, words array<string>")
    index = spark.createDataFrame([("a", 1)], "term string, idx long")
    before = spark.conf.get(key)
    try:
        for asked, used in (("10000", V.ENCODED_ROWS), ("0", V.ENCODED_ROWS), ("7", 7)):
            spark.conf.set(key, asked)
            rows = V.encode_sequences(words, index).collect()
            assert int(spark.conf.get(key)) == used and all(r.seq == [1] for r in rows) and len(rows) == 50
    finally:
        spark.conf.set(key, before)


def test_tfidf_tasks_count_bounded_numbers_of_essays(spark, tmp_path, monkeypatch):
    """Partitions by essay grow with the essays; Spark merged them by their compressed bytes. Values do not depend on it."""
    from scorewright.plans import vocab_q
    rows = [(i, f"shared{i % 12} word{i % 7} word{i % 5} word{i % 5}", "en", "web", 30) for i in range(100)] + [(3, "word1 shared1", "en", "web", 13)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    found = {}
    for size, parts in ((50, 3), (5, 21)):
        monkeypatch.setattr(vocab_q, "COUNTED_ROWS", size)
        monkeypatch.setattr(vocab_q, "LEAST_PARTS", 1)
        got = vocab_q.q_tfidf(spark, str(tmp_path))
        assert "hashpartitioning(id#" in (plan := got._jdf.queryExecution().executedPlan().toString()) and f", {parts})" in plan
        found[size] = sorted(map(tuple, got.collect()))
    assert found[50] == found[5] and len(found[5]) > 100
