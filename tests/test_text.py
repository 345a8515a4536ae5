"""Per-essay expressions on hand-written edge texts (FIXTURES section 3, texts_edge)."""

from pyspark.sql import functions as F

from scorewright.functions import text as T
from scorewright.operators import textfeat

EDGE = ["", " ", "a", "The the", "first line\n\nthird line", "Café déjà vu, naïve", 'He said "hi" and \'bye\'',
        "@CAPS1 @CAPS2 @PERCENT"]


def frame(spark):
    return spark.createDataFrame(list(enumerate(EDGE)), "id long, text string")


def col(spark, expr):
    return [r[0] for r in frame(spark).orderBy("id").select(expr).collect()]


def test_word_count_and_unique(spark):
    assert col(spark, T.word_count(F.col("text"))) == [len(t.split()) for t in EDGE]
    assert col(spark, T.unique_word_count(F.col("text"))) == [len(set(t.split())) for t in EDGE]


def test_normalized_words_split_accents(spark):
    words = col(spark, T.normalized_words(F.col("text")))
    assert words[0] == [] and words[3] == ["the", "the"]
    assert words[5] == ["caf", "d", "j", "vu", "na", "ve"]


def test_line_sentences_keep_empty_lines(spark):
    lines = col(spark, T.line_sentences(F.col("text")))
    assert lines[4] == ["first line", "", "third line"]
    assert lines[0] == [""]


def test_placeholders_prefix_match(spark):
    caps = col(spark, T.literal_count(F.col("text"), "@CAPS"))
    pct = col(spark, T.literal_count(F.col("text"), "@PERCENT"))
    assert caps[7] == 2 and pct[7] == 1 and caps[0] == 0


def test_punctuation_counts(spark):
    q = col(spark, T.literal_count(F.col("text"), '"') + T.literal_count(F.col("text"), "'"))
    assert q[6] == 4


def test_tokens_split_punctuation(spark):
    toks = col(spark, T.word_tokens(F.col("text")))
    assert toks[5] == ["Café", "déjà", "vu", ",", "naïve"]


def test_feature_row_for_empty_text(spark):
    ess = frame(spark).withColumns({"topic": F.lit("t"), "score": F.lit(1)})
    feats = {r.id: r for r in textfeat.essay_features(ess).collect()}
    assert feats[0].token_count == 0 and feats[0].sent_count == 1 and feats[0].similarity == 0.0
    assert feats[3].nostop_count == 1  # "The" is not in the lower-case stop list; "the" is


def test_polarity_negation(spark):
    df = spark.createDataFrame([(1, "good"), (2, "not good"), (3, "nothing here")], "id long, text string")
    pol = {r.id: r.p for r in df.select("id", T.sentiment_polarity(F.col("text")).alias("p")).collect()}
    assert abs(pol[1] - 0.7) < 1e-12 and abs(pol[2] + 0.35) < 1e-12 and pol[3] == 0.0


def test_readability_null_without_words(spark):
    r = col(spark, T.flesch_reading_ease(F.col("text")))
    assert r[0] is None and r[3] is not None


def test_all_stopword_text_cleans_to_empty(spark):
    df = spark.createDataFrame([(1, "The and of, to it! is a."), (2, "cats and dogs")], "id long, text string")
    out = {r.id: r.c for r in df.select("id", T.clean_corpus(F.col("text")).alias("c")).collect()}
    assert out == {1: "", 2: "cat dog"}


def test_grammar_match_offsets_agree_with_finditer(spark):
    import regex
    from scorewright.functions import fixed
    text = "teh cat ,and  so!! Yes.No ,.teh"
    df = spark.createDataFrame([(1, text)], "id long, text string")
    got = sorted((r.rule_id, r.offset, r.length) for r in textfeat.grammar_match_details(df).collect())
    exp = sorted((rid, m.start(), m.end() - m.start())
                 for rid, p, _ in fixed.GRAMMAR_RULES for m in regex.finditer(p, text))
    assert got == exp and len(got) >= 5


ODD = ["Teh cat , the dog..It's TEH teh. Été Là,b  !! ran quickly 12 3,4 @CAPS1 @PERSON2's", "", None, "  ", "teh\n", "Ⓐ ⓐ Ⓐ _ x_1",
       "ΑΣ'Α ΣΣ İstanbul istanbul", "\U00010400a.\U00010400b ,\U00010428 \U0001f600\U0001f600", "a b\x1cc\u0085d\x0be",
       "Big Bear\tRan. Big  Bear @Big Bear @BIG1a", "1a 12 ² Ⅷ 中", "the The THE the; can't n't 's"]


def test_counts_in_one_pass_are_those_of_the_annotations(spark):
    from scorewright.functions import counting
    df = spark.createDataFrame(list(enumerate(ODD)) + [(1, ODD[0]), (None, ODD[0])], "id long, text string")
    told = textfeat.count_features(textfeat.annotate(df)).withColumn(
        "squares", textfeat.sum_squared_counts(T.word_runs(F.col("text"))))
    counted = textfeat.essay_counts(df)
    assert sorted(map(str, counted.select("id", *counting.NAMES).collect())) == sorted(map(str, told.select("id", *counting.NAMES).collect()))


def test_essay_features_calls_no_lambda_per_token(spark):
    df = spark.createDataFrame([(1, "en", 3, "One two.")], "id long, topic string, score int, text string")
    plan = textfeat.essay_features(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and plan.count("count_batch(") == 1


def test_essay_features_join_no_words_of_the_essays(spark, monkeypatch):
    """The products with the reference essays come from the counting pass; rows are those of the join, whatever the ids."""
    texts = ODD + ["One two. Two three", "two TWO teh one", None, ""]
    rows = [(i, ["en", "de", None][i % 3], 1, t) for i, t in enumerate(texts)]
    rows += [(90, "en", 9, "one two, teh Two three\u0130"), (91, "de", 9, "Two one"), (1, "de", 2, "two one"), (1, "en", 2, texts[1]), (None, "en", 1, "one two"), (None, "en", 1, "one two")]
    df = spark.createDataFrame(rows, "id long, topic string, score int, text string")
    got = textfeat.essay_features(df)
    assert "explode(" not in got._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(textfeat, "MOST_TERMS", 0)
    want = textfeat.essay_features(df)
    assert "explode(" in want._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.filter("similarity > 0").count() > 5
