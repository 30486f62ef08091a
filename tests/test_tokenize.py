from pyspark.sql import functions as F

from tokenweave.functions import tokenize as T


def sentences(spark, text, split=T.sentence_array):
    return spark.createDataFrame([(text,)], "text string").select(split(F.col("text")).alias("s")).first().s


def words(spark, text, normalize=False):
    return spark.createDataFrame([(text,)], "s string").select(T.word_array(F.col("s"), normalize).alias("w")).first().w


def test_three_terminators(spark):
    assert sentences(spark, "Is it so? It is! Good then.") == ["Is it so?", "It is!", "Good then."]


def test_decimal_number_is_not_a_boundary(spark):
    assert sentences(spark, "Pi is 3.14 or so. Yes.") == ["Pi is 3.14 or so.", "Yes."]


def test_quotes_and_brackets_may_open_a_sentence(spark):
    assert sentences(spark, 'Done. "Then what?" (Nothing.) [7 more]') == ["Done.", '"Then what?" (Nothing.) [7 more]']  # no cut after a closing sign
    assert sentences(spark, "One. (Two) 3! 'Four'") == ["One.", "(Two) 3!", "'Four'"]


def test_blank_and_null_texts_have_no_sentences(spark):
    assert sentences(spark, " \n\t ") == []
    assert sentences(spark, "") == []
    assert sentences(spark, None) is None
    assert T.runs(spark.createDataFrame([(1, None), (2, "  ")], "doc_id bigint, text string")).count() == 0


def test_unicode_white_space(spark):
    assert sentences(spark, "A b. C d.\u0085E") == ["A b.", "C d.", "E"]
    assert words(spark, " a b\u0085c　") == ["a", "b", "c"]


def test_words_of_mixed_runs_and_blanks(spark):
    assert words(spark, " a \t\n b  c ") == ["a", "b", "c"]
    assert words(spark, "   ") == []
    assert words(spark, "") == []


def test_normalized_words(spark):
    assert words(spark, "Hello, WORLD! -- It's été 42", True) == ["hello", "world", "its", "t", "42"]


def test_lines(spark):
    assert sentences(spark, "one\r\n\n  two \nthree", T.line_array) == ["one", "two", "three"]
    assert len(sentences(spark, "\n".join(f"line {i}" for i in range(20)), T.line_array)) == 20


def test_runs_keep_positions_and_drop_empty_sentences(spark):
    df = spark.createDataFrame([(5, "A b. C! D e? 7 --")], "doc_id bigint, text string")
    got = [(r.pos, r.words) for r in T.runs(df, T.PROSE_NORMALIZED).orderBy("pos").collect()]
    assert got == [(0, ["a", "b"]), (1, ["c"]), (2, ["d", "e"]), (3, ["7"])]


def test_white_space_is_the_unicode_class(spark):
    """Every character that the class of white space has, and its neighbours, alone and in runs, at ends and inside."""
    chars = spark.range(0x10000).where("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    got = chars.select("c", F.rlike("c", F.lit(f"^{T.WS}$")).alias("is"), T.trim(F.concat("c", F.lit("a"), "c", F.lit("b"), "c")).alias("t"), T.word_array(F.concat("c", F.lit("a"), "c", "c", F.lit("b c"), "c")).alias("w"))
    rows = got.where("is or c = '\\u180e' or c = '\\u200b'").collect()
    assert {r.c for r in rows if r["is"]} == set(T.SPACES)
    for r in rows:
        assert (r.t, r.w) == ((f"a{r.c}b", ["a", "b", "c"]) if r["is"] else (f"{r.c}a{r.c}b{r.c}", [f"{r.c}a{r.c}{r.c}b", f"c{r.c}"]))


def test_words_are_made_once(spark):
    """The filter on empty runs does not make the words a second time: one split at spaces in the plan."""
    docs = spark.createDataFrame([(1, "One two. Three  four.  ?")], "doc_id bigint, text string")
    runs = T.runs(docs)
    assert runs._jdf.queryExecution().optimizedPlan().toString().count(",  , -1)") == 1
    assert [(r.pos, r.words) for r in runs.collect()] == [(0, ["One", "two."]), (1, ["Three", "four.", "?"])]
