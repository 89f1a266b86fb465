"""Columns of text on hand-made rows."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.functions import text as T


def one(spark, value, *columns):
    return list(spark.createDataFrame([(value,)], "t string").select(*columns).first())


def test_the_two_normalisations_differ(spark):
    f = lambda t: one(spark, t, T.normalise_runs(F.col("t")), T.normalise_digits(F.col("t")))
    assert f("Pay $1,000  NOW_#") == ["pay ## now_#", "pay #### now"]
    assert f("Pay $10,000 now")[0] == f("Pay $1,00 now")[0]
    assert f("Pay $10,000 now")[1] != f("Pay $1,000 now")[1]
    assert f("a - b") == ["a  b", "a b"]
    assert f("") == ["", ""] and f(None) == [None, None]


def test_units_and_pieces(spark):
    t = "a\n\nb\n \t\nc"
    assert one(spark, t, F.split("t", T.PARAGRAPH))[0] == ["a", "b", "c"]
    assert one(spark, "x" * 60_000, F.transform(T.pieces(F.col("t")), lambda p: F.length(p)))[0] == [50_000, 10_000]
    assert one(spark, "", T.pieces(F.col("t")))[0] == [""]


def test_truncation_keeps_whole_characters(spark):
    f = lambda t, n: one(spark, t, T.truncate_bytes(F.col("t"), n))[0]
    assert f("aé€😀", 3) == "aé" and f("aé€😀", 2) == "a" and f("abc", 9) == "abc" and f("é", 1) == ""


def test_quotes_and_escapes(spark):
    assert one(spark, 'say \\"hi\\" now" rest', T.until_quote(F.col("t")))[0] == 'say \\"hi\\" now'
    assert one(spark, 'end\\\\" rest', T.until_quote(F.col("t")))[0] == "end\\\\"
    assert one(spark, "a\\nb\\u00e9", T.unescape(F.col("t")))[0] == "a\nbé"
    assert one(spark, "n\\tx\\", T.unescape(F.col("t")))[0] == "n\tx"


def test_controls_and_torn(spark):
    assert one(spark, "a\x00b\x1b\x7f\x85\tc\nd e", T.without_controls(F.col("t")))[0] == "ab\tc\nd e"
    assert one(spark, "x \\n y", T.torn(F.col("t")))[0] and one(spark, "x � y", T.torn(F.col("t")))[0] and not one(spark, "x \n y", T.torn(F.col("t")))[0]


def test_snaps(spark):
    assert one(spark, "tail of words", T.snap_head(F.col("t")), T.snap_tail(F.col("t"))) == ["of words", "tail of"]
    long = "x" * 50 + " y " + "z" * 50
    assert one(spark, long, T.snap_head(F.col("t")), T.snap_tail(F.col("t"))) == [long, long]


def test_prefixes_and_prompts(spark):
    assert one(spark, "[QUERY] a [PASSAGE] b", T.without_prefixes(F.col("t")))[0] == "a b"
    assert one(spark, "[PASSAGE] ", T.without_prefixes(F.col("t")))[0] is None
    assert one(spark, " a\n b ", T.query_text(F.col("t")), T.passage_text(F.col("t"))) == ["[QUERY] a b", "[PASSAGE] a b"]
    assert one(spark, "Highlight the parts (if any)\nDetails: Who signs?", T.question_of(F.col("t")))[0] == "Who signs?"
    assert one(spark, "Context: a\nb\nQuestion: c", T.context_of(F.col("t")))[0] == "a\nb"
    assert one(spark, '"Query: what is due?\nmore"', T.first_answer_line(F.col("t")))[0] == "what is due?"


def test_tokens_and_bar(spark):
    assert one(spark, "Don't  stop—2 Ünïts", T.lexical_tokens(F.col("t")), T.space_tokens(F.col("t"))) == [["don", "t", "stop", "2", "ünïts"], ["don't", "stop—2", "ünïts"]]
    assert one(spark, "x", T.progress_bar(F.lit(0.5), 4))[0] == "██░░"
    assert one(spark, "org/model-x", T.model_name(F.col("t")))[0] == "model-x"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(max_size=60))
def test_pieces_lose_nothing(spark, t):
    assert one(spark, t, F.array_join(T.pieces(F.col("t"), 7), ""))[0] == t
