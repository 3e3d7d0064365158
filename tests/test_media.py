"""Recognised texts on inline rows."""

from pyspark.sql import functions as F

from tesserine.operators import media


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_clean_ocr(spark):
    df = spark.createDataFrame([("  Two   words ", 0.40), ("one", 0.59), ("one", 0.60), ("x.", 0.9), ("two words", 0.39), (None, 0.9), ("two words", None)], "t string, c double")
    assert rows(media.clean_ocr(df, "t", "c")) == [("Two words", 0.4), ("one", 0.6)]


def test_headlines(spark):
    df = spark.createDataFrame([("i", "BIG", 0, 50, 10, 30), ("i", "NEWS", 60, 120, 11, 30), ("i", "small print", 0, 90, 40, 45), ("i", "HUGE FOOTER", 0, 90, 90, 120), ("j", "tall", 0, 5, 0, 50)], "k string, t string, l int, r int, a int, b int")
    assert rows(media.headlines(df, "k", "t", "l", "r", "a", "b")) == [("i", "BIG NEWS")]


def test_disagreements(spark):
    df = spark.createDataFrame([("there were 5 boats", "there were 7 boats"), ("the council denied it", "the council said it"), ("again again again again", "x"), ("same 5", "same 5"), (None, "x")], "a string, b string")
    got = [r[0] for r in df.select(media.disagreements(F.col("a"), F.col("b"))).collect()]
    assert got[:4] == [["number_mismatch"], ["polarity_conflict"], ["repetition_loop"], []]


def test_fused(spark):
    speech = spark.createDataFrame([("v", 1, 0.0, 5.0, "the flood in town"), ("v", 2, 20.0, 25.0, "nothing alike")], "k string, speech_id int, s_from double, s_to double, s_text string")
    screen = spark.createDataFrame([("v", 8.0, 8.0, "Flood in town"), ("v", 28.0, 28.0, "ZZZ"), ("v", 28.1, 28.1, "late"), ("w", 0.0, 0.0, "other")], "k string, o_from double, o_to double, o_text string")
    got = rows(media.fused(speech, screen, "k", 3.0, 10.0))
    assert got == sorted([("v", "both", "the flood in town", 0.0, 5.0, "Flood in town"), ("v", "speech", "nothing alike", 20.0, 25.0, "ZZZ"), ("v", "screen", "late", 28.1, 28.1, ""), ("w", "screen", "other", 0.0, 0.0, "")], key=repr)
    assert media.fused(speech.limit(0), screen, "k", 3.0, 10.0).count() == 4


def test_decisions_and_labels(spark):
    df = spark.createDataFrame([("a", 0.9), ("a", 0.4), ("b", 0.5), ("c", None)], "k string, p double")
    assert rows(media.window_decisions(df, "k", "p")) == [("a", 2, 0.65, "positive"), ("b", 1, 0.5, "uncertain"), ("c", 0, None, None)]
    x = spark.createDataFrame([(1, "ENTAILMENT", 0.2), (1, "contradiction_label", 0.7), (1, None, 0.1), (2, "not_entailment", 0.6)], "k int, l string, s double")
    assert rows(media.folded_labels(x, "k", "l", "s")) == [(1, 0.2, 0.7, 0.1, "contradiction"), (2, 0.0, 0.0, 0.6, "neutral")]


def test_errors(spark):
    df = spark.createDataFrame([(i, i % 2, 0.9 if i < 6 else 0.1) for i in range(12)], "id int, y int, p double")
    got = media.errors(df, "id", "y", "p", n=2)
    assert sorted((r["kind"], r["id"], r["n_errors"]) for r in got.collect()) == [("false_negative", 7, 3), ("false_negative", 9, 3), ("false_positive", 0, 3), ("false_positive", 2, 3)]
