"""Wording functions: escapes, phrases within a window, synonyms, titles; null and empty texts."""

from pyspark.sql import functions as F

from papyrine.functions import wording


def _one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def test_latex(spark):
    assert _one(spark, wording.latex(F.col("t")), t="a_b {~} 5% \\ ^") == "a\\_b \\{\\textasciitilde{}\\} 5\\% \\textbackslash{} \\textasciicircum{}"
    assert _one(spark, wording.latex(F.col("t").cast("string")), t=None) is None


def test_phrases_within_a_window(spark):
    words = F.split("t", " ")
    near = lambda t, w: _one(spark, wording.co_occur(words, ["red wine"], ["low risk", "stroke"], w), t=t)
    assert near("red wine a b stroke", 2) and not near("red wine a b stroke", 1)
    assert near("low risk of red wine", 1) and not near("red b wine stroke", 5)
    assert near("", 5) is False
    assert _one(spark, wording.co_occur(F.split(F.col("t").cast("string"), " "), ["a"], ["b"], 3), t=None) is False


def test_synonyms(spark):
    found = wording.expand(F.split("t", " "), F.split("t", " "), {"fake": ["false", "error"]})
    assert _one(spark, found, t="a fake b fake") == ["a", "fake", "b", "fake", "false", "error", "false", "error"]
    assert _one(spark, wording.expand(F.split("t", " "), F.split("t", " "), {}), t="a") == ["a"]


def test_titles(spark):
    tones = {"plus": ["higher", "more"], "minus": ["lower"]}
    title = wording.pair_title(F.col("a").cast("string"), F.col("b").cast("string"), [["tea", "salt"], ["stroke"]], tones, {("plus", "minus"): "up or down?"}, "undecided", "nothing shared")
    assert _one(spark, title, a="Salt means higher stroke rates", b="salt, lower stroke") == "salt / stroke: up or down?"
    assert _one(spark, title, a="salt, lower stroke", b="Salt means higher stroke rates") == "salt / stroke: undecided"
    assert _one(spark, title, a="salt: lower and higher stroke", b="salt lower stroke") == "salt / stroke: up or down?"
    assert _one(spark, title, a="tea and stroke", b="salt and stroke") == "nothing shared"
    assert _one(spark, title, a=None, b="") == "nothing shared"
    assert _one(spark, wording.readable(F.col("a")), a="small-sample_size") == "small sample size"
