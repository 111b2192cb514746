import pytest
from pyspark.sql import functions as F

from kindred.functions import text as T

TITLES = {
    "LG 55-Inch": "lg 55inch",
    'Sony 40" Class 120 Hz': "sony 40inch class 120hz",
    "Sharp 60 inches class (LC-60) 240Hertz": "sharp 60inch   lc 60  240hz",
    "A\\B/C, 5 ' x": "a b c  5 inch x",
    "": "",
}


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("title", TITLES)
def test_clean_title(spark, title):
    assert one(spark, title, T.clean_title) == TITLES[title]


def test_dead_title_rules_change_nothing(spark):
    """Rules for '-inch', '-hz' and two shops' names could only act on what earlier rules have removed."""
    for title in ("a-inch b-hz Newegg.com TheNerds.net", "X -Inch -Hz"):
        cleaned = one(spark, title, T.clean_title)
        assert "-" not in cleaned and cleaned == cleaned.lower()


def test_model_and_numeric_words(spark):
    assert sorted(one(spark, "un55d7000 lg 120hz 1080 abc", T.model_words)) == ["120hz", "un55d7000"]
    assert one(spark, "120hz 54.6lbs abc 1080p/60 7", T.numeric_words) == ["120", "54.6", "7"]


def test_runs(spark):
    assert one(spark, "un55d7000", T.digit_runs) == ["55", "7000"]
    assert one(spark, "un55d7000", T.other_runs) == ["un", "d"]
    assert one(spark, "abc", T.digit_runs) == []


def test_compare_title_replaces_inside_words(spark):
    assert one(spark, "brand monitor a&b", T.compare_title) == "br  monit  a b"
