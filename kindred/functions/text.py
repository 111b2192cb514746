"""Text normalisation and tokens, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Replacements in titles, in order. Those before LOWERED act on
# the original case. Rules that can never match (a hyphen before "inch" or "hz"
# after hyphens are gone, capitals after lower-casing) are left out.
TITLE_RULES = (
    ("/", " "), ("\\", " "), ("-", " "), ("Inch", "inch"), ("inches", "inch"), ('"', "inch"), (" inch", "inch"),
    ("class", ""), ("”", "inch"), ("inchdiagonal", "inch"), ("'", "inch"), ("Hertz", "hz"), ("hertz", "hz"),
    ("Hz", "hz"), ("HZ", "hz"), (" hz", "hz"),
)
LOWERED_RULES = (("(", " "), (")", " "), (",", " "))
# What two titles are rid of before they are compared, as substrings.
COMPARE_RULES = (("and", " "), ("or", " "), ("&", " "), ("/", " "), ("-", " "))
# What a feature's name must hold for the feature to count as physical.
PHYSICAL = ("wifi", "dimension", "size", "width", "height", "depth", "ratio", "weight", "resolution", "rate")

#: A token with digits next to other characters; only its beginning is tied.
MODEL_WORD = r"^[a-zA-Z0-9]*(([0-9]+[^0-9, ]+)|([^0-9, ]+[0-9]+))[a-zA-Z0-9]*"
#: A number, perhaps with a unit.
NUMBER_WORD = r"^[0-9]+(\.[0-9]+)?[a-zA-Z]*$"


def replaced(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for old, new in rules:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def clean_title(title: Column) -> Column:
    """Units and separators made alike, lower case."""
    return replaced(F.lower(replaced(title, TITLE_RULES)), LOWERED_RULES)


def compare_title(title: Column) -> Column:
    return replaced(title, COMPARE_RULES)


def tokens(text: Column) -> Column:
    """Distinct tokens between blanks."""
    return F.array_distinct(F.filter(F.split(text, r"(?U)\s+"), lambda t: t != ""))


def model_words(text: Column) -> Column:
    """Tokens that mix digits with other characters."""
    return F.filter(tokens(text), lambda t: t.rlike(MODEL_WORD))


def numeric_words(text: Column) -> Column:
    """Numbers in a feature's value, without their units."""
    found = F.filter(tokens(text), lambda t: t.rlike(NUMBER_WORD))
    return F.array_distinct(F.transform(found, lambda t: F.regexp_replace(t, "[^0-9.]", "")))


def digit_runs(word: Column) -> Column:
    return F.regexp_extract_all(word, F.lit("([0-9]+)"), F.lit(1))


def other_runs(word: Column) -> Column:
    return F.regexp_extract_all(word, F.lit("([^0-9]+)"), F.lit(1))


def physical_features(features: Column) -> Column:
    """The entries of a feature map whose names speak of size, weight and the like."""
    return F.map_filter(features, lambda k, _: F.exists(F.array(*map(F.lit, PHYSICAL)), lambda p: F.contains(F.lower(k), p)))
