"""Vocabulary of model words and numbers, and which products hold which word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import text as T
from kindred.operators.tables import lesser, room


def title_words(products: DataFrame) -> DataFrame:
    """(product_id, word): model words of the titles."""
    return products.select("product_id", F.explode(T.model_words(F.col("title"))).alias("word"))


def physical_values(products: DataFrame) -> DataFrame:
    """(product_id, k, v): features that speak of size, weight and the like."""
    return products.select("product_id", F.explode(T.physical_features(F.col("features"))).alias("k", "v"))


def value_words(products: DataFrame) -> DataFrame:
    """(product_id, word): distinct numbers in those features."""
    return physical_values(products).select("product_id", F.explode(T.numeric_words(F.col("v"))).alias("word")).distinct()


def ranked(words: DataFrame) -> DataFrame:
    """(idx, word) for distinct words in order, from 1.

    Words are counted by their first three characters; the running count of
    those few prefixes gives each prefix's first rank, and only words of one
    prefix are ordered in one task.
    """
    words = words.select("word", F.substring("word", 1, 3).alias("prefix"))
    ahead = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    first = words.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).select("prefix", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("prefix").orderBy("word"))
    return words.withColumn("own", own).join(first, "prefix").select((F.col("ahead") + F.col("own")).cast("bigint").alias("idx"), "word")


def vocabulary(products: DataFrame) -> DataFrame:
    """(idx, word): all title model words and feature numbers of these products, ranked."""
    return ranked(title_words(products).select("word").union(value_words(products).select("word")).distinct())


def _grams(text: Column) -> Column:
    """Distinct substrings of one to three characters."""
    def of(n: int) -> Column:
        last = F.length(text) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def representation(products: DataFrame, words: DataFrame) -> DataFrame:
    """(product_id, idx) for each word that is a substring of the title or of a physical feature's value.

    A word's first three characters (or all of a shorter one) are the key of an
    equi-join with the texts' substrings of that length, so that texts and words
    are never compared all with all; the whole word is then looked for. The words
    are measured for the join, so they had better be staged.
    """
    texts = products.select("product_id", F.col("title").alias("text")).union(physical_values(products).select("product_id", F.col("v").alias("text")))
    pieces = texts.filter("text is not null").select("product_id", "text", F.explode(_grams(F.col("text"))).alias("gram"))
    keyed = lesser(words.select("idx", "word", F.substring("word", 1, 3).alias("gram")), words.agg(room("word")).first()[0])
    return pieces.join(keyed, "gram").filter(F.contains("text", "word")).select("product_id", "idx").distinct()
