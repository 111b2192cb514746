"""Brands: made alike, imputed from titles, and used to rule out pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators.tables import lesser, room

# The mark of a missing brand, brands with two spellings, and brands that are known beyond the data.
MISSING = "nobrand"
SPELLINGS = {"lg electronics": "lg", "jvc tv": "jvc"}
KNOWN = ("tcl", "insignia", "avue", "optoma", "dynex", "mitsubishi", "contex")


def normal_brand(features: Column) -> Column:
    """The Brand feature in lower case and one spelling; MISSING where there is none."""
    brand = F.lower(F.coalesce(F.try_element_at(features, F.lit("Brand")), F.lit(MISSING)))
    for old, new in SPELLINGS.items():
        brand = F.when(brand == old, F.lit(new)).otherwise(brand)
    return brand


def with_brand(products: DataFrame) -> DataFrame:
    """Adds ``brand`` and writes it back into the features, where it takes part in matching."""
    return products.withColumn("brand", normal_brand(F.col("features"))).withColumn("features", _put(F.col("features"), F.col("brand")))


def _put(features: Column, brand: Column) -> Column:
    return F.map_concat(F.map_filter(features, lambda k, _: k != "Brand"), F.create_map(F.lit("Brand"), brand))


def brand_set(branded: DataFrame) -> DataFrame:
    """Distinct brands of the products and those known beyond."""
    known = branded.sparkSession.createDataFrame([(b,) for b in KNOWN], "brand string")
    return branded.select("brand").filter(F.col("brand") != MISSING).union(known).distinct()


def _cutter(n: int):
    return lambda i: F.substring(F.col("title"), i, F.lit(n))


def impute_brand(branded: DataFrame) -> DataFrame:
    """Where the brand is missing, the longest known brand that the cleaned title holds (of equal lengths the first by letters).

    A brand in a title is found by its letters: titles are cut into all their
    substrings as long as some brand, which an equi-join meets with the brands.
    So neither brands nor titles are compared all with all.
    """
    brands = brand_set(branded)
    sizes = brands.groupBy(F.length("brand").alias("n")).agg(room("brand").alias("room")).filter("n > 0").collect()  # as many as there are lengths
    lengths = [r["n"] for r in sizes]
    brands = lesser(brands, sum(r["room"] for r in sizes))
    lacking = branded.filter(F.col("brand") == MISSING).select("product_id", "title")
    size = F.length("title")
    pieces = [F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), _cutter(n))) for n in sorted(lengths)]
    parts = F.array_distinct(F.flatten(F.array_compact(F.array(*pieces))))
    found = lacking.select("product_id", F.explode(parts).alias("brand")).join(brands, "brand")
    best = found.groupBy("product_id").agg(F.min(F.struct((-F.length("brand")).alias("n"), "brand")).alias("best")).select("product_id", F.col("best.brand").alias("imputed"))
    out = branded.join(best, "product_id", "left")
    brand = F.coalesce("imputed", "brand")
    return out.withColumn("features", _put(F.col("features"), brand)).withColumn("brand", brand).drop("imputed")


def comparable(pairs: DataFrame, products: DataFrame) -> DataFrame:
    """Pairs (l, r) of different shops whose brands agree or are not both known."""
    side = products.select("product_id", "shop", "brand")
    a, b = (side.select(*[F.col(c).alias(f"{c}_{x}") for c in side.columns]) for x in ("l", "r"))
    met = pairs.join(a, F.col("l") == F.col("product_id_l")).join(b, F.col("r") == F.col("product_id_r"))
    brands = (F.col("brand_l") == F.col("brand_r")) | (F.col("brand_l") == MISSING) | (F.col("brand_r") == MISSING)
    return met.filter(brands & (F.col("shop_l") != F.col("shop_r"))).select("l", "r")
