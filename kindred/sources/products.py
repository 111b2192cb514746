"""Product tables: from JSON files of grouped products, and from any table of offers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRODUCT = T.StructType(
    [
        T.StructField("shop", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("modelID", T.StringType()),
        T.StructField("featuresMap", T.MapType(T.StringType(), T.StringType())),
    ]
)
COLUMNS = ("product_id", "model_id", "shop", "title", "features")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Products of JSON files, each one object: group -> list of products.

    ``product_id`` counts from 1 in order of file, group and place. A file is one
    value and is parsed by one task; ids come from a window per file and the
    count of rows in earlier files, so no task sees more than one file.
    """
    files = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("file"), F.col("value"))
    groups = files.select("file", F.from_json("value", T.MapType(T.StringType(), T.ArrayType(PRODUCT))).alias("groups"))
    # entries, not a bare map, so that the order of the file is kept
    rows = groups.select("file", F.posexplode(F.map_entries("groups")).alias("g", "entry")).select("file", "g", F.posexplode("entry.value").alias("i", "x"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("g", "i")))
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    counts = counts.withColumn("ahead", F.coalesce(F.sum("rows").over(ahead), F.lit(0))).drop("rows")
    return rows.join(counts, "file").select(
        (F.col("ahead") + F.col("n")).cast("bigint").alias("product_id"),
        F.col("x.modelID").alias("model_id"),
        F.col("x.shop").alias("shop"),
        F.col("x.title").alias("title"),
        F.col("x.featuresMap").alias("features"),
    )


def with_features(offers: DataFrame, features: DataFrame) -> DataFrame:
    """Offers with their long-form features (product_id, k, v) as a map; of repeated names the largest value stays."""
    once = features.groupBy("product_id", "k").agg(F.max("v").alias("v"))
    maps = once.groupBy("product_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("features"))
    empty = F.create_map().cast("map<string,string>")
    return offers.join(maps, "product_id", "left").select("product_id", "model_id", "shop", "title", F.coalesce("features", empty).alias("features"))
