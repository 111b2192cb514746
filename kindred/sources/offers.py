"""Offers made from the whole part table: four shops list each part, each in its own style."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.sources.products import with_features

#: The same text runs in Spark and in DuckDB.
OFFERS = """
WITH j AS (SELECT p_partkey AS pk, sk, p_name, p_size,
                  concat('br', translate(substr(p_brand, 7), '0123456789', 'abcdefghij')) AS br,
                  concat('mx', cast(1000 + p_partkey % 200 AS string)) AS mw
           FROM part CROSS JOIN (VALUES (0), (1), (2), (3)) AS shops(sk))
SELECT pk * 4 + sk AS product_id, concat('m', cast(pk AS string)) AS model_id, concat('shop', cast(sk AS string)) AS shop,
       CASE sk WHEN 0 THEN concat(br, ' ', cast(p_size AS string), '" ', mw, ' ', p_name)
               WHEN 1 THEN concat(br, ' ', p_name, ' ', mw, ' ', cast(p_size AS string), '-Inch')
               WHEN 2 THEN concat(p_name, ' (', mw, ') ', cast(p_size AS string), ' inches ', br)
               ELSE concat(br, '/', p_name, ' ', mw, ', ', cast(p_size AS string), ' inch class 60Hertz') END AS title
FROM j
"""
FEATURES = """
WITH j AS (SELECT p_partkey AS pk, sk, p_size, p_type,
                  concat('br', translate(substr(p_brand, 7), '0123456789', 'abcdefghij')) AS br
           FROM part CROSS JOIN (VALUES (0), (1), (2), (3)) AS shops(sk))
SELECT pk * 4 + sk AS product_id, 'Brand' AS k, CASE WHEN sk = 0 THEN upper(br) ELSE br END AS v FROM j WHERE sk <> 2
UNION ALL SELECT pk * 4 + sk, CASE WHEN sk < 2 THEN 'Screen Size' ELSE 'Screen Size (in)' END, concat(cast(p_size AS string), CASE WHEN sk < 2 THEN 'inch' ELSE ' inches' END) FROM j
UNION ALL SELECT pk * 4 + sk, 'Refresh Rate', concat(cast(60 * (1 + pk % 4) AS string), 'Hz') FROM j WHERE sk <> 3
UNION ALL SELECT pk * 4 + sk, CASE WHEN sk = 1 THEN 'Item Weights' ELSE 'Item Weight' END, concat(cast(10 + pk % 17 AS string), '.', cast(pk % 10 AS string), 'lbs') FROM j
UNION ALL SELECT pk * 4 + sk, 'Category', lower(p_type) FROM j
"""


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("part")
    return spark.sql(OFFERS)


def offer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("part")
    return spark.sql(FEATURES)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_features(offers(spark, sf_dir), offer_features(spark, sf_dir))
