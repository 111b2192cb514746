"""The whole resolution: from products to clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import text as T
from kindred.functions.hashing import steady_coefficients
from kindred.functions.similarity import Parameters
from kindred.operators import blocking, brands, cluster, scoring
from kindred.operators.tables import cut


def prepared(products: DataFrame) -> DataFrame:
    """Cleaned titles, brands made alike and imputed.

    Both steps are written down: what follows reads titles and features many
    times over, and would clean them anew each time.
    """
    cleaned = products.withColumn("title", T.clean_title(F.coalesce("title", F.lit(""))))
    return cut(brands.impute_brand(cut(brands.with_brand(cleaned))))


def resolve(products: DataFrame, t: float = 0.5, p: Parameters = Parameters(), coefficients=steady_coefficients) -> DataFrame:
    """(product_id, cluster_id) of every product."""
    ready = prepared(products)
    pairs = blocking.blocks(ready, t, coefficients).comparable(ready)
    return cluster.clusters(ready, cut(scoring.distances(pairs, ready, p)), p.epsilon)
