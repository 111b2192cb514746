import math

import numpy as np
from pyspark.sql import functions as F

from kindred.llm import topk
from kindred.llm.store import staged


def brute(rows, k=5):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, w) in enumerate(fine):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(w, x)), i) for n, (i, x) in enumerate(fine) if n != at and len(x) == len(w))
            out += [(q, n + 1, i, min(-s, 2**63 - 1)) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "vec_id bigint, embedding array<double>, id string, v string")
    got = topk.top_k(df, F.pmod("vec_id", F.lit(50)) == 0, **options)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect())


def test_agrees_with_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.4).tolist()) for i in range(600)]
    rows += [(700 + i, [0.5] * 8) for i in range(30)]  # ties
    assert run(spark, rows, pivots=8, block_rows=32, group_rows=4) == brute(rows)


def test_hard_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (None, [1.0, 1.0]), (50, [1.0, 2.0, 3.0]), (100, []), (150, []), (6, [3e7, -3e7]), (200, [4e7, 1.0]), (7, [-0.001, 0.0])]
    assert run(spark, rows) == brute(rows)


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 1.0]), (0, [1.0, 1.0]), (0, [9.0, 9.0]), (1, [0.5, 0.5]), (1, [2.0, 2.0]), (1, [2.0, 2.0]), (2, [2.0, 2.0])]
    got = run(spark, rows)
    assert got == brute(rows)
    assert len(got) == 15 and (0, 1, 0, 1179648) in got


def test_rows_go_only_to_groups_that_need_them(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 20
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * 0.1).tolist()) for i in range(2400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    whole = staged(topk.whole_vectors(df, "vec_id", "embedding", 256.0, F.col("vec_id") % 7 == 0), "vectors")
    pivots = topk.pivots_of(whole, 48)
    asked, data = topk.dealt(staged(topk.with_cells(whole, pivots), "cells"), pivots, 5, 64, 16)
    groups = asked.select("grp").distinct().count()
    sizes = [r["n"] for r in asked.select("grp", "row").distinct().groupBy("grp").agg(F.count("*").alias("n")).collect()]
    assert groups >= 343 / 16 and sum(sizes) == 343
    assert data.count() <= 0.5 * groups * 2400
    where = topk.VISIT
    assert asked.select(*where).distinct().join(data.select(*where).distinct(), where, "left_anti").count() == 0


def test_no_rows(spark):
    assert run(spark, []) == []


def test_huge_components_stay_exact():
    q, x = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0], [2.0**20, 2.0]])
    assert topk.best_of(np.array([0]), q, np.array([1, 2]), np.array([1, 2]), x, 1) == [(0, 2, 2**60 + 6)]
