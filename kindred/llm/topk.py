"""Exact top-k search by inner product: a Voronoi kNN join.

Rows are dealt to the cell of their nearest pivot. A summary of each cell (its
rows, its radius, its smallest distances to the pivot) gives every query two
bounds without looking at a row:

    <q, p> - |q| d  <=  <q, x>  <=  <q, p> + |q| r

for a row x at distance d from pivot p in a cell of radius r. The k-th best of
the lower bounds over all cells is a score that k rows surely reach; a cell
whose upper bound is below it can hold nothing better and does not get the
query. Cells are cut into blocks of bounded size. Queries form groups of bounded
size, of the same cell or of cells whose pivots are near each other, and a
cell's rows are copied only to the groups with a query that needs the cell.
Each (block, group) is solved on its own by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.store import col, staged

EXACT = float(1 << 53)  # whole numbers up to here are exact in double precision


def whole_vectors(df: DataFrame, key: str, vector: str, scale: float, is_query: Column) -> DataFrame:
    """(row, id, asks, v): vectors turned into whole numbers, floor(scale * x); those null or with null, NaN or infinite components left out. ``row`` holds once the rows are staged."""
    v = col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(
        F.monotonically_increasing_id().alias("row"),
        col(key).cast("bigint").alias("id"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.when(fine, F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("double"))).alias("v"),
    ).filter("id is not null and v is not null")


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of one Arrow column, all of one length, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def pivots_of(vectors: DataFrame, count: int) -> dict[int, np.ndarray]:
    """For each length of vectors, at most ``count`` pivots: the rows first in a hashed order."""
    lengths = vectors.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for r in lengths:
        rows = vectors.filter(F.size("v") == r["dim"]).orderBy(F.xxhash64("row"), "row").limit(count).collect()
        out[r["dim"]] = np.unique(np.array([x["v"] for x in rows], float).reshape(len(rows), r["dim"]), axis=0)
    return out


def with_cells(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds dim, cell (of the nearest pivot) and d (distance to it)."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dim))
                x, p = matrix(part.column(3)), shared.value[int(dim)]
                if dim:
                    cell = ((p * p).sum(1) - 2 * x @ p.T).argmin(1)
                    d = np.sqrt(((x - p[cell]) ** 2).sum(1))
                else:
                    cell, d = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows)
                more = [pa.array(np.full(part.num_rows, dim, np.int64)), pa.array(cell), pa.array(d)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], ["row", "id", "asks", "v", "dim", "cell", "d"])

    return vectors.mapInArrow(deal, "row bigint, id bigint, asks boolean, v array<double>, dim bigint, cell bigint, d double")


def summaries(cells: DataFrame, k: int) -> dict[int, dict[str, np.ndarray]]:
    """For each length: rows, radius and the k+1 smallest distances of every cell. Bounded by pivots times k+1."""
    near = Window.partitionBy("dim", "cell").orderBy("d")
    few = cells.select("dim", "cell", "d").withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k + 1)
    few = few.groupBy("dim", "cell").agg(F.sort_array(F.collect_list("d")).alias("near"))
    whole = cells.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius"))
    out: dict[int, dict[str, list]] = {}
    for r in whole.join(few, ["dim", "cell"]).orderBy("dim", "cell").collect():
        kept = out.setdefault(r["dim"], {"cell": [], "n": [], "radius": [], "near": []})
        for name in ("cell", "n", "radius"):
            kept[name].append(r[name])
        kept["near"].append(r["near"] + [np.inf] * (k + 1 - len(r["near"])))
    return {dim: {name: np.array(x) for name, x in kept.items()} for dim, kept in out.items()}


def in_order(pivots: np.ndarray) -> list[int]:
    """A walk over the pivots that goes on to the nearest one that is left."""
    left, at, out = np.ones(len(pivots), bool), 0, []
    while True:
        left[at] = False
        out.append(at)
        if not left.any():
            return out
        at = int(np.where(left, ((pivots - pivots[at]) ** 2).sum(1), np.inf).argmin())


def groups(queries: DataFrame, pivots: dict[int, np.ndarray], size: int) -> tuple[dict[tuple[int, int], tuple[int, int]], int]:
    """For each (dim, cell) with queries the first of its groups and their number, and the number of all groups.

    Cells follow one another by ``in_order``: small ones share a group of at
    most ``size`` queries, large ones are cut.
    """
    n = {(r["dim"], r["cell"]): r["n"] for r in queries.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one a pivot
    out, made = {}, 0
    for dim, p in sorted(pivots.items()):
        held = 0
        for cell in in_order(p):
            have = n.get((dim, cell), 0)
            if not have:
                continue
            if held and held + have <= size:
                out[dim, cell], held = (made - 1, 1), held + have
            else:
                parts = -(-have // size)
                out[dim, cell], made, held = (made, parts), made + parts, have if parts == 1 else 0
    return out, made


VISIT = ["dim", "cell", "block", "grp"]


def visits(queries: DataFrame, pivots: dict, summary: dict, grouped: dict, k: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """For each query a row a block that may hold one of its best (dim, cell, block, grp, row, id, v); and the groups (dim, cell, grp) that need a cell."""
    shared = queries.sparkSession.sparkContext.broadcast((pivots, summary, grouped))

    def needed(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, dict]]:
        """Queries of one length, their groups, and a mark for each query and cell."""
        pivots, summary, grouped = shared.value
        dims = batch.column(4).to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            whole, s = batch.filter(pa.array(dims == dim)), summary[dim]
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                q = matrix(part.column(3)).reshape(part.num_rows, dim)
                own = [grouped[dim, c] for c in part.column(5).to_pylist()]
                grp = np.array([first + hash(r) % parts for (first, parts), r in zip(own, part.column(0).to_pylist(), strict=True)], np.int64)
                near = q @ pivots[dim][s["cell"]].T if dim else np.zeros((len(q), 1))
                norm = np.sqrt((q * q).sum(1))[:, None]
                # a query counts itself among the rows, so the k+1-st bound is the one that k others reach
                with np.errstate(invalid="ignore"):
                    low = (near[:, :, None] - norm[:, :, None] * s["near"][None]).reshape(len(q), -1)
                low = np.where(np.isnan(low), -np.inf, low)
                bound = -np.partition(-low, k, axis=1)[:, k] if low.shape[1] > k else np.full(len(q), -np.inf)
                slack = 1e-6 * (1 + norm[:, 0] * (1 + s["radius"].max()) + np.abs(near).max(1))
                yield part, grp, near + norm * s["radius"][None] >= (bound - slack)[:, None], s

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, grp, go, s in needed(batch):
                rows, cells = np.nonzero(go)
                blocks = np.maximum(1, -(-s["n"][cells] // block_rows))
                times = np.repeat(np.arange(len(rows)), blocks)
                block = np.arange(len(times)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                for i in range(0, len(times), 4096):
                    t = times[i : i + 4096]
                    own = part.take(pa.array(rows[t]))
                    cols = [own.column(4), pa.array(s["cell"][cells[t]]), pa.array(block[i : i + 4096]), pa.array(grp[rows[t]]), own.column(0), own.column(1), own.column(3)]
                    yield pa.RecordBatch.from_arrays(cols, [*VISIT, "row", "id", "v"])

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, grp, go, s in needed(batch):
                rows, cells = np.nonzero(go)
                pairs = np.unique(np.stack([s["cell"][cells], grp[rows]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), part.column(4)[0].as_py(), np.int64)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["dim", "cell", "grp"])

    queries = queries.select("row", "id", "asks", "v", "dim", "cell")
    asked = queries.mapInArrow(route, "dim bigint, cell bigint, block bigint, grp bigint, row bigint, id bigint, v array<double>")
    return asked, queries.mapInArrow(need, "dim bigint, cell bigint, grp bigint").distinct()


def best_of(q_rows: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, id, score) of the k best rows other than itself for each query; ties to the smaller id. Queries are counted from 0."""
    exact = not q.size or not x.size or np.abs(q).max() * np.abs(x).max() * q.shape[1] < EXACT
    order = np.argsort(ids, kind="stable")
    rows, ids, x = rows[order], ids[order], x[order]
    found = []
    for i in range(0, len(q), 256):
        part = q[i : i + 256]
        if exact:
            scores = (part @ x.T).astype(np.int64)
        else:  # too large for doubles: whole numbers without bounds, cut to what a long holds
            long = np.iinfo(np.int64)
            big = np.array([[int(c) for c in r] for r in x], object).reshape(x.shape)
            scores = np.array([[min(max(int(s), long.min + 1), long.max) for s in big @ np.array([int(c) for c in r], object)] for r in part], np.int64).reshape(len(part), len(x))
        for j in range(len(part)):
            s, own = scores[j], rows != q_rows[i + j]
            s, have = s[own], ids[own]
            if len(s) > k:
                edge = -np.partition(-s, k - 1)[k - 1]
                more = np.nonzero(s > edge)[0]
                pick = np.concatenate([more, np.nonzero(s == edge)[0][: k - len(more)]])  # ids rise, so the first are the smaller
            else:
                pick = np.arange(len(s))
            found += [(i + j, int(have[p]), int(s[p])) for p in pick]
    return found


def dealt(cells: DataFrame, pivots: dict, k: int, block_rows: int, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """Queries and rows where they meet, by VISIT: a row is there once for each group that needs its cell."""
    spark = cells.sparkSession
    summary = summaries(cells, k)
    queries = cells.filter("asks")
    grouped, made = groups(queries, pivots, group_rows)
    asked, needed = visits(queries, pivots, summary, grouped, k, block_rows)
    n_of = [(dim, int(c), max(1, -(-int(n) // block_rows))) for dim, s in summary.items() for c, n in zip(s["cell"], s["n"], strict=True)]
    sizes = spark.createDataFrame(n_of, "dim bigint, cell bigint, blocks bigint")  # a row a pivot
    data = cells.join(F.broadcast(sizes), ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("row"), F.col("blocks")).alias("block"), "row", "id", "v")
    lists = needed.groupBy("dim", "cell").agg(F.collect_list("grp").alias("grps"))
    if len(n_of) * made <= 1 << 18:  # numbers that the broadcast holds at most
        data = data.join(F.broadcast(lists), ["dim", "cell"])
    else:  # by block, as a cell may hold any part of the rows
        blocks = lists.join(F.broadcast(sizes), ["dim", "cell"]).select("dim", "cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), "grps")
        data = data.join(blocks, ["dim", "cell", "block"])
    return asked, data.select("dim", "cell", "block", F.explode("grps").alias("grp"), "row", "id", "v")


def top_k(
    df: DataFrame,
    is_query: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    *,
    k: int = 5,
    scale: float = 256.0,
    pivots: int | None = None,
    block_rows: int = 4096,
    group_rows: int = 2048,
) -> DataFrame:
    """The k rows with the highest inner product for each query row: query_id, rank, vec_id, score.

    Components become floor(scale * x) and scores are whole numbers. Every row
    but the query's own is a candidate, also one with the query's id or a copy
    of it; equal scores go to the smaller id; a score that no long holds is cut
    to the largest or smallest one. A query with fewer than k candidates gets
    all of them. Rows that repeat an id are rows like others, as queries too:
    each gives its own k results. Vectors that are null or hold a null, NaN or
    infinite component, and rows without an id, take no part; vectors meet only
    those of their own length, and each length costs a job. ``pivots`` (None:
    one for each ``block_rows`` rows, 48 at least and 1,024 at most; so many
    vectors of a length reach the driver), ``block_rows`` and ``group_rows``
    change the work, never the result. An empty table gives an empty result.
    """
    rows = staged(whole_vectors(df, key, vector, scale, is_query), "vectors")
    count = pivots or max(48, min(1024, rows.count() // block_rows))
    centres = pivots_of(rows, count)
    cells = staged(with_cells(rows, centres), "cells")
    asked, data = dealt(cells, centres, k, block_rows, group_rows)

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        found, q_rows, q_ids = [], left["row"].to_numpy(), left["id"].to_numpy()
        if left.num_rows and right.num_rows:
            q, x = matrix(left["v"].combine_chunks()), matrix(right["v"].combine_chunks())
            found = best_of(q_rows, q, right["row"].to_numpy(), right["id"].to_numpy(), x, k)
        which, ids, scores = (np.array([f[i] for f in found], np.int64) for i in range(3))
        return pa.table({"query_row": q_rows[which], "query_id": q_ids[which], "vec_id": ids, "score": scores})

    local = asked.groupBy(*VISIT).cogroup(data.groupBy(*VISIT)).applyInArrow(solve, "query_row bigint, query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
