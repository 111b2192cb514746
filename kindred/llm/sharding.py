"""Sharding by balanced label propagation.

Documents with equal texts are linked. Each document starts in a random shard;
in every round a linked document looks where most of its neighbours are and
moves there if that shard's quota has room. Links run through the text's hash
(a star, not all pairs), and documents that share text, shard and salt move as
one cell; a text that many rows have is cut into more cells the more it has, so
no cell holds more than about 1/128,000 of all rows, or 2,000 rows.

Quotas leave a quarter beyond an even share, or full shards would hold up every
move into them. At last the rows are ranked by shard, text and salt, and the
ranking is cut into equal parts: counts differ by one at most, and beyond the
links that the rounds left, a cut can only split the texts at its ends.

All of this is DataFrame code: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.store import col, discard, staged

SALTS = 64
HOT = 2000  # fewer texts than this can have more than 1/HOT of all rows each


def _unit(*parts: Column) -> Column:
    """An even draw from [0, 1) that depends on the values alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / float(1 << 53)


def propagate(cells: DataFrame, n_shards: int, quota: float, sizes: list[int], rounds: int) -> DataFrame:
    """``cells`` (g, salt, n, shard) after moves towards each text's commonest shard.

    ``sizes``: rows of each shard now. In a round a shard takes in what its
    quota leaves free plus what surely leaves it; cells beyond that stay, by a
    draw. Stops when nothing moves.
    """
    for r in range(rounds):
        votes = cells.groupBy("g", "shard").agg(F.sum("n").alias("votes"))
        # equal votes are settled by a hash of text, shard and round, so that no shard is everybody's wish
        wish = votes.groupBy("g").agg(F.max_by("shard", F.struct("votes", F.xxhash64("g", "shard", F.lit(r)))).alias("wish"))
        moving = staged(cells.join(wish, "g"), f"round_{r}")
        flows = moving.filter("shard <> wish").groupBy("shard", "wish").agg(F.sum("n").alias("n")).collect()  # at most shards squared
        if not flows:
            discard(moving)
            break
        into = [sum(f["n"] for f in flows if f["wish"] == s) for s in range(n_shards)]
        out = [sum(f["n"] for f in flows if f["shard"] == s) for s in range(n_shards)]
        share = [1.0] * n_shards
        for _ in range(32):  # what leaves a shard makes room in it, so the shares depend on each other
            left = [sum(f["n"] * share[f["wish"]] for f in flows if f["shard"] == s) for s in range(n_shards)]
            share = [min(1.0, max(0.0, quota - sizes[s] + left[s]) / into[s]) if into[s] else 1.0 for s in range(n_shards)]
        if not any(x > 0 and n for x, n in zip(share, into, strict=True)) or not any(out):
            break
        chance = F.element_at(F.array(*map(F.lit, share)), F.col("wish") + 1)
        goes = _unit(F.col("g"), F.col("salt"), F.lit(r)) < chance
        cells = staged(moving.select("g", "salt", "n", F.when(goes, F.col("wish")).otherwise(F.col("shard")).alias("shard")), f"cells_{r}")
        now = {x["shard"]: x["n"] for x in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        before = {x["shard"]: x["n"] for x in moving.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        sizes = [s + now.get(i, 0) - before.get(i, 0) for i, s in enumerate(sizes)]
        discard(moving)
    return cells


def shard_documents(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    *,
    n_shards: int = 8,
    rounds: int = 6,
    slack: float = 0.25,
    bucket_rows: int = 2000,
) -> DataFrame:
    """Every row's shard under the law ``rows``: key, size, text_crc32, law, shard, slot, grown_shard.

    Shards hold numbers of rows that differ by one at most; ``slot`` counts the
    rows of a shard from 0 without gaps. ``size`` is the text's bytes in UTF-8
    plus 1; a null text has none, and is linked with empty texts. Null keys and
    repeated rows are sharded like others; rows that agree in key and text are
    interchangeable and share a cell, however many they are. ``grown_shard`` belongs to another law and is null. No
    rows give no rows. Other columns are not read.
    """
    body = F.coalesce(col(text), F.lit(""))
    g = F.xxhash64(body)
    base = staged(
        df.select(
            col(key).alias("id"),
            (F.octet_length(body).cast("bigint") + 1).alias("size"),
            F.crc32(body.cast("binary")).alias("crc"),
            g.alias("g"),
            F.pmod(F.xxhash64(col(key), F.lit(7)), F.lit(SALTS)).cast("int").alias("salt"),
        ),
        "rows",
    )
    total = base.count()
    start = F.pmod(F.xxhash64("g", "salt", F.lit(3)), F.lit(n_shards)).cast("int")
    cells = staged(base.groupBy("g", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("shard", start), "cells")
    sums = cells.groupBy("g").agg(F.sum("n").alias("all"))
    hot = staged(sums.filter((F.col("all") * HOT > total) & (F.col("all") > SALTS * bucket_rows)).select("g", (SALTS * F.ceil(F.col("all") * HOT / total)).alias("salts")), "hot")
    if not hot.isEmpty():
        more = F.coalesce(F.pmod(F.xxhash64("id", F.lit(7)), F.col("salts")).cast("int"), F.col("salt"))
        base = base.join(F.broadcast(hot), "g", "left").select("id", "size", "crc", "g", more.alias("salt"))
        cells = staged(base.groupBy("g", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("shard", start), "cells")
    linked = cells.groupBy("g").agg(F.sum("n").alias("all")).filter(F.col("all") > 1).select("g")
    at_first = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    moved = propagate(
        staged(cells.join(linked, "g", "left_semi"), "linked"), n_shards, (1 + slack) * total / n_shards, [at_first.get(s, 0) for s in range(n_shards)], rounds
    )
    cells = cells.drop("shard").join(moved.select("g", "salt", F.col("shard").alias("to")), ["g", "salt"], "left").withColumn("shard", F.coalesce("to", start)).drop("to")

    # rank of a cell's first row: rows in earlier buckets, then in earlier cells of its own
    buckets = max(1, min(8192, -(-total // (bucket_rows * n_shards))))
    cells = staged(cells.withColumn("bucket", F.pmod("g", F.lit(buckets)).cast("int")), "placed")
    before = Window.orderBy("shard", "bucket").rowsBetween(Window.unboundedPreceding, -1)  # over shards x buckets: 65,536 rows at most with 8 shards
    offsets = cells.groupBy("shard", "bucket").agg(F.sum("n").alias("n")).withColumn("from", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("shard", "bucket").orderBy("g", "salt").rowsBetween(Window.unboundedPreceding, -1)
    first = cells.withColumn("ahead", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(offsets), ["shard", "bucket"]).select("g", "salt", (F.col("from") + F.col("ahead")).alias("first"))
    own = Window.partitionBy("g", "salt").orderBy("id", "crc")
    ranked = base.withColumn("k", F.row_number().over(own) - 1).join(first, ["g", "salt"]).withColumn("rank", F.col("first") + F.col("k"))
    shard = F.expr(f"cast(rank * {n_shards} div {max(1, total)} as int)")
    return ranked.withColumn("shard", shard).select(
        F.col("id").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        F.expr(f"cast(rank - (shard * cast({total} as bigint) + {n_shards - 1}) div {n_shards} as bigint)").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
