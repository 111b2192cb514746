"""Exact dedup by two passes over Bloom-filter slots.

Pass 1 hashes every text once and sets two slots of a blocked Bloom filter for
it. Slots that were set at least twice make up a second, much smaller filter:
the bitmaps of *repeated* slots. Pass 2 tests every row against those bitmaps.
A row that has a slot set only once is certainly unique and passes straight
through; only rows that may be repeated are shuffled and grouped, and the
grouping then tells exactly.

Bitmaps of at most ``broadcast_bytes`` (measured) are broadcast. Larger ones
meet the thin rows, a hash each, by a shuffle on the block; the hashes that turn
out repeated then set the slots of a filter of at most ``broadcast_bytes``,
which every text is tested against where it lies. So texts that are single
don't shuffle at any size, but for the false positives of that last filter.

Groups are summed before they are shuffled; the sums of groups with more than
1/2000 of all rows, of which there are fewer than 2000, come back by a broadcast.

All of this is DataFrame code: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.store import col, discard, fresh, staged

BITS = 32768  # of a bitmap_construct_agg bitmap
SHARE = 2000  # groups with more than one part in so many of all rows count as large


#: Runs that a space takes the place of: all but single spaces, which stay as they are.
CHANGED = r"[\x09-\x0D][\x20\x09-\x0D]*+|\x20[\x20\x09-\x0D]++"


def normalised(text: Column) -> Column:
    """Each run of blanks (``[\\x20\\x09-\\x0D]+``) as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), CHANGED, " ")


def _slots(h: Column, blocks: int) -> tuple[Column, Column, Column]:
    """Block of the filter and two positions in it, from one 64-bit hash."""
    return (
        F.pmod(h, F.lit(blocks)),
        F.shiftrightunsigned(h, 33).bitwiseAND(BITS - 1),
        F.shiftrightunsigned(h, 48).bitwiseAND(BITS - 1),
    )


def blocks_of(rows: int, bits_per_row: int) -> int:
    return max(1, -(-rows * bits_per_row // BITS))


def slots_of(hashes: DataFrame, h: str, blocks: int) -> DataFrame:
    """(block, slot) of each row, once where both slots fall on one position."""
    block, first, second = _slots(col(h), blocks)
    return hashes.select(block.alias("block"), F.explode(F.array_distinct(F.array(first, second))).alias("slot"))


def repeated_slots(hashes: DataFrame, h: str, blocks: int) -> DataFrame:
    """Bitmaps of the slots that are set at least twice: (block, bits).

    The shuffle carries one partial count a slot and task, never a text.
    """
    twice = slots_of(hashes, h, blocks).groupBy("block", "slot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return twice.groupBy("block").agg(F.bitmap_construct_agg("slot").alias("bits"))


def _has(bits: Column, slot: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(slot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(slot, F.lit(8)).cast("int")) == 1


def maybe_repeated(df: DataFrame, h: Column, bitmaps: DataFrame, blocks: int, flag: str, small: bool = True) -> DataFrame:
    """``df`` with a boolean column that is false only for rows whose hash is not in the filter; bitmaps that are not ``small`` meet the rows by a shuffle."""
    block, first, second = _slots(h, blocks)
    names = [fresh(df, x) for x in ("k_block", "k_bits")]
    probe = bitmaps.select(F.col("block").alias(names[0]), F.col("bits").alias(names[1]))
    met = F.coalesce(_has(F.col(names[1]), first) & _has(F.col(names[1]), second), F.lit(False))
    return df.join(F.broadcast(probe) if small else probe.hint("shuffle_hash"), block == F.col(names[0]), "left").select(*map(col, df.columns), met.alias(flag))


def repeated_filter(hashes: DataFrame, h: str, bits_per_row: int, broadcast_bytes: int) -> tuple[DataFrame, int]:
    """A filter of at most ``broadcast_bytes`` that holds every hash which occurs twice or more: bitmaps (staged) and the number of blocks."""
    most = max(1, broadcast_bytes // (BITS // 8 + 64))
    blocks = blocks_of(hashes.count(), bits_per_row)
    bitmaps = staged(repeated_slots(hashes, h, blocks), "bitmaps")
    if bitmaps.count() <= most:
        return bitmaps, blocks
    maybe = maybe_repeated(hashes.select(h), col(h), bitmaps, blocks, "k_maybe", small=False).filter("k_maybe")
    repeated = staged(maybe.groupBy(h).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(h), "repeated")
    blocks = min(most, blocks_of(repeated.count(), bits_per_row))
    held = slots_of(repeated, h, blocks).groupBy("block").agg(F.bitmap_construct_agg("slot").alias("bits"))
    return staged(held, "bitmaps"), blocks


def mark_exact(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    *,
    bits_per_row: int = 16,
    broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """One row per input row: its key, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they agree after each run of blanks becomes one space;
    a null text is the empty text, and all such rows are one group. Of a group
    the smallest key stays (a null key only where the group has no other).
    Repeated rows with the same key and equal texts cannot be told apart: all
    count in ``group_size`` and all carry the same ``kept``. An empty table
    gives an empty result. Other columns are not read, so their names are free.
    """
    norm = normalised(col(text))
    thin = staged(
        df.select(col(key).alias("id"), F.xxhash64(norm).alias("h"), F.unhex(F.sha2(norm, 256)).alias("sha")), "digests"
    )
    bitmaps, blocks = repeated_filter(thin, "h", bits_per_row, broadcast_bytes)
    flagged = maybe_repeated(thin, F.col("h"), bitmaps, blocks, "maybe")
    single, maybe = flagged.filter(~F.col("maybe")), flagged.filter("maybe")
    groups = staged(maybe.groupBy("sha").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    large = F.broadcast(groups.filter(F.col("group_size") > max(256, thin.count() // SHARE)))  # fewer than SHARE rows
    met = maybe.join(large, "sha").unionByName(maybe.join(large, "sha", "left_anti").join(groups, "sha"))
    columns = ["id", "keep_id", "group_size", "sha"]
    alone = single.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "sha")
    return alone.unionByName(met.select(*columns)).select(
        F.col("id").alias(key),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact(
    df: DataFrame, text: str = "text", key: str = "doc_id", *, bits_per_row: int = 16, broadcast_bytes: int = 64 << 20
) -> DataFrame:
    """The rows of ``df`` with one of each group of equal texts, all columns as they were.

    Rows that are certainly single never shuffle. Of the others, each task
    keeps its own smallest row of a group before the shuffle, so a hot group
    sends one row a task. Of rows with the smallest key (repeated rows), the one
    with the smallest hash of all its columns that can be hashed stays.
    """
    norm = normalised(col(text))
    hashes = staged(df.select(F.xxhash64(norm).alias("h")), "hashes")
    bitmaps, blocks = repeated_filter(hashes, "h", bits_per_row, broadcast_bytes)
    discard(hashes)
    names = df.columns
    sha, flag, row = "k_sha", fresh(df, "k_maybe"), "k_row"
    flagged = maybe_repeated(df, F.xxhash64(norm), bitmaps, blocks, flag)
    single, maybe = flagged.filter(~F.col(flag)).drop(flag), flagged.filter(F.col(flag)).drop(flag)
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    order = F.struct(col(key).isNull(), col(key), F.xxhash64(*map(col, plain)))
    first = (
        maybe.select(F.sha2(norm, 256).alias(sha), order.alias("k_order"), F.struct(*map(col, names)).alias(row))
        .groupBy(sha)
        .agg(F.min_by(row, "k_order").alias(row))
    )
    return single.unionByName(first.select(*[F.col(row).getField(c).alias(c) for c in names]))
