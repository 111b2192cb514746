"""Nodes that meet in buckets: pairs that agree in a band, listed or counted inside tasks, each in the first band in which it agrees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators.tables import cut, lesser

BLOCK = 4096  # rows of a block; a bucket of more is cut into blocks, which meet in pairs
PAIRS = 1 << 19  # pairs in hand


def _aimed(rows: DataFrame, on: list[str], blocks: DataFrame, place) -> DataFrame:
    """Rows with the units (i, j) that they go to; ``place`` gives those from a row's own block and the number of blocks."""
    k = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("node"), k).cast("int")
    aims = F.transform(F.sequence(F.lit(0), k - 1), lambda j: place(own, j))
    return rows.join(blocks, on, "left").withColumn("aim", F.explode(aims)).select(*rows.columns, "aim.*").drop("blocks")


def _aim(i: Column, j: Column, side: Column) -> Column:
    return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))


def _blocks(rows: DataFrame, on: list[str]) -> DataFrame:
    large = cut(rows.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).filter("blocks > 1"))
    return lesser(large, 128 * large.count())


def units(rows: DataFrame, on: list[str]) -> DataFrame:
    """Rows (on, node, ..) in units in which all rows of a bucket meet each other, pairs of blocks being units of their own."""
    meet = lambda own, j: _aim(F.least(own, j), F.greatest(own, j), own > j)
    return _dealt(_aimed(rows, on, _blocks(rows, on), meet), on)


def crossed(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """The same where rows of ``a`` meet rows of ``b`` alone, which have the same columns."""
    blocks = _blocks(a.select(*on).unionAll(b.select(*on)), on)
    left = _aimed(a, on, blocks, lambda own, j: _aim(own, j, F.lit(0)))
    right = _aimed(b, on, blocks, lambda own, j: _aim(j, own, F.lit(1)))
    return _dealt(left.unionByName(right), on, inner=False)


def _dealt(rows: DataFrame, on: list[str], inner: bool = True) -> DataFrame:
    where = [*on, "i", "j"]
    return rows.withColumn("inner", F.col("i") == F.col("j") if inner else F.lit(False)).repartition(*where).sortWithinPartitions(*where, "side")


def _whole(batches: Iterator[pa.RecordBatch], where: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole units, and where in them units begin (with the end)."""
    held: list[pa.RecordBatch] = []

    def cuts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows + 1, bool)
        new[[0, -1]] = True
        for c in where:
            col = t.column(c)
            new[1:-1] |= pc.fill_null(pc.not_equal(col.slice(1), col.slice(0, t.num_rows - 1)), True).to_numpy()
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held).combine_chunks()
        first = cuts(t)
        if len(first) > 2:
            yield t.slice(0, int(first[-2])).combine_chunks(), first[:-1]
            held = t.slice(int(first[-2])).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, cuts(t)


def _column(t: pa.Table, name: str) -> pa.Array:
    col = t.column(name).combine_chunks()
    return col.chunk(0) if isinstance(col, pa.ChunkedArray) else col


def _ragged(t: pa.Table, name: str) -> tuple[pa.Array, np.ndarray]:
    """Values of a list column, and where each row's begin (with the end)."""
    col = _column(t, name)
    return col.flatten(), np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _ranges(n: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of entries that add up to about ``size``."""
    total, at = np.cumsum(n), 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right")))
        yield at, end
        at = end


def _counted_out(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries repeated n times each: the entry, and which of its repeats."""
    entry = np.repeat(np.arange(len(n)), n)
    return entry, np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)


def ordered(t: pa.Table, first: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (p, q) of one unit that are to meet, about ``most`` pairs at a time."""
    side, inner = _column(t, "side").to_numpy(), _column(t, "inner").to_numpy(zero_copy_only=False)
    end = np.repeat(first[1:], np.diff(first))
    ones = np.concatenate([[0], np.cumsum(side == 0)])
    middle = np.repeat(first[:-1] + ones[first[1:]] - ones[first[:-1]], np.diff(first))
    begin = np.where(inner, np.arange(len(side)) + 1, middle)
    n = np.where(side == 0, end - begin, 0)
    for a, b in _ranges(n, most):
        p, q = _counted_out(n[a:b])
        p += a
        q += begin[p]
        yield p, q


def met(t: pa.Table, first: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (p, q) of one unit that agree in a band of ``width`` words.

    ``words`` are the bands up to the one that the unit stands for: the last must
    agree and none before may.
    """
    words, start = _ragged(t, "words")
    words = words.to_numpy()
    size = np.diff(start)
    table = np.zeros((int(size.max(initial=0)), len(size)), np.int64)  # a row of the table for each word
    row, col = _counted_out(size)
    table[col, row] = words
    last = size // width - 1
    for p, q in ordered(t, first, PAIRS):
        most = int(last[p].max(initial=-1))

        def agree(band: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
            same = table[band * width][p] == table[band * width][q]
            for k in range(1, width):
                same &= table[band * width + k][p] == table[band * width + k][q]
            return same

        same = np.ones(len(p), bool)
        for k in range(width):
            of = last[p] * width + k
            same &= table[of, p] == table[of, q]
        p, q = p[same], q[same]
        for band in range(most):
            if not len(p):
                break
            stay = ~agree(band, p, q) | (last[p] <= band)
            p, q = p[stay], q[stay]
        if len(p):
            yield p, q


@dataclass(frozen=True)
class Meeting:
    """What is made of the units: ``width`` words make a band."""

    where: tuple[str, ...]
    width: int

    def pairs(self, dealt: DataFrame) -> DataFrame:
        """Distinct (l, r), l < r, of the products in ``ids``, of different ``shops`` where there is such a column; those of one node too."""
        return dealt.mapInArrow(self._listed(False), "l bigint, r bigint")

    def tallied(self, dealt: DataFrame) -> DataFrame:
        """(pairs, found): the same pairs counted, and those of equal ``models``, a row or more."""
        return dealt.mapInArrow(self._listed(True), "pairs bigint, found bigint")

    def _listed(self, tally: bool):
        where, width = [*self.where, "i", "j"], self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, first in _whole(batches, where):
                ids, start = _ragged(t, "ids")
                ids = ids.to_numpy()
                code = {c: _ragged(t, c)[0].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in ("shops", "models") if c in t.column_names}
                size = np.diff(start)

                def out(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
                    if "shops" in code:
                        keep = code["shops"][x] != code["shops"][y]
                        x, y = x[keep], y[keep]
                    if tally:
                        m = code["models"]
                        return pa.RecordBatch.from_pydict({"pairs": pa.array([len(x)], pa.int64()), "found": pa.array([int(((m[x] == m[y]) & (m[x] >= 0)).sum())], pa.int64())})
                    a, b = ids[x], ids[y]
                    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["l", "r"])

                # of one node: where its first band stands, in the unit of its own block
                own = np.flatnonzero((_column(t, "side").to_numpy() == 0) & _column(t, "inner").to_numpy(zero_copy_only=False) & (_column(t, "words").value_lengths().to_numpy() == width) & (size > 1))
                later = np.repeat(start[own + 1], size[own])
                x = np.repeat(start[own], size[own]) + _counted_out(size[own])[1]
                for a, b in _ranges(later - x - 1, PAIRS):
                    e, o = _counted_out((later - x - 1)[a:b])
                    yield out(x[a:b][e], x[a:b][e] + 1 + o)
                for p, q in met(t, first, width):
                    many = size[p] * size[q]
                    for a, b in _ranges(many, PAIRS):
                        e, o = _counted_out(many[a:b])
                        x, y = p[a:b][e], q[a:b][e]
                        yield out(start[x] + o // size[y], start[y] + o % size[y])

        return run
