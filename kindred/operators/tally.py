"""Counts of candidate pairs at several thresholds at once: sets of words meet by blocks, as bits of which each stands for a pair, and no pair is listed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.hashing import Bands
from kindred.operators.meeting import _column, _counted_out, _ragged, _ranges, _whole, ordered, units
from kindred.operators.minhash import least_hashes
from kindred.operators.tables import cut

BLOCK = 1 << 15  # sets of a block, about; a unit holds the sets of two
LEAST = 8  # blocks at least, so that there are units enough for all cores
TASKS = 2048  # units share tasks beyond that many
ROWS = 1 << 13  # sets whose bits are in hand
STEP = 256  # of those, how many at a time
FEW = 32  # members of a bucket that are marked one by one
CELLS = 1 << 24  # hashes of pairs in hand

Family = list[tuple[int, int]]


def _signer(shape: Bands, family: Family):
    """Signatures of sets of words, given as bits and where each row's begin."""
    a, b = (np.array([c[i] for c in family[: shape.s]], np.int64) for i in (0, 1))
    kind = np.int32 if shape.p < 2**31 else np.int64
    return lambda bits, first: least_hashes(bits, first, a, b, shape.p).astype(kind)


def _starts(shape: Bands) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(shape.sizes())]).astype(int)


def _keys(signed: np.ndarray, p: int) -> np.ndarray:
    """A whole number for each row of a band, equal just where rows are."""
    key, n = signed[:, 0].astype(np.int64), p
    for c in range(1, signed.shape[1]):
        if n >= 2**62 // p:
            names, key = np.unique(key, return_inverse=True)
            n = len(names)
        key, n = key * p + signed[:, c], n * p
    return key


class Agreeing:
    """For rows of one block the columns of another that agree with them in some band, as bits."""

    def __init__(self, rows: list[np.ndarray], columns: list[np.ndarray]):
        """Both by band, as keys."""
        self.n, self.wide, self.bands = len(columns[0]), -(-len(columns[0]) // 64) * 8, []
        for x, y in zip(rows, columns):
            names, at = np.unique(y, return_inverse=True)
            found = np.minimum(np.searchsorted(names, x), len(names) - 1)
            size = np.bincount(at, minlength=len(names))
            order = np.argsort(at, kind="stable").astype(np.int32)
            met = np.where(names[found] == x, found, -1).astype(np.int32)
            self.bands.append((met, size, np.cumsum(size) - size, order))

    def bits(self, i: int, j: int) -> np.ndarray:
        """Rows i to j, 64 columns to a word."""
        out = np.zeros((j - i, self.wide), np.uint8)
        flat, words, buffer = out.reshape(-1), out.view(np.uint64), np.empty((STEP, self.wide // 8), np.uint64)
        for met, size, start, order in self.bands:
            met = met[i:j]
            many = np.where(met >= 0, size[met], 0)
            near = np.flatnonzero((many > 0) & (many <= FEW))
            if len(near):
                e, o = _counted_out(many[near])
                c = order[start[met[near]][e] + o]
                np.bitwise_or.at(flat, near[e] * self.wide + (c >> 3), np.left_shift(1, c & 7).astype(np.uint8))
            rows = np.flatnonzero(many > FEW)
            if not len(rows):
                continue
            names, which = np.unique(met[rows], return_inverse=True)
            table = np.zeros((len(names), self.wide), np.uint8)
            e, o = _counted_out(size[names])
            c = order[start[names][e] + o]
            np.bitwise_or.at(table.reshape(-1), e * self.wide + (c >> 3), np.left_shift(1, c & 7).astype(np.uint8))
            table = table.view(np.uint64)
            for a in range(0, len(rows), STEP):
                part, of = rows[a : a + STEP], which[a : a + STEP]
                held = np.take(table, of, axis=0, out=buffer[: len(of)], mode="clip")
                if part[-1] - part[0] + 1 == len(part):
                    words[part[0] : part[-1] + 1] |= held
                else:
                    words[part] |= held
        return words

    def weighed(self, rows: np.ndarray, columns: np.ndarray) -> list[int]:
        """For each entry of the weights of rows and columns the products of those that agree, summed up."""
        sums, planes = [0] * rows.shape[1], []
        for k in range(rows.shape[1]):
            for bit in range(int(columns[:, k].max(initial=0)).bit_length()):
                plane = np.zeros(self.wide, np.uint8)
                plane[: -(-self.n // 8)] = np.packbits((columns[:, k] >> bit & 1).astype(np.uint8), bitorder="little")
                planes.append((k, bit, plane.view(np.uint64)))
        for i in range(0, len(rows), ROWS):
            made = self.bits(i, min(i + ROWS, len(rows)))
            for k, bit, plane in planes:
                for a in range(0, len(made), STEP):
                    met = np.bitwise_count(made[a : a + STEP] & plane).sum(1, dtype=np.int64)
                    sums[k] += int((met * rows[i + a : i + a + len(met), k]).sum()) << bit
        return sums


def _counted(shapes: dict[float, Bands], sign, n: int):
    """(t, run, pairs) of each unit of rows (unit, second, idx, weights), the sets of the first block first; a unit of one block has no second."""

    def unit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        second = _column(t, "second").to_numpy(zero_copy_only=False)
        weights = _ragged(t, "weights")[0].to_numpy().reshape(-1, n)
        bits, first = _ragged(t, "idx")
        signed = sign(bits.to_numpy(), first)
        mine, one = ~second, bool(_column(t, "one")[0].as_py())
        theirs = mine if one else second
        out = []
        for at, shape in shapes.items():
            sums = [0] * n
            if mine.any() and theirs.any():
                ends = _starts(shape)
                keys = [_keys(signed[:, ends[k] : ends[k + 1]], shape.p) for k in range(shape.b)]
                sums = Agreeing([k[mine] for k in keys], [k[theirs] for k in keys]).weighed(weights[mine], weights[theirs])
                if one:  # both ways, and each set with itself, of which the pairs inside it count
                    sums = [(s - int((w * w).sum())) // 2 + int((w * (w - 1) // 2).sum()) for s, w in zip(sums, weights.T)]
            out += [(at, k, s) for k, s in enumerate(sums)]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.float64(), pa.int32(), pa.int64()))], ["t", "run", "pairs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            named = batch.column("unit").to_numpy()
            ends = [*(np.flatnonzero(np.diff(named)) + 1).tolist(), len(named)]
            for i, j in zip([0, *ends], ends):
                if held and named[i] != name:
                    yield unit(held)
                    held = []
                name = named[i]
                held.append(batch.slice(i, j - i))
        if held:
            yield unit(held)

    return run


def pairs(sets: DataFrame, shapes: dict[float, Bands], family: Family, n: int) -> DataFrame:
    """(t, run, pairs), a row or more for each: of rows (node, idx, weights) with n weights, products of the weights of two that agree in a band, and the pairs inside each."""
    k = max(LEAST, -(-sets.count() // BLOCK))
    own = F.pmod(F.xxhash64("node"), F.lit(k)).cast("int")
    aim = lambda x: F.struct((F.least(F.col("own"), x) * k + F.greatest(F.col("own"), x)).alias("unit"), (F.col("own") > x).alias("second"), (F.col("own") == x).alias("one"))
    rows = sets.withColumn("own", own).withColumn("aim", F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), aim)))
    dealt = rows.select("aim.*", "idx", "weights").repartition(min(k * (k + 1) // 2, TASKS), "unit").sortWithinPartitions("unit")
    shape = next(iter(shapes.values()))
    return dealt.mapInArrow(_counted(shapes, _signer(shape, family), n), "t double, run int, pairs bigint")


def found(sets: DataFrame, shapes: dict[float, Bands], family: Family, n: int) -> DataFrame:
    """The same of rows (model_id, node, idx, weights) that agree in their model, looked at pair by pair."""
    shape = next(iter(shapes.values()))
    sign = _signer(shape, family)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {(t, k): 0 for t in shapes for k in range(n)}
        for t, first in _whole(batches, ["model_id", "i", "j"]):
            weights = _ragged(t, "weights")[0].to_numpy().reshape(-1, n)
            bits, start = _ragged(t, "idx")
            bits = bits.to_numpy()
            own = (_column(t, "side").to_numpy() == 0) & _column(t, "inner").to_numpy(zero_copy_only=False)
            for k in range(n):
                inside = int((weights[own, k] * (weights[own, k] - 1) // 2).sum())
                for at in shapes:
                    sums[at, k] += inside
            for p, q in ordered(t, first, max(1, CELLS // shape.s)):
                rows, at = np.unique(np.concatenate([p, q]), return_inverse=True)
                size = np.diff(start)[rows]
                e, o = _counted_out(size)
                signed = sign(bits[start[rows][e] + o], np.concatenate([[0], np.cumsum(size)]))
                same = signed[at[: len(p)]] == signed[at[len(p) :]]
                for t_, of in shapes.items():
                    agree = np.logical_and.reduceat(same, _starts(of)[:-1], axis=1).any(1)
                    for k in range(n):
                        sums[t_, k] += int((weights[p[agree], k] * weights[q[agree], k]).sum())
        rows = [(t, k, s) for (t, k), s in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.float64(), pa.int32(), pa.int64()))], ["t", "run", "found"])

    return units(cut(sets), ["model_id"]).mapInArrow(run, "t double, run int, found bigint")
