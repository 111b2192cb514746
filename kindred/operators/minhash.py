"""MinHash signatures of sparse representations, and their bands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.hashing import Bands

CELLS = 2_000_000  # hashes of bits in hand


def least_hashes(idx: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """For each row, whose bits are ``idx`` from ``first`` on (with the end), the smallest (b * bit + a) mod p of every hash."""
    out = np.empty((len(first) - 1, len(a)), np.int64)
    step = max(1, CELLS // max(1, len(a)))
    at = 0
    while at < len(out):
        end = max(at + 1, int(np.searchsorted(first, first[at] + step, "right")) - 1)
        bits = idx[first[at] : first[end]]
        out[at:end] = np.minimum.reduceat((bits[:, None] * b + a) % p, first[at:end] - first[at])
        at = end
    return out


def sign(rows: DataFrame, shape: Bands, coefficients: list[tuple[int, int]], key: str = "product_id") -> DataFrame:
    """(key, signature) of rows (key, idx), idx being an array of at least one bit.

    The hashes run over whole batches; nothing the size of bits times hashes is
    ever shuffled, and the hash family travels as data.
    """
    a, b = (np.array([c[i] for c in coefficients[: shape.s]], np.int64) for i in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held = part.column(1)
                first = np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy())])
                made = least_hashes(held.flatten().to_numpy(), first, a, b, shape.p)
                ends = pa.array(np.arange(len(made) + 1) * shape.s, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(made.ravel()))], [key, "signature"])

    return rows.select(key, "idx").mapInArrow(run, f"{key} bigint, signature array<bigint>")


def word_width(shape: Bands) -> tuple[int, int]:
    """How many hashes, as digits to the base p, one whole number of 63 bits holds, and how many such words a band takes."""
    digits = 1
    while shape.p ** (digits + 1) < 2**63:
        digits += 1
    return digits, max(1, -(-max(shape.sizes(), default=1) // digits))


def band_words(rows: DataFrame, shape: Bands, coefficients: list[tuple[int, int]], key: str = "product_id") -> DataFrame:
    """(key, words): the bands of ``sign`` as words, as many for each band; two bands are equal just where their words are."""
    digits, width = word_width(shape)
    a, b = (np.array([c[i] for c in coefficients[: shape.s]], np.int64) for i in (0, 1))
    ends = np.concatenate([[0], np.cumsum(shape.sizes())]).astype(int).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held = part.column(1)
                first = np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy())])
                made = least_hashes(held.flatten().to_numpy(), first, a, b, shape.p)
                words = np.zeros((len(made), shape.b * width), np.int64)
                for band in range(shape.b):
                    for n, c in enumerate(range(ends[band], ends[band + 1])):
                        word = words[:, band * width + n // digits]
                        word *= shape.p
                        word += made[:, c]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * shape.b * width, pa.int32()), pa.array(words.ravel()))], [key, "words"])

    return rows.select(key, "idx").mapInArrow(run, f"{key} bigint, words array<bigint>")


def bit_sets(bits: DataFrame) -> DataFrame:
    """(product_id, idx): each product's bits as a sorted array; a product without bits has no row, and so no candidates."""
    return bits.groupBy("product_id").agg(F.sort_array(F.collect_list("idx")).alias("idx"))


def signatures(bits: DataFrame, shape: Bands, coefficients: list[tuple[int, int]]) -> DataFrame:
    """(product_id, signature): for each hash (a, b) the smallest (b * idx + a) mod p over a product's bits."""
    return sign(bit_sets(bits), shape, coefficients)


def bands(signed: DataFrame, shape: Bands, key: str = "product_id") -> DataFrame:
    """(product_id, band, key): the signature cut into b parts of as even a size as can be, the first of which hold one more; a key is an array, exact."""
    if not shape.b:
        return signed.select(key, F.lit(0).alias("band"), F.col("signature").alias("key")).limit(0)
    least, more = divmod(shape.s, shape.b)
    start = lambda i: i * least + F.least(i, F.lit(more)) + 1
    size = lambda i: least + F.when(i < more, 1).otherwise(0)
    parts = F.transform(F.sequence(F.lit(0), F.lit(shape.b - 1)), lambda i: F.slice("signature", start(i), size(i)))
    return signed.select(key, F.posexplode(parts).alias("band", "key"))
