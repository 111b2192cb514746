"""Packing token pieces into fixed-length sequences: first-fit decreasing in randomised groups.

Each document is tokenized once; its ids, closed by an end id, are cut into
pieces of at most ``capacity`` ids. Pieces are dealt at random to groups of
about ``group_rows``, and each group is packed on its own: pieces in order of
falling length go into the first bin with room, which a tournament tree over
the bins' remaining capacities finds in logarithmic time. A group is bounded
whatever the size of the corpus, whichever keys its documents have.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.store import arrow_rows, col, staged

#: The split of texts that the byte-level vocabulary was made with (its ByteLevel pre-tokenizer).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids, as ``tokenizers`` gives them for the byte-level BPE in ``path``.

    The merges run in ``tiktoken``, which takes the same vocabulary as ranks
    and is about six times as fast; texts that it refuses go to ``tokenizers``.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    special = {x["content"]: x["id"] for x in made["added_tokens"]}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte[c] for c in piece): i for piece, i in made["model"]["vocab"].items() if piece not in special}
    fast = tiktoken.Encoding("byte_bpe", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    whole = functools.cache(lambda: Tokenizer.from_file(path))

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return whole().encode(text, add_special_tokens=False).ids
        try:
            return fast.encode_ordinary(text)
        except BaseException as e:  # the regex engine of tiktoken can panic on odd texts
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return whole().encode(text, add_special_tokens=False).ids

    return encode


def cut(df: DataFrame, text: str, key: str, capacity: int, end_id: int, path: str, payload: tuple[str, ...]) -> DataFrame:
    """Pieces of every row: id, start, length, doc_tokens, and of ``ids`` and ``ids_crc32`` those in ``payload``."""
    kind = df.schema[key].dataType
    fields = {"ids": pa.list_(pa.int32()), "ids_crc32": pa.int64()}
    sql = {"ids": "array<int>", "ids_crc32": "bigint"}

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            at = 0
            while at < batch.num_rows:
                rows, start, length, total = [], [], [], []
                out: dict[str, list] = {p: [] for p in payload}
                held = 0
                while at < batch.num_rows and held < 200_000:  # ids in hand
                    ids = np.array([*encode(texts[at].as_py() or ""), end_id], dtype="<u4")
                    for i in range(0, len(ids), capacity):
                        part = ids[i : i + capacity]
                        rows.append(at), start.append(i), length.append(len(part)), total.append(len(ids))
                        if "ids" in out:
                            out["ids"].append(part.astype(np.int32))
                        if "ids_crc32" in out:
                            out["ids_crc32"].append(zlib.crc32(part.tobytes()))
                    held += len(ids)
                    at += 1
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(rows)), *(pa.array(x, pa.int64()) for x in (start, length, total)), *(pa.array(out[p], fields[p]) for p in payload)],
                    ["id", "start", "length", "doc_tokens", *payload],
                )

    extra = "".join(f", {p} {sql[p]}" for p in payload)
    return df.select(col(key).alias("id"), col(text).cast("string").alias("text")).mapInArrow(
        pieces, f"id {kind.simpleString()}, start bigint, length bigint, doc_tokens bigint{extra}"
    )


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; ``lengths`` must fall. At most as many bins as lengths.

    The tree's leaves are the bins' free space and each inner node holds the
    larger of its children, so going down to the left while there is room finds
    the first bin that fits.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    free = [capacity] * (2 * leaves)
    where, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    for i, size in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        where[i], offset[i] = node - leaves, capacity - free[node]
        free[node] -= size
        while node > 1:
            node >>= 1
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
    return where, offset


def assign(pieces: DataFrame, capacity: int, group_rows: int) -> DataFrame:
    """``pieces`` (staged: id, start, length, doc_tokens, piece, draw, ...) with ``sequence_id`` and ``offset``.

    A group's bins get ids from ``group << 32`` on. Rows are dealt by a draw
    that is written down before, so a task that runs again sees the same group.
    Only lengths go to the packing tasks: ids wait in their table and meet their
    places by the piece's number.
    """
    rows = pieces.count()
    groups = max(1, round(rows / group_rows))
    width = (1 << 53) // groups + 1
    heavy = "ids" in pieces.columns
    thin = pieces.drop("ids") if heavy else pieces.drop("piece")
    dealt = thin.withColumn("pack_group", F.floor(F.col("draw") / width).cast("bigint")).drop("draw")
    schema = T.StructType([*dealt.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack(table: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_tokens", "ascending"), ("start", "ascending"), ("id", "ascending")]
        table = table.sort_by(order)
        where, offset = first_fit_decreasing(table["length"].to_numpy(), capacity)
        base = table["pack_group"][0].as_py() << 32
        return table.append_column("sequence_id", pa.array(where + base)).append_column("offset", pa.array(offset))

    packed = dealt.groupBy("pack_group").applyInArrow(pack, schema).drop("pack_group")
    if not heavy:
        return packed
    return pieces.drop("draw").join(packed.select("piece", "sequence_id", "offset"), "piece").drop("piece")


def pack_documents(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    *,
    capacity: int = 2048,
    end_id: int = 1,
    path: str | None = None,
    group_rows: int = 2048,
    seed: int = 17,
    payload: tuple[str, ...] = ("ids",),
) -> DataFrame:
    """Pack every row's token ids into sequences of at most ``capacity`` ids.

    One row per piece: ``key``, ``start`` (ids of its document before it),
    ``length``, ``doc_tokens``, the columns of ``payload`` (``ids``: the piece
    itself; ``ids_crc32``: of its ids as little-endian 32-bit words),
    ``sequence_id`` and ``offset`` (from 0, without gaps).

    Null and empty texts are documents of the end id alone. Null keys and
    repeated rows are packed like others, equal lengths in order of document
    length, start and key. A very long text is tokenized whole and cut. No rows
    give no rows. Other columns are not read.
    """
    pieces = cut(df, text, key, capacity, end_id, path or vocabulary_file(), payload)
    # the draw: 53 bits from a seeded generator, as a whole number so that groups are even
    pieces = pieces.withColumn("draw", (F.rand(seed) * float(1 << 53)).cast("bigint")).withColumn("piece", F.monotonically_increasing_id())
    with arrow_rows(df.sparkSession):
        pieces = staged(pieces, "pieces")
    packed = assign(pieces, capacity, group_rows)
    return packed.withColumnRenamed("id", key)


def sequences(packed: DataFrame, key: str = "doc_id", capacity: int = 2048) -> DataFrame:
    """One row per sequence: ``sequence_id``, ``ids`` in order, ``tokens``, ``padded_length``, ``documents``.

    A sequence is padded to ``capacity``, except where its length is a power of
    two: that stays as it is.

    A sequence has at most ``capacity`` pieces, so the grouping is bounded.
    """
    part = F.sort_array(F.collect_list(F.struct("offset", "ids", col(key).alias("doc"))))
    total = F.sum("length")
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(part, lambda p: p["ids"])).alias("ids"),
        total.alias("tokens"),
        F.when(total.bitwiseAND(total - 1) == 0, total).otherwise(capacity).alias("padded_length"),
        F.transform(part, lambda p: p["doc"]).alias("documents"),
    )
