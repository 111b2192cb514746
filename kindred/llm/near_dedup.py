"""Near-duplicates by HyperMinHash.

A text's set is its distinct 5-word shingles, as 64-bit hashes. The leading
bits of a hash name a bucket; of the smallest remainder in each bucket a
register keeps the count of leading zeros and ten bits of mantissa. Bands of
five compressed registers (empty ones borrow along a fixed random order)
propose candidates; the share of equal registers, corrected for registers that
agree by chance, estimates the Jaccard similarity, and what is not surely below
the threshold is confirmed on the full sets. Estimates are surer than a coin's
where registers cover most of a small set, and the margin takes that in.

No pair is lost to a large bucket, and no bucket is expanded into its pairs:

1. Equal sets are one class from the start.
2. Each class is checked against a few hubs: the first class that it shares a
   bucket with, in each of several orders. What is confirmed is joined into
   components, and a second round with other orders does the same for classes
   whose buckets still hold several components.
3. Only buckets that still hold several components are looked at again. Their
   members are dealt in blocks. A set with no more members than it has
   registers travels whole, so a task settles such pairs itself; of larger sets
   the registers travel and give estimates. What is settled is joined inside
   the task, and only pairs that join different components come out to be
   confirmed: fewer than the block has members, but for pairs of larger sets
   that lie within the estimate's margin around the threshold.

With 51 bands of 5 registers a pair at the threshold of 0.75 is missed with
odds of one in a million; the estimate's margin is 4.5 standard deviations.
Class keys are 64-bit hashes of whole sets.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.store import arrow_rows, col, discard, fresh, lookup, slices, staged

ROWS, BANDS = 5, 51
BAND_BITS = 8  # 256 buckets for the bands
FINE_BITS = 10  # 1024 for the estimate
MANTISSA = 10
U = np.uint64
_ODD = np.random.default_rng(20).integers(0, 1 << 63, 24, dtype=U) << U(1) | U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.lru_cache(maxsize=1)
def _powers() -> list[np.ndarray]:
    return [np.ones(1, U)]


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd constant, modulo 2**64."""
    held = _powers()
    if len(held[0]) < n:
        size = 1 << max(12, n.bit_length())
        held[0] = np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, _ODD[10], U)]), dtype=U)
    return held[0]


_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, A-Z lower-cased, one after the other, and where each text's words begin (with the end)."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes.lower changes A-Z only
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    word = ~_BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros(0, U), np.zeros(len(texts) + 1, np.int64)
    size = last - first
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    value = (data[word].astype(U) + U(1)) * powers(int(size.max()))[at]
    hashes = mix(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(U) * _ODD[11])
    return hashes, np.concatenate([[0], np.searchsorted(first, ends)])


def shingle_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; of the whole sequence where there are fewer words; none without words."""
    words, start = words_of(texts)
    n = max(0, len(words) - width + 1)
    rolling = np.zeros(n, U)
    for i in range(width):
        rolling += words[i : i + n] * _ODD[i]
    rolling = mix(rolling)
    out = []
    for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolling[a : b - width + 1]))
        elif b > a:
            out.append(mix((words[a:b] * _ODD[: b - a]).sum(keepdims=True) + np.full(1, b - a, U) * _ODD[12]))
        else:
            out.append(np.zeros(0, U))
    return out


def registers(s: np.ndarray, bits: int) -> np.ndarray:
    """HyperMinHash of a sorted set: 0 for an empty bucket, else (leading zeros + 1) and mantissa bits in 16 bits."""
    out = np.zeros(1 << bits, np.uint16)
    if len(s):
        bucket = (s >> U(64 - bits)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))  # the set is sorted, so this is the minimum
        rest = (s[first] << U(bits)) | U(1 << (bits - 1))
        zeros = 53 - np.frexp((rest >> U(11)).astype(float))[1]
        mantissa = (rest << (zeros + 1).astype(U)) >> U(64 - MANTISSA)
        out[bucket[first]] = ((zeros + 1).astype(U) << U(MANTISSA)) | mantissa
    return out


_ORDER = np.random.default_rng(21).permuted(np.tile(np.arange(1 << BAND_BITS), (1 << BAND_BITS, 1)), axis=1)


def band_keys(s: np.ndarray) -> np.ndarray:
    """A key for each band of compressed registers; an empty register borrows from the first filled one in its own random order."""
    r = registers(s, BAND_BITS)
    empty = np.flatnonzero(r == 0)
    if len(empty):
        filled = r != 0
        r[empty] = r[_ORDER[empty, np.argmax(filled[_ORDER[empty]], axis=1)]]
    r = r[: ROWS * BANDS].astype(U).reshape(BANDS, ROWS)
    return mix((r * _ODD[:ROWS]).sum(1, dtype=U) + np.arange(BANDS, dtype=U) * _ODD[13])


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Odds that registers of different minima agree, for sets of sizes n and m."""
    return n * m / (n + m) ** 2.0 * 0.72 / (1 << MANTISSA)


def estimate(one: np.ndarray, many: np.ndarray, n: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard similarity of one set with many, and the registers each rests on."""
    filled = np.maximum(1, ((many != 0) | (one != 0)).sum(1))
    equal = ((many == one) & (one != 0)).sum(1) / filled
    by_chance = chance(float(n), sizes.astype(float))
    return (equal - by_chance) / (1 - by_chance), filled


def margin(sizes: np.ndarray, filled: np.ndarray, threshold: float, deviations: float) -> np.ndarray:
    """How far below the threshold an estimate may lie, for sets whose sizes add up to ``sizes``.

    At the threshold their union has sizes / (1 + threshold) members. The filled
    registers are as many members of it, drawn without repeats, so the estimate
    is the surer the more of the union they cover. More filled registers than
    that rule the pair out.
    """
    union = sizes / (1 + threshold)
    spread = np.sqrt(threshold * (1 - threshold) / filled * np.maximum(0, 1 - filled / union))
    return np.where(filled > union + 1e-9, -np.inf, deviations * spread + 2 / filled)


def overlaps(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """How many members of a sorted set are in each of some others, none of them empty."""
    if not many:
        return np.zeros(0, np.int64)
    flat = np.concatenate(many)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    sizes = np.array([len(m) for m in many])
    return np.add.reduceat((one[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)


def _list(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, U)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def class_key(s: np.ndarray) -> int:
    whole = (s * _ODD[14] + (s >> U(32)) * _ODD[15]).sum(keepdims=True, dtype=U) + np.full(1, len(s), U) * _ODD[16]
    return int(mix(whole).view(np.int64)[0])


def signatures(df: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """(id, t, n, c, bands): text hash, set size, class of equal sets (null: no words) and band keys of every row."""
    kind = df.schema[key].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 2):
                sets = shingle_sets(texts, width)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([class_key(s) if len(s) else None for s in sets], pa.int64()),
                        _list([band_keys(s) if len(s) else s for s in sets]),
                    ],
                    ["id", "t", "n", "c", "bands"],
                )

    rows = df.select(col(key).alias("id"), F.xxhash64(col(text)).alias("t"), col(text).cast("string").alias("text"))
    return rows.mapInArrow(sign, f"id {kind}, t bigint, n bigint, c bigint, bands array<bigint>")


def full_sets(rows: DataFrame, width: int) -> DataFrame:
    """(c, n, shingles, fine) of rows (text): the whole set, and the fine registers of one with more members than those."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, 0):
                sets = [s for s in shingle_sets(texts, width) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([class_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _list(sets), pa.array([registers(s, FINE_BITS).tobytes() if len(s) > 1 << FINE_BITS else None for s in sets], pa.binary())],
                    ["c", "n", "shingles", "fine"],
                )

    return rows.mapInArrow(make, "c bigint, n bigint, shingles array<bigint>, fine binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on full sets."""
    small = sets.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    other = sets.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    # sizes alone rule out many pairs, before any set is sent
    sized = pairs.join(small.select("a", "na"), "a").join(other.select("b", "nb"), "b").filter("100 * least(na, nb) >= %d * greatest(na, nb)" % percent)
    both = sized.select("a", "b").join(small, "a").join(other, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * shared >= percent * (F.col("na") + F.col("nb") - shared)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(c, comp): the smallest class reachable over edges (a, b), for every class that has one.

    Large-star and small-star steps in turn: each round joins neighbours to the
    smallest of them, so the depth falls by about half, until nothing changes.
    """
    edges = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        after = staged(small, "edges")
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = after
        if mark == before:
            break
        before = mark
    return edges.select(F.col("u").alias("c"), F.col("v").alias("comp"))


def stars(shared: DataFrame, orders: np.ndarray) -> DataFrame:
    """Distinct pairs (a, b) of each class with its hub in each order: the first class in any bucket that the class is in.

    An order is that of the class keys with some bits flipped, so it is a plain
    minimum of whole numbers, and a class gives one pair an order at most.
    """
    names = [f"m{i}" for i in range(len(orders))]
    flipped = [F.col("c").bitwiseXOR(F.lit(int(o))) for o in orders.view(np.int64)]
    hubs = shared.groupBy("key").agg(*[F.min(x).alias(m) for x, m in zip(flipped, names, strict=True)])
    own = shared.select("key", "c").join(hubs, "key").groupBy("c").agg(*[F.min(m).alias(m) for m in names])
    back = [F.col(m).bitwiseXOR(F.lit(int(o))) for m, o in zip(names, orders.view(np.int64), strict=True)]
    pairs = own.select("c", F.explode(F.array_distinct(F.array(*back))).alias("hub")).filter("hub <> c")
    return pairs.select(F.least("c", "hub").alias("a"), F.greatest("c", "hub").alias("b")).distinct()


_ORDERS = np.arange(6, dtype=U) << U(61) ^ np.random.default_rng(22).integers(0, 1 << 61, (2, 6), dtype=U)


def open_buckets(shared: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``shared`` with each class's component so far, and the buckets (key, size) that hold several."""
    state = shared.join(comp, "c", "left").select("key", "band", "c", F.coalesce("comp", "c").alias("comp"))
    several = state.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi").select("key", "size")
    return state, several


def residual(members: DataFrame, percent: int, block_rows: int, deviations: float, trust: bool = True) -> DataFrame:
    """Pairs (a, b, settled) of different components that share a bucket and may be similar enough.

    ``members``: (key, band, c, comp, n, bands, shingles, fine, size), size being
    the bucket's; ``shingles`` or ``fine`` is null. A bucket is cut into blocks,
    and each pair of blocks is a group. Of the bands that two classes share,
    only the first reports them. With ``trust`` an estimate that lies above the
    threshold by its margin settles a pair like a count on whole sets; the
    caller has to call again without it if such a pair is not confirmed.
    """
    threshold = percent / 100
    blocks = F.ceil(F.col("size") / block_rows).cast("int")
    own = F.pmod(F.xxhash64("c"), blocks).cast("int")
    dealt = members.withColumn("x", own).withColumn("y", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("low", F.least("x", "y")).withColumn("high", F.greatest("x", "y"))
    dealt = dealt.select("key", "low", "high", "band", "x", "c", "comp", "n", "bands", "shingles", "fine")
    dealt = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def solve(rows: list[pa.Table]) -> list[tuple[int, int, bool]]:
        t = pa.concat_tables(rows)
        if t.num_rows < 2:
            return []
        c, n, x = (t[k].to_numpy() for k in ("c", "n", "x"))
        part = np.unique(t["comp"].to_numpy(), return_inverse=True)[1]  # the components, joined as pairs are settled
        band, split = t["band"][0].as_py(), t["low"][0] != t["high"][0]
        bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(len(c), -1)
        held = t["shingles"].combine_chunks()
        length = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        sets = np.split(held.flatten().to_numpy().view(U), np.cumsum(length)[:-1])
        fine = np.stack([registers(s, FINE_BITS) if f is None else np.frombuffer(f, np.uint16) for s, f in zip(sets, t["fine"].to_pylist(), strict=True)])
        found, unsure = [], []
        for i in range(len(c) - 1):
            j = np.flatnonzero(part[i + 1 :] != part[i]) + i + 1
            if split:
                j = j[x[j] != x[i]]
            j = j[threshold * np.maximum(n[j], n[i]) <= np.minimum(n[j], n[i])]
            if len(j):
                j = j[np.argmax(bands[j] == bands[i], axis=1) == band]
            for at in range(0, len(j), 512):
                k = j[at : at + 512]
                k = k[part[k] != part[i]]
                if not len(k):
                    continue
                value, rests_on = estimate(fine[i], fine[k], n[i], n[k])
                room = margin(n[i] + n[k], rests_on, threshold, deviations)
                near = value >= threshold - room
                k, settled = k[near], (value >= threshold + room)[near] & trust
                whole = (length[i] > 0) & (length[k] > 0)
                shared = overlaps(sets[i], [sets[o] for o in k[whole]])
                settled[whole] = 100 * shared >= percent * (n[i] + n[k[whole]] - shared)
                unsure += [(i, o) for o in k[~whole & ~settled]]
                for o in k[settled]:
                    if part[o] != part[i]:
                        part[part == part[o]] = part[i]
                        found.append((min(c[i], c[o]), max(c[i], c[o]), True))
        return found + [(min(c[i], c[o]), max(c[i], c[o]), False) for i, o in unsure if part[i] != part[o]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def out(found: list) -> pa.RecordBatch:
            ends = [pa.array([int(f[i]) for f in found], pa.int64()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*ends, pa.array([f[2] for f in found], pa.bool_())], ["a", "b", "settled"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)
            if not len(keys):
                continue
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if at is not None and tuple(keys[a]) != at:
                    yield out(solve(held))
                    held = []
                at = tuple(keys[a])
                held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
        if held:
            yield out(solve(held))

    return dealt.mapInArrow(run, "a bigint, b bigint, settled boolean")


def near_duplicates(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    *,
    width: int = 5,
    percent: int = 75,
    block_rows: int = 1024,
    deviations: float = 4.5,
) -> DataFrame:
    """One row per input row: ``key``, ``n_shingles``, ``component_id``, ``kept``, ``class_id``, ``text_hash``.

    Rows are linked when 100 * intersection >= percent * union of their
    shingle sets; ``component_id`` is the smallest key that can be reached,
    ``kept`` says that it is the row's own, ``class_id`` names equal sets (null
    without words), ``text_hash`` is xxhash64 of the text. A null, empty or blank text has no shingles and stands
    alone. A row with a null key stands in its class but lends no key: where
    no row of its component has one, ``component_id`` is null and ``kept`` is
    true. Repeated rows share their class and all carry the same ``kept``.
    No rows give no rows. Other columns are not read. Equal sets are one class,
    so ties and copies cost a row each; very long texts are hashed whole, and
    their sets are compared whole.
    """
    with arrow_rows(df.sparkSession):
        sig = staged(signatures(df, text, key, width), "signatures")
    classes = sig.filter("c is not null").groupBy("c").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    classes = staged(classes, "classes")
    banded = classes.select("c", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("key").agg(F.min("c").alias("hub"), F.max("c").alias("top")).filter("hub <> top").select("key", "hub")
    shared = staged(banded.join(buckets, "key"), "shared")
    needed = shared.select("c").distinct()

    ids = classes.join(needed, "c", "left_semi").select(F.col("rep").alias("id"), "c")
    picked = df.select(col(key).alias("id"), col(text).cast("string").alias("text")).join(ids.select("id").distinct(), "id", "left_semi")
    nameless = ids.filter("id is null").limit(1).count()  # classes whose rows have no key
    if nameless:
        picked = picked.unionByName(df.filter(col(key).isNull()).select(col(key).alias("id"), col(text).cast("string").alias("text")))
    made = full_sets(picked.select("text"), width).join(needed, "c", "left_semi")
    with arrow_rows(df.sparkSession):
        sets = staged(made.groupBy("c").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"), F.first("fine").alias("fine")), "sets")

    first = staged(confirmed(stars(shared, _ORDERS[0]), sets, percent), "links")
    comp = staged(components(first), "components")
    state, open_ = open_buckets(shared, comp)
    again = stars(state.join(open_, "key", "left_semi"), _ORDERS[1])
    of_a, of_b = (comp.select(F.col("c").alias(x), F.col("comp").alias(f"comp_{x}")) for x in ("a", "b"))
    again = again.join(of_a, "a", "left").join(of_b, "b", "left").filter(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b")
    second = confirmed(again, sets, percent)
    # components stand for their links
    begun, comp = comp, staged(components(comp.select(F.col("c").alias("a"), F.col("comp").alias("b")).unionByName(second)), "components")
    discard(begun)
    state, open_ = open_buckets(shared, comp)
    sent = sets.select("c", "n", F.when(F.col("fine").isNull(), F.col("shingles")).alias("shingles"), "fine")
    members = state.join(open_, "key").join(classes.select("c", "bands"), "c").join(sent, "c")
    more = staged(residual(members, percent, block_rows, deviations).distinct(), "candidates")
    links2 = staged(confirmed(more, sets, percent), "links")
    if more.filter("settled").join(links2, ["a", "b"], "left_anti").limit(1).count():  # an estimate was wrong by more than its margin
        more = staged(residual(members, percent, block_rows, deviations, trust=False).distinct(), "candidates")
        links2 = staged(confirmed(more, sets, percent), "links")
    every = comp.select(F.col("c").alias("a"), F.col("comp").alias("b")).unionByName(links2)
    whole = components(every)

    named = staged(classes.select("c", "rep").join(whole, "c", "left").withColumn("comp", F.coalesce("comp", "c")), "named")
    for done in (shared, sets, first, comp, more, links2, classes):
        discard(done)
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of = staged(lookup(named, least, "comp").select("c", "component_id"), "of")
    discard(named)
    some, none = sig.filter("c is not null").select("id", "t", "n", "c"), sig.filter("c is null")
    met = lookup(some, of, "c").select("id", "t", "n", "component_id", "c")
    alone = none.select("id", "t", "n", F.col("id").alias("component_id"), "c")
    return met.unionByName(alone).select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        "component_id",
        (F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"),
        F.col("c").alias("class_id"),
        F.col("t").alias("text_hash"),
    )


def drop_near(df: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` with one document of each component, all columns as they were.

    Rows without words all stay, and so do those with a null key. Rows that
    agree in key and text share their lot; a component keeps all rows that have
    its smallest key.
    """
    marks = near_duplicates(df, text, key, **options)
    id_, hash_ = fresh(df, "k_id"), fresh(df, "k_hash")
    away = marks.filter(~F.col("kept") & col(key).isNotNull()).select(col(key).alias(id_), F.col("text_hash").alias(hash_)).distinct()
    return df.join(away, (col(key) == F.col(id_)) & (F.xxhash64(col(text)) == F.col(hash_)), "left_anti")
