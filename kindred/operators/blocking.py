"""Candidate pairs: products that agree in a whole band."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.hashing import Bands, steady_coefficients
from kindred.operators import minhash, tally, vocab
from kindred.operators.brands import MISSING
from kindred.operators.meeting import Meeting, crossed, units
from kindred.operators.tables import cut


HELD = 64  # products of a node, about


@dataclass(frozen=True)
class Sets:
    """Products by their sets of words, at any threshold."""

    members: DataFrame  # (product_id, class, n), n being the products of the class, staged
    classes: DataFrame  # (class, idx, n), idx being the words, staged
    size: int  # of the vocabulary

    def hits(self, marked: DataFrame, thresholds: tuple[float, ...], coefficients=steady_coefficients) -> DataFrame:
        """(t, run, pairs, found) as ``Blocks.hits`` has them, for several thresholds at once: signatures are the same for all."""
        shapes = {t: Bands.of(self.size, t) for t in thresholds}
        return self.counts(marked, shapes, coefficients(next(iter(shapes.values())).s))

    def counts(self, marked: DataFrame, shapes: dict[float, Bands], family: list[tuple[int, int]]) -> DataFrame:
        first = marked.select("weights").first()
        n = len(first["weights"]) if first else 0
        out = marked.sparkSession.createDataFrame([(t, k) for t in shapes for k in range(n)], "t double, run int")
        shapes = {t: shape for t, shape in shapes.items() if shape.b}
        if not n or not shapes:
            return out.select("t", "run", F.lit(0).cast("bigint").alias("pairs"), F.lit(0).cast("bigint").alias("found"))
        named = cut(self.members.drop("n").join(marked.hint("merge"), "product_id"))
        sums = F.array(*[F.sum(F.col("weights")[k]) for k in range(n)]).alias("weights")

        def held(rows: DataFrame, *by: str) -> DataFrame:
            """Products of a class are counted, not listed."""
            some = rows.groupBy("class", *by).agg(sums).filter(F.exists("weights", lambda w: w > 0))
            return cut(some.join(self.classes.select("class", "idx").hint("merge"), "class").withColumnRenamed("class", "node"))

        pairs = tally.pairs(held(named), shapes, family, n)
        found = tally.found(held(named.filter("model_id is not null"), "model_id"), shapes, family, n)
        for made, name in ((pairs, "pairs"), (found, "found")):
            out = out.join(made.groupBy("t", "run").agg(F.sum(name).alias(name)), ["t", "run"], "left")
        return out.select("t", "run", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pairs", "found")])


@dataclass(frozen=True)
class Blocks:
    """Products by their sets of words.

    Products with equal sets agree in every band, so sets (``class``, named by
    their smallest product) meet each other in place of products, as nodes of
    about ``HELD`` products. Nodes that share a bucket meet inside a task, and a
    pair of nodes counts in the first band in which it agrees: pairs come out
    once, are never collected to be made distinct, and no side of a join is
    broadcast.
    """

    members: DataFrame  # (product_id, class, n), n being the products of the class, staged
    signed: DataFrame  # (class, words), staged
    shape: Bands
    sets: Sets
    family: list[tuple[int, int]]  # (a, b) of each hash

    def _nodes(self, products: DataFrame, *by: str) -> DataFrame:
        """Products in nodes of one class (and of one ``by``), with what pairs are made of."""
        named = self.members.join(products.hint("merge"), "product_id")
        part = F.pmod(F.xxhash64("product_id"), F.ceil(F.col("n") / HELD)).alias("part")
        rest = [c for c in products.columns if c not in by]
        held = named.groupBy("class", *by, part).agg(F.min("product_id").alias("node"), F.collect_list(F.struct(*rest)).alias("held"))
        names = {"product_id": "ids", "shop": "shops", "model_id": "models"}
        return cut(held.select("class", "node", *by, *[F.col("held")[c].alias(names[c]) for c in rest]).join(self.signed.hint("merge"), "class").drop("class"))

    def _buckets(self, nodes: DataFrame) -> DataFrame:
        """A row for each node and band, with the words of the bands up to that."""
        _, width = minhash.word_width(self.shape)
        kept = [F.col(c) for c in nodes.columns if c != "words"]
        if not self.shape.b:
            return nodes.select(*kept, F.lit(0).alias("band"), F.lit(0).cast("bigint").alias("h"), "words").limit(0)
        rows = nodes.select(*kept, "words", F.explode(F.sequence(F.lit(0), F.lit(self.shape.b - 1))).alias("band"))
        return rows.select(*kept, "band", F.xxhash64(F.slice("words", F.col("band") * width + 1, width)).alias("h"), F.slice("words", F.lit(1), (F.col("band") + 1) * width).alias("words"))

    def _meeting(self, *on: str) -> Meeting:
        return Meeting(on, minhash.word_width(self.shape)[1])

    def candidates(self) -> DataFrame:
        """Distinct pairs (l, r), l < r, with equal keys in some band.

        How many there are is a property of the threshold: none is dropped, and
        large buckets are cut into blocks.
        """
        rows = self._buckets(self._nodes(self.members.select("product_id")))
        return self._meeting("band", "h").pairs(units(rows, ["band", "h"]))

    def hits(self, marked: DataFrame) -> DataFrame:
        """(run, pairs, found): how many candidates there are, and how many of one model, for each entry of ``weights`` in rows (product_id, model_id, weights).

        An entry is 1 for a product that takes part and 0 for another.
        """
        return self.sets.counts(marked, {0.0: self.shape}, self.family).drop("t")

    def all_hits(self, products: DataFrame) -> DataFrame:
        """(pairs, found) of all candidates, one row."""
        found = self.hits(products.select("product_id", "model_id", F.array(F.lit(1).cast("bigint")).alias("weights")))
        return found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "found")])

    def _fitting(self, products: DataFrame, *more: str) -> list[tuple[Meeting, DataFrame]]:
        """Units of the products that no veto rules out: brands are a part of the bucket, and only products without one meet others."""
        known_shop = products.filter("shop is not null").select("product_id", "brand", "shop", *more)
        nodes = self._nodes(known_shop, "brand")
        rows = self._buckets(nodes)
        made = [(self._meeting("band", "h", "brand"), units(rows, ["band", "h", "brand"]))]
        free = nodes.filter(F.col("brand") == MISSING)
        if not free.isEmpty():
            a, b = self._buckets(free), self._buckets(nodes.filter(F.col("brand") != MISSING))
            met = b.join(a.select("band", "h").distinct().hint("merge"), ["band", "h"], "left_semi").select(*a.columns)
            made.append((self._meeting("band", "h"), crossed(a, met, ["band", "h"])))
        return made

    def comparable(self, products: DataFrame) -> DataFrame:
        """The candidates that no veto rules out: of different shops, with brands that agree or are not both known."""
        return reduce(DataFrame.unionByName, [m.pairs(dealt) for m, dealt in self._fitting(products)])

    def comparable_hits(self, products: DataFrame) -> DataFrame:
        """(pairs, found): how many those are, and how many of them are of one model."""
        tallies = reduce(DataFrame.unionByName, [m.tallied(dealt) for m, dealt in self._fitting(products, "model_id")])
        return tallies.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "found")])


def sets(products: DataFrame) -> Sets:
    """Cleaned products by their words; the vocabulary is of these products alone."""
    words = cut(vocab.vocabulary(products))
    bits = cut(minhash.bit_sets(vocab.representation(products, words)))
    classes = cut(bits.groupBy("idx").agg(F.min("product_id").alias("class"), F.count(F.lit(1)).alias("n")).select("class", "idx", "n"))
    members = cut(bits.join(classes.hint("merge"), "idx").select("product_id", "class", "n"))
    return Sets(members, classes, words.count())


def blocks(products: DataFrame, t: float, coefficients=steady_coefficients) -> Blocks:
    """Cleaned products in bands at LSH threshold t.

    The size of the vocabulary is the one figure that is needed before the
    signatures can be planned. ``coefficients`` gives (a, b) for each of s hashes.
    """
    made = sets(products)
    shape = Bands.of(made.size, t)
    family = coefficients(shape.s)
    return Blocks(made.members, cut(minhash.band_words(made.classes, shape, family, "class")), shape, made, family)


def block(products: DataFrame, t: float, coefficients=steady_coefficients) -> tuple[DataFrame, Bands]:
    """Candidate pairs of cleaned products at LSH threshold t, and the shape of the signatures."""
    made = blocks(products, t, coefficients)
    return made.candidates(), made.shape
