"""Similarities of strings, token sets and titles, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions import text as T


@dataclass(frozen=True)
class Parameters:
    """Weights and thresholds of the pair score and of the clustering."""

    mu: float = 0.65  # of the title
    epsilon: float = 0.522  # where clusters are cut
    gamma: float = 0.756  # above which two feature names match
    delta: float = 0.4  # of model words in the title's score
    alpha: float = 0.602  # above which titles are alike outright
    beta: float = 0.0  # of the cosine in the title's score
    word: float = 0.3  # below which the letters of two model words are alike


def grams(s: Column) -> Column:
    """All 3-grams, repeats included; none in shorter strings."""
    return F.when(F.length(s) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1))), lambda i: F.substring(s, i, F.lit(3)))).otherwise(
        F.array().cast("array<string>")
    )


def qgram_sim(a: Column, b: Column) -> Column:
    """(|A| + |B| - d) / (|A| + |B|): A, B are sets of 3-grams, d the distance of their multisets.

    Blanks are squeezed for d alone. 0 where neither has a 3-gram; repeats can make it negative.
    """
    size = F.size(F.array_distinct(grams(a))) + F.size(F.array_distinct(grams(b)))
    ga, gb = (grams(F.regexp_replace(x, r"\s+", " ")) for x in (a, b))

    def off(k: Column) -> Column:
        return F.abs(F.size(F.filter(ga, lambda x: x == k)) - F.size(F.filter(gb, lambda x: x == k)))

    d = F.when(a == b, F.lit(0)).otherwise(F.aggregate(F.array_distinct(F.concat(ga, gb)), F.lit(0), lambda n, k: n + off(k)))
    return F.when(size == 0, F.lit(0.0)).otherwise((size - d) / F.greatest(size, F.lit(1)))


def set_cosine(a: Column, b: Column) -> Column:
    """Cosine of two sets given as arrays; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.sqrt(F.size(a).cast("double")) * F.sqrt(F.size(b).cast("double")))).otherwise(F.lit(0.0))


def edit_share(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; 0 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, F.levenshtein(a, b) / F.greatest(longer, F.lit(1))).otherwise(F.lit(0.0))


CODES = 190  # elements that one-byte characters from 65 on can stand for


def _array_edits(a: Column, b: Column) -> Column:
    """Edit distance of two arrays, a row of the table at a time."""
    start = F.sequence(F.lit(0), F.size(b))

    def next_row(row: Column, x: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            change = F.get(row, j - 1) + F.when(F.get(b, j - 1) == x, 0).otherwise(1)
            return F.concat(done, F.array(F.least(F.get(done, j - 1) + 1, F.get(row, j) + 1, change)))

        first = F.array(F.get(row, F.lit(0)) + 1)
        return F.when(F.size(b) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1))), first, cell)).otherwise(first)

    return F.element_at(F.aggregate(a, start, next_row), -1)


def runs_share(a: Column, b: Column) -> Column:
    """Edit distance of two arrays, an element at a time, over the longer size; 0 for two empty ones.

    Each element is written as one character, its first place in both arrays,
    where there are characters enough.
    """
    both = F.concat(a, b)

    def coded(x: Column) -> Column:
        return F.array_join(F.transform(x, lambda e: F.chr(F.lit(64) + F.array_position(both, e))), "")

    longer = F.greatest(F.size(a), F.size(b))
    edits = F.when(F.size(both) <= CODES, F.levenshtein(coded(a), coded(b))).otherwise(_array_edits(a, b))
    return F.when(longer > 0, edits / F.greatest(longer, F.lit(1))).otherwise(F.lit(0.0))


def alike_letters(x: Column, y: Column, limit: float) -> Column:
    """Whether ``runs_share`` is below the limit; unequal arrays too short for that are not compared."""
    longer = F.greatest(F.size(x), F.size(y))
    return F.when(x == y, F.lit(0 < limit)).when(1 / F.greatest(longer, F.lit(1)) >= limit, F.lit(False)).otherwise(runs_share(x, y) < limit)


def word_parts(words: Column) -> Column:
    """Model words with what their comparison needs: length, runs of digits and of other characters."""
    return F.transform(words, lambda w: F.struct(w.alias("w"), F.length(w).alias("n"), T.digit_runs(w).alias("digits"), T.other_runs(w).alias("letters")))


def word_scores(a: Column, b: Column, limit: float) -> Column:
    """(f, g, veto) of two arrays of ``word_parts``, each pair of words being looked at once.

    f: mean edit similarity of all pairs, by their lengths; 0 where either side
    has none. g: the same over pairs with like letters and equal digits; -1
    where there are none. veto: whether a pair has like letters and other digits.
    """

    def pair(x: Column, y: Column) -> Column:
        return F.struct(
            (1 - F.levenshtein(x["w"], y["w"]) / F.greatest(x["n"], y["n"], F.lit(1))).alias("s"),
            (x["n"] + y["n"]).cast("double").alias("w"),
            (x["digits"] == y["digits"]).alias("same"),
            alike_letters(x["letters"], y["letters"], limit).alias("alike"),
        )

    def add(sums: Column, p: Column) -> Column:
        fits = p["alike"] & p["same"]
        return F.struct(
            (sums["s"] + p["s"] * p["w"]).alias("s"),
            (sums["w"] + p["w"]).alias("w"),
            F.when(fits, sums["fs"] + p["s"] * p["w"]).otherwise(sums["fs"]).alias("fs"),
            F.when(fits, sums["fw"] + p["w"]).otherwise(sums["fw"]).alias("fw"),
            (sums["veto"] | (p["alike"] & ~p["same"])).alias("veto"),
        )

    def means(sums: Column) -> Column:
        of = lambda s, w, none: F.when(sums[w] > 0, sums[s] / F.greatest(sums[w], F.lit(1.0))).otherwise(F.lit(none))
        return F.struct(of("s", "w", 0.0).alias("f"), of("fs", "fw", -1.0).alias("g"), sums["veto"].alias("veto"))

    zero = F.struct(*[F.lit(0.0).alias(x) for x in ("s", "w", "fs", "fw")], F.lit(False).alias("veto"))
    every = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: pair(x, y))))
    return F.aggregate(every, zero, add, means)


def title_veto(a: Column, b: Column, limit: float) -> Column:
    """Whether two arrays of model words hold a pair with like letters and other digits."""
    return word_scores(word_parts(a), word_parts(b), limit)["veto"]


def avg_lev_sim(a: Column, b: Column) -> Column:
    """Mean edit similarity of all pairs of words, by their lengths; 0 where either side has none."""
    return word_scores(word_parts(a), word_parts(b), 0.0)["f"]


def avg_lev_sim_matching(a: Column, b: Column, limit: float) -> Column:
    """The same over pairs with like letters and equal digits; -1 where there are none."""
    return word_scores(word_parts(a), word_parts(b), limit)["g"]


def title_score(cosine: Column, words: Column, p: Parameters) -> Column:
    """Similarity of titles given the cosine of their tokens and their ``word_scores``; -1 where a pair of model words speaks against it."""
    f = p.beta * cosine + (1 - p.beta) * words["f"]
    return F.when(cosine > p.alpha, F.lit(1.0)).when(words["veto"], F.lit(-1.0)).when(words["g"] == -1, f).otherwise(p.delta * words["g"] + (1 - p.delta) * f)


def title_sim(a: Column, b: Column, ma: Column, mb: Column, p: Parameters) -> Column:
    """``title_score`` of titles given their tokens and model words."""
    return title_score(set_cosine(a, b), word_scores(word_parts(ma), word_parts(mb), p.word), p)
