"""Personal data by candidate gradient boosting.

Strict patterns find the base spans, which always stay. High-recall generators
propose more, and overlapping, spans: written-out addresses, IPv6 and defanged
addresses, dotted or short card numbers, phone numbers without a plus.
Gradient-boosted trees score each proposal by its format and its context, and a
threshold per kind, calibrated on held-out examples, selects what is added.

The trees are trained at each call on generated examples (``examples`` of them,
none from the corpus): their features come from the same expressions, all are
binary, so the examples are summed by feature vector and the boosting sees at
most 2**9 weighted rows. The trees then become one SQL expression.

All of this is DataFrame code: no Python runs on the executors.
"""

from __future__ import annotations

import functools
import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.store import col, fresh

KINDS = ("email", "ip", "card", "phone")

# The base patterns, written so that Java's engine needs neither recursion nor a
# second try at the same characters: possessive repeats, and a match may begin
# only where a run of its first class begins or the last match ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain before a pattern is tried on it.
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9]", "phone": "\\+[0-9]"}

LOOSE = {
    "email": r"[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|@)\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\[\.\]|\.)\x20?[A-Za-z0-9-]++)++",
    "ip": r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){3,7}|[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}",
    "card": r"[0-9]{2,}+(?:[\x20.-][0-9]++)*+",
    "phone": r"(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}|00[0-9]{1,3}[\x20-][0-9][\x20().0-9-]{5,16}[0-9]",
}
LOOSE_NEEDS = {"email": r"\((?:at|dot)\)|\[(?:at|dot|\.)\]|@", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]|[0-9]\[\.\][0-9]", "card": "[0-9]{2}[0-9\\x20.-]{10}", "phone": "[0-9][\\x20.-][0-9]"}
CUES = {
    "email": r"(?i)mail|contact|write|address|reach",
    "ip": r"(?i)\bip|host|server|addr|login|client",
    "card": r"(?i)card|visa|credit|debit|pay|amex",
    "phone": r"(?i)phone|tel|call|fax|mobile|cell|whatsapp|reach",
}
FEATURES = ("left_word", "right_word", "cue", "valid", "sized", "even", "opens")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when(i % 2 == 0, twice).otherwise(x)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def _octets(s: Column) -> Column:
    """Whether all numbers in a dotted string are at most 255."""
    def small(p: Column) -> Column:
        bare = F.ltrim(p, F.lit("0"))
        return F.when(F.length(bare) > 3, False).otherwise(F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(F.regexp_replace(s, r"\[|\]", ""), r"\."), small)


def _holds(kind: str, s: Column) -> Column:
    """The base check of a match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _octets(s)
    d = _digits(s)
    n = F.length(d)
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), _luhn(d)).otherwise(F.lit(False))
    return (n >= 8) & (n <= 15)


SPAN = "array<struct<kind:int,s:int,e:int>>"


def _matches(text: Column, pattern: str, needs: str) -> Column:
    none = F.array().cast("array<string>")
    return F.when(text.rlike(needs), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _running(items: Column, start: Column, step, kind: str, block: int = 256) -> Column:
    """The state before each item, where ``step`` makes the next state of a state and an item.

    Arrays grow by being copied, so states are gathered in blocks and blocks in
    an outer array: work grows with the items times a block, and with the
    square of the number of blocks.
    """

    def within(at: Column, part: Column) -> Column:
        first = F.struct(at.alias("at"), F.array().cast(f"array<{kind}>").alias("seen"))
        return F.aggregate(part, first, lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["seen"], F.array(acc["at"])).alias("seen")))

    blocks = F.transform(F.sequence(F.lit(0), F.size(items) - 1, F.lit(block)), lambda i: F.slice(items, i + 1, F.lit(block)))
    first = F.struct(start.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("seen"))
    joined = lambda acc, part: _let(within(acc["at"], part), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["seen"], F.array(r["seen"])).alias("seen")))
    return F.flatten(F.aggregate(blocks, first, joined, lambda acc: acc["seen"]))


def _placed(text: Column, matches: Column, pattern: str, kind: int) -> Column:
    """(kind, s, e, m) of each match, in code points: what split leaves between the matches gives their places."""
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    steps = F.zip_with(between, matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("n"), m.alias("m")))

    def found(steps: Column) -> Column:
        ends = _running(steps, F.lit(0), lambda at, x: at + x["gap"] + x["n"], "int")
        return F.zip_with(steps, ends, lambda x, at: F.struct(F.lit(kind).alias("kind"), (at + x["gap"]).alias("s"), (at + x["gap"] + x["n"]).alias("e"), x["m"].alias("m")))

    none = F.array().cast("array<struct<kind:int,s:int,e:int,m:string>>")
    return F.when(F.size(matches) > 0, _let(steps, found)).otherwise(none)


def _features(text: Column, kind: int, c: Column) -> list[Column]:
    """The binary features of a proposal, in the order of FEATURES."""
    name, m = KINDS[kind], c["m"]
    left = F.substring(text, F.greatest(c["s"] - 23, F.lit(1)), F.least(c["s"], F.lit(24)))
    word = r"[\p{L}\p{N}_]"
    d = _digits(m)
    n = F.length(d)
    if name == "email":
        valid, sized, even = m.rlike(r"[A-Za-z]{2,}$"), F.length(m) <= 80, m.rlike(r"^\S+$|\x20(?:\(at\)|\[at\]|@)\x20")
    elif name == "ip":
        valid = F.when(m.contains("."), _octets(m)).otherwise(m.rlike("^[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}$"))
        sized, even = F.length(m) >= 15, m.rlike("[A-Fa-f]")
    elif name == "card":
        valid = _luhn(d)
        sized, even = (n >= 13) & (n <= 19), m.rlike(r"^[0-9]+$|^[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$|^3[0-9]{3}([\x20.-])[0-9]{6}\2[0-9]{5}$")
    else:
        valid, sized, even = ~m.rlike("^[01][0-9]{2}"), (n >= 10) & (n <= 15), m.rlike(r"^\(|^00|^[0-9]{3}([\x20.-])[0-9]{3}\1[0-9]{4}$")
    return [
        F.coalesce(F.right(left, F.lit(1)).rlike(word + "|[.:/-]"), F.lit(False)),
        F.coalesce(F.substring(text, c["e"] + 1, F.lit(2)).rlike("^" + word + r"|^[.:/-]" + word), F.lit(False)),
        left.rlike(CUES[name]),
        valid,
        sized,
        even,
        m.rlike(r"^[(\[]|^0|\((?:at|dot)\)|\[(?:at|dot|\.)\]|^[3-6]"),
    ]


def _coded(text: Column, kind: int, placed: Column) -> Column:
    """Array of (kind, s, e, code) for a kind's placed proposals; code packs the features as bits."""

    def code(c: Column) -> Column:
        bits = [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(_features(text, kind, c))]
        return F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"), functools.reduce(lambda a, b: a + b, bits).alias("code"))

    return F.transform(placed, code)


def _proposals(text: Column, kind: int, matches: Column) -> Column:
    """Array of (kind, s, e, code) for a kind's loose matches."""
    return _coded(text, kind, _placed(text, matches, LOOSE[KINDS[kind]], kind))


def _packed(c: Column) -> Column:
    """A span as one number, so that sets of spans meet by hash."""
    return F.shiftleft(c["s"].cast("bigint"), 31) + c["e"]


def _beside(text: Column, kind: int, matches: Column, base: Column) -> Column:
    """(kind, s, e, m) of the loose matches that overlap no base span."""
    placed = F.transform(_placed(text, matches, LOOSE[KINDS[kind]], kind), _packed)
    # most loose matches are base spans: those go by hash, the rest are compared
    fresh = F.transform(F.array_except(placed, F.transform(base, _packed)), lambda x: F.struct(F.shiftright(x, 31).cast("int").alias("s"), x.bitwiseAND((1 << 31) - 1).cast("int").alias("e")))
    clear = F.filter(fresh, lambda c: _clear(c, base))
    return F.transform(clear, lambda c: F.struct(F.lit(kind).alias("kind"), c["s"].alias("s"), c["e"].alias("e"), F.substring(text, c["s"] + 1, c["e"] - c["s"]).alias("m")))


# ---- training -------------------------------------------------------------


def _check_digit(d: str) -> str:
    total = sum((2 * x - 9 if x > 4 else 2 * x) if i % 2 == 0 else x for i, x in enumerate(map(int, reversed(d))))
    return d + str(-total % 10)


def generated(count: int, seed: int) -> list[tuple[int, str, int]]:
    """(kind, text, label): one proposal in invented surroundings, personal data or not."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    cue = {"email": "mail me at ", "ip": "server ip ", "card": "credit card ", "phone": "phone: "}

    def yes(kind: str) -> str:
        if kind == "email":
            a, d = rng.choice([("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("@", "[.]"), (" @ ", ".")])
            return f"{letters(rng.randint(3, 9))}.{letters(4)}{a}{letters(6)}{d}{rng.choice(['com', 'org', 'net', 'de'])}"
        if kind == "ip":
            return rng.choice([":".join(hexes(4) for _ in range(8)), "[.]".join(str(rng.randint(1, 255)) for _ in range(4))])
        if kind == "card":
            n = _check_digit(rng.choice("3456") + digits(rng.choice([12, 14, 14, 14])))
            return n if len(n) != 16 or rng.random() < 0.4 else rng.choice(" .-").join(n[i : i + 4] for i in range(0, 16, 4))
        a, b, c, s = rng.choice("23456789") + digits(2), digits(3), digits(4), rng.choice("-. ")
        return rng.choice([f"({a}) {b}-{c}", f"{a}{s}{b}{s}{c}", f"00{rng.randint(30, 49)} {digits(2)} {digits(4)} {digits(4)}"])

    def no(kind: str) -> str:
        if kind == "email":
            return rng.choice([f"{letters(5)}[.]{letters(3)}", f"{letters(4)} @ {digits(2)}.{digits(2)}", f"{letters(3)}(at){digits(3)}.{digits(1)}", f"x @ {letters(3)}.{digits(4)} . {digits(3)}"])
        if kind == "ip":
            return rng.choice([":".join(digits(2) for _ in range(rng.randint(4, 6))), ":".join(hexes(2) for _ in range(6)), "[.]".join(digits(3) for _ in range(4)), ":".join(hexes(4) for _ in range(4))])
        if kind == "card":
            return rng.choice([digits(rng.randint(12, 19)), f"{digits(2)}.{digits(rng.randint(11, 15))}", "-".join(digits(rng.randint(2, 5)) for _ in range(5)), " ".join(digits(rng.randint(2, 4)) for _ in range(rng.randint(4, 12)))])
        return rng.choice([f"{digits(3)} {digits(3)} {digits(4)} {digits(3)}", f"{digits(3)}.{digits(3)} {digits(4)}", f"1{digits(2)}-{digits(3)}-{digits(4)}", f"00{digits(1)} {digits(1)} {digits(3)}.{digits(3)}", f"{digits(2)}{digits(3)} {digits(3)}-{digits(4)}"])

    out = []
    for i in range(count):
        kind, label = i % 4, (i // 4) % 2
        name = KINDS[kind]
        body = yes(name) if label else no(name)
        before = cue[name] if rng.random() < (0.5 if label else 0.1) else letters(4) + " " + letters(5) + " "
        if not label and rng.random() < 0.3:
            before += rng.choice(["v", "x", "id", "/", "-", "1."])
        after = rng.choice([" ", ". ", ", ", "\n"]) if label or rng.random() < 0.6 else rng.choice(["a", "x1", "/2", ":3", "-7"])
        out.append((kind, f"{before}{body}{after}{letters(5)}", label))
    return out


Tree = tuple  # (feature, low, high) with trees or numbers below; feature index over FEATURES then KINDS


def _bits(kind: int, code: int) -> list[int]:
    return [code >> i & 1 for i in range(len(FEATURES))] + [int(kind == k) for k in range(len(KINDS))]


def boost(rows: list[tuple[list[int], float, float]], rounds: int = 40, rate: float = 0.3, depth: int = 3, ridge: float = 1.0) -> list:
    """Newton boosting of the logistic loss; rows: (bits, positive weight, negative weight)."""
    margin, trees = [0.0] * len(rows), []

    def grow(which: list[int], g: list[float], h: list[float], left: int):
        def gain(some: list[int]) -> float:
            return sum(g[i] for i in some) ** 2 / (sum(h[i] for i in some) + ridge)

        best, at = 1e-6, None
        if left:
            for f in range(len(rows[0][0])):
                zero = [i for i in which if not rows[i][0][f]]
                one = [i for i in which if rows[i][0][f]]
                if zero and one and (won := gain(zero) + gain(one) - gain(which)) > best:
                    best, at = won, (f, zero, one)
        if at is None:
            return rate * sum(g[i] for i in which) / (sum(h[i] for i in which) + ridge)
        return (at[0], grow(at[1], g, h, left - 1), grow(at[2], g, h, left - 1))

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g = [a - (a + b) * q for (_, a, b), q in zip(rows, p, strict=True)]
        h = [(a + b) * q * (1 - q) for (_, a, b), q in zip(rows, p, strict=True)]
        trees.append(grow(list(range(len(rows))), g, h, depth))
        margin = [m + _value(trees[-1], bits) for m, (bits, _, _) in zip(margin, rows, strict=True)]
    return trees


def _value(tree, bits: list[int]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if bits[tree[0]] else tree[1]
    return tree


def margin_of(trees: list, kind: int, code: int) -> float:
    return sum(_value(t, _bits(kind, code)) for t in trees)


def thresholds(trees: list, held: list[tuple[int, int, float, float]], precision: float) -> dict[int, float]:
    """For each kind the smallest margin from which held-out examples, pooled to rise (isotonic), are personal data that often."""
    out = {}
    for kind in range(len(KINDS)):
        blocks: list[list[float]] = []  # margin, positive, all
        for m, a, b in sorted((margin_of(trees, k, c), a, b) for k, c, a, b in held if k == kind):
            blocks.append([m, a, a + b])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                last = blocks.pop()
                blocks[-1] = [blocks[-1][0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
        out[kind] = min((m for m, a, n in blocks if a >= precision * n), default=math.inf)
    return out


def _expression(tree, bit) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(bit(tree[0]), _expression(tree[2], bit)).otherwise(_expression(tree[1], bit))


@functools.lru_cache(maxsize=4)
def _trained(spark: SparkSession, examples: int, seed: int, precision: float) -> tuple[list, dict[int, float]]:
    made = spark.createDataFrame(generated(examples, seed), "kind int, text string, label int").withColumn("part", F.pmod(F.xxhash64("text"), F.lit(2)))
    counts: dict[tuple, list[float]] = {}
    for kind in range(len(KINDS)):
        own = made.filter(F.col("kind") == kind).withColumn("m", _matches(F.col("text"), LOOSE[KINDS[kind]], LOOSE_NEEDS[KINDS[kind]]))
        one = own.select("part", "label", F.explode(_proposals(F.col("text"), kind, F.col("m"))).alias("c"))
        for r in one.groupBy("part", "label", F.col("c.code").alias("code")).count().collect():
            counts.setdefault((r["part"], kind, r["code"]), [0.0, 0.0])[1 - r["label"]] += r["count"]
    # scored by all examples of one half, calibrated on the other
    trees = boost([(_bits(k, c), a, b) for (part, k, c), (a, b) in sorted(counts.items()) if part == 0])
    return trees, thresholds(trees, [(k, c, a, b) for (part, k, c), (a, b) in sorted(counts.items()) if part == 1], precision)


def _score(trees: list, kind: int, code: Column) -> Column:
    """Sum of the trees as one expression."""
    def bit(f: int) -> Column:
        return F.lit(f - len(FEATURES) == kind) if f >= len(FEATURES) else code.bitwiseAND(1 << f) != 0

    return functools.reduce(lambda a, b: a + b, (_expression(t, bit) for t in trees))


def _clear(c: Column, others: Column) -> Column:
    return ~F.exists(others, lambda o: (o["s"] < c["e"]) & (c["s"] < o["e"]))


def _clear_of(spans: Column, others: Column) -> Column:
    return F.filter(spans, lambda c: _clear(c, others))


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda c: c["kind"] == kind)).cast("bigint")


def find_spans(
    df: DataFrame, text: str = "text", *, base: str = "pii_base", spans: str = "pii_spans", examples: int = 4000, seed: int = 5, precision: float = 0.97
) -> DataFrame:
    """``df`` with two columns of arrays of (kind, s, e): the base spans and all spans.

    ``kind`` indexes KINDS; ``s`` and ``e`` are code points, end exclusive;
    order is by kind, then start. Base spans of different kinds may overlap;
    added ones overlap no other span. A null text has no spans, an empty table
    gives one, and repeated rows are treated alike. Texts are read whole; a very
    long one's matches are placed in blocks, and only proposals that are no base
    span are compared with those one by one. Columns of ``df`` with the result's
    names are replaced.
    """
    trees, cuts = _trained(df.sparkSession, examples, seed, precision)
    names = [c for c in df.columns if c not in (base, spans)]
    row = df.select(F.struct(*map(col, names)).alias("row"), F.coalesce(col(text), F.lit("")).alias("t"))
    t = F.col("t")
    row = row.select("row", "t", *[_matches(t, BASE[k], NEEDS[k]).alias(f"m{i}") for i, k in enumerate(KINDS)], *[_matches(t, LOOSE[k], LOOSE_NEEDS[k]).alias(f"p{i}") for i, k in enumerate(KINDS)])

    def strict(i: int) -> Column:
        placed = F.filter(_placed(t, F.col(f"m{i}"), BASE[KINDS[i]], i), lambda c: _holds(KINDS[i], c["m"]))
        return F.transform(placed, lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e")))

    row = row.select("row", "t", *[f"p{i}" for i in range(4)], F.concat(*map(strict, range(4))).alias("base"))

    def beside(i: int) -> Column:
        none = F.array().cast("array<struct<kind:int,s:int,e:int,m:string>>")
        return F.when(F.size(f"p{i}") > 0, _beside(t, i, F.col(f"p{i}"), F.col("base"))).otherwise(none)

    row = row.select("row", "t", "base", *[beside(i).alias(f"c{i}") for i in range(4)])

    def added(i: int) -> Column:
        chosen = F.filter(_coded(t, i, F.col(f"c{i}")), lambda c: _score(trees, i, c["code"]) >= F.lit(cuts[i]))
        plain = F.transform(chosen, lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e")))
        return F.when(F.size(F.col(f"c{i}")) > 0, plain).otherwise(F.array().cast(SPAN)) if math.isfinite(cuts[i]) else F.array().cast(SPAN)

    row = row.select("row", "base", *[added(i).alias(f"a{i}") for i in range(4)])
    more = F.col("a0")
    for i in (1, 2, 3):  # of proposals that overlap, the earlier kind's stays
        more = F.concat(more, _clear_of(F.col(f"a{i}"), more))
    row = row.withColumn("more", F.when(F.size("a0") + F.size("a1") + F.size("a2") + F.size("a3") > 0, more).otherwise(F.array().cast(SPAN)))
    every = F.when(F.size("more") > 0, F.array_sort(F.concat("base", "more"))).otherwise(F.col("base"))
    return row.select(*[F.col("row").getField(c).alias(c) for c in names], F.col("base").alias(base), every.alias(spans))


def as_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["s"].cast("string"), c["e"].cast("string"))), ",")


def digests(df: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """Per row: key, counts of base spans by kind, digest of the base spans, all spans."""
    found = find_spans(df.select(col(key).alias(key), col(text).alias("k_text")), "k_text", base="k_base", spans="k_spans", **options)
    counts = [_count(F.col("k_base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(col(key), *counts, F.sha2(as_text(F.col("k_base")), 256).alias("base_sha256"), as_text(F.col("k_spans")).alias("spans"))


def redact(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """``df`` with each span in its text replaced by its kind in brackets, as [EMAIL]; spans that overlap become one, named by the first.

    Rows, other columns and null texts stay as they are.
    """
    spans, base, once = (fresh(df, x) for x in ("k_spans", "k_base", "k_apart"))
    found = find_spans(df, text, base=base, spans=spans, **options)
    t = col(text)
    ordered = F.array_sort(F.transform(F.col(spans), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"))))

    def heads(ordered: Column) -> Column:
        """The first span of each run of spans that overlap, with the end of all before it."""
        ends = _running(ordered, F.lit(0), lambda at, c: F.greatest(at, c["e"]), "int")
        marked = F.zip_with(ordered, ends, lambda c, at: F.struct(c["s"].alias("s"), at.alias("at"), c["kind"].alias("kind")))
        return F.filter(marked, lambda c: c["s"] >= c["at"])

    def ended(firsts: Column) -> Column:
        nexts = F.concat(F.slice(F.transform(firsts, lambda c: c["at"]), F.lit(2), F.size(firsts)), F.array(F.array_max(F.transform(F.col(spans), lambda c: c["e"]))))
        return F.zip_with(firsts, nexts, lambda c, e: F.struct(c["s"].alias("s"), e.alias("e"), c["kind"].alias("kind")))

    apart = _let(_let(ordered, heads), ended)
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    # each span with the text before it, then what is left
    parts = F.transform(
        F.col(once),
        lambda c, i: F.concat(
            F.substring(t, F.when(i > 0, F.get(F.col(once), i - 1)["e"]).otherwise(F.lit(0)) + 1, c["s"] - F.when(i > 0, F.get(F.col(once), i - 1)["e"]).otherwise(F.lit(0))),
            F.get(tags, c["kind"]),
        ),
    )
    tail = F.substring(t, F.element_at(F.col(once), -1)["e"] + 1, F.length(t))
    clean = F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(t)
    found = found.withColumn(once, F.when(F.size(spans) > 0, apart).otherwise(F.array().cast("array<struct<s:int,e:int,kind:int>>")))
    return found.select(*[clean.alias(c) if c == text else col(c) for c in df.columns])
