import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.functions import similarity as S

QGRAM = [
    ("Screen Size", "Screen Size", 1.0), ("Screen Size", "Screen Size Class", 0.75), ("HDMI Inputs", "HDMI Input", 0.941176), ("Brand", "Brand Name", 0.545455),
    ("abc", "xyz", 0.0), ("HD", "HD", 0.0), ("aaaa", "aaaa", 1.0), ("aaaaa", "aaaa", 0.5), ("aaaa", "bbbb", -1.0),
]


def test_qgram_golden(spark):
    df = spark.createDataFrame([(a, b, w) for a, b, w in QGRAM], "a string, b string, w double")
    for r in df.withColumn("s", S.qgram_sim(F.col("a"), F.col("b"))).collect():
        assert r.s == pytest.approx(r.w, abs=1e-6), (r.a, r.b)


def test_qgram_against_python(spark):
    from collections import Counter

    def plain(a, b):
        g = lambda s: [s[i : i + 3] for i in range(len(s) - 2)]
        size = len(set(g(a))) + len(set(g(b)))
        if not size:
            return 0.0
        x, y = (Counter(g(" ".join(s.split()) if s.strip() == s else s)) for s in (a, b))
        d = 0 if a == b else sum(abs(x[k] - y[k]) for k in {*x, *y})
        return (size - d) / size

    words = ["", "ab", "abcabc", "abc abc", "screen size", "size screen", "aaaa", "aaa bbb", "xyzzy"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in df.withColumn("s", S.qgram_sim(F.col("a"), F.col("b"))).withColumn("back", S.qgram_sim(F.col("b"), F.col("a"))).collect():
        assert r.s == pytest.approx(plain(r.a, r.b)) and r.s == pytest.approx(r.back) and r.s <= 1


def frame(spark, a, b):
    return spark.createDataFrame([(a, b)], "a array<string>, b array<string>")


def test_cosine_and_empty_sides(spark):
    for a, b, want in ((["a", "b"], ["b", "c"], 0.5), ([], ["a"], 0.0), (["a"], ["a"], 1.0)):
        assert frame(spark, a, b).select(S.set_cosine(F.col("a"), F.col("b")).alias("s")).first().s == pytest.approx(want)


def test_runs_share(spark):
    for a, b, want in ((["x", "y", "z", "w"], ["x", "q", "z", "w"], 0.25), (["ab"], ["ab"], 0.0), ([], [], 0.0), (["a"], [], 1.0)):
        assert frame(spark, a, b).select(S.runs_share(F.col("a"), F.col("b")).alias("s")).first().s == pytest.approx(want)


def title(spark, a, b, p=S.Parameters()):
    df = frame(spark, a, b)
    words = lambda c: F.filter(c, lambda w: w.rlike("[0-9]"))
    return df.select(S.title_sim(F.col("a"), F.col("b"), words(F.col("a")), words(F.col("b")), p).alias("s")).first().s


def test_title_sim(spark):
    assert title(spark, ["lg", "55lm", "tv"], ["lg", "55lm", "tv"]) == 1.0
    assert title(spark, ["55lm"], ["60lm", "a", "b"]) == -1.0  # like letters, other digits
    assert title(spark, ["a"], ["b"]) == 0.0  # no model words on either side
    far = title(spark, ["55lm", "a", "b", "c"], ["55xq", "d", "e", "f"])
    assert far == pytest.approx(0.5)  # two of four letters, no matching pair


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab1", min_size=1, max_size=4), max_size=3), st.lists(st.text("ab1", min_size=1, max_size=4), max_size=3))
def test_avg_lev_is_symmetric_and_bounded(spark, a, b):
    r = frame(spark, a, b).select(S.avg_lev_sim(F.col("a"), F.col("b")).alias("s"), S.avg_lev_sim(F.col("b"), F.col("a")).alias("t")).first()
    assert r.s == pytest.approx(r.t) and 0 <= r.s <= 1


def test_runs_of_long_words(spark):
    a = [f"r{i}" for i in range(200)]
    b = [*a[:150], "other", *a[151:]]
    got = frame(spark, a, b).select(S.runs_share(F.col("a"), F.col("b")).alias("s"), S.runs_share(F.col("a"), F.slice("b", 1, 199)).alias("t"), S.alike_letters(F.col("a"), F.col("b"), 0.3).alias("like")).first()
    assert (got.s, got.t, got.like) == (pytest.approx(1 / 200), pytest.approx(2 / 200), True)
