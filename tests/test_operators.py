import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions.hashing import steady_coefficients
from kindred.functions.similarity import Parameters
from kindred.operators import blocking, brands, cluster, evaluate, experiment, meeting, minhash, scoring, tables, vocab
from kindred.plans import pipeline, queries
from kindred.sources import offers, products

SF = "/root/testdata/sf0.001"
ROWS = [
    ("g1", "s1", 'LG 55LM7600 55" 120Hz', {"Brand": "LG Electronics", "Screen Size": "55inch", "Weight": "40.5lbs"}),
    ("g1", "s2", "LG 55-Inch 55LM7600 LED", {"Screen Size": "55inch", "Weight": "40.5lbs"}),
    ("g2", "s1", "Sony KDL40 40 inch", {"Brand": "Sony", "Screen Size": "40inch"}),
    ("g2", "s2", "Sony KDL40 40-Inch TV", {"Brand": "SONY", "Screen Size": "40 inches"}),
    ("g3", "s3", "", {}),
]


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    groups = {}
    for g, s, t, f in ROWS:
        groups.setdefault(g, []).append({"shop": s, "title": t, "modelID": g, "featuresMap": f})
    path = tmp_path_factory.mktemp("json") / "products.json"
    path.write_text(json.dumps(groups))
    return products.read_json(spark, str(path))


def test_json_source(shop):
    rows = shop.orderBy("product_id").collect()
    assert [r.product_id for r in rows] == [1, 2, 3, 4, 5]
    assert [(r.model_id, r.shop, r.title, r.features) for r in rows] == ROWS


def test_brands(shop):
    ready = {r.product_id: r for r in pipeline.prepared(shop).collect()}
    assert [ready[i].brand for i in range(1, 6)] == ["lg", "lg", "sony", "sony", "nobrand"]
    assert ready[2].features["Brand"] == "lg"


def test_substrings_are_never_broadcast(spark, monkeypatch):
    """Plans take the size of a file for that of what is cut from its texts; the sides are measured, and either way gives the same rows."""
    branded = tables.cut(brands.with_brand(offers.products(spark, SF)))
    words = tables.cut(vocab.vocabulary(branded))
    made = []
    for sent in (tables.SENT, 0):
        monkeypatch.setattr(tables, "SENT", sent)
        made.append([])
        for df in (brands.impute_brand(branded).select("product_id", "brand"), vocab.representation(branded, words), vocab.representation(branded, vocab.vocabulary(branded))):
            plan = df._jdf.queryExecution().sparkPlan().toString()
            assert "BuildLeft" not in plan and ("SortMergeJoin" in plan or sent)
            made[-1].append(sorted(map(tuple, df.collect())))
    assert made[0] == made[1] and all(made[0])


def test_representation_is_by_substring(shop):
    ready = pipeline.prepared(shop)
    words = vocab.vocabulary(ready)
    listed = [r.word for r in words.orderBy("idx").collect()]
    assert listed == sorted(listed)
    texts = {r.product_id: [r.title, *[v for k, v in r.features.items() if any(p in k.lower() for p in ("size", "weight"))]] for r in ready.collect()}
    want = {(i, n + 1) for i, ts in texts.items() for n, w in enumerate(listed) if any(w in t for t in ts)}
    assert {tuple(r) for r in vocab.representation(ready, words).collect()} == want


def test_scores_against_plain_python(spark):
    """The DataFrame scorer against the formulas in plain Python, over offers of a few parts."""
    import re

    ready = pipeline.prepared(offers.products(spark, SF).filter("product_id < 60"))
    ids = ready.select("product_id")
    pairs = ids.select(F.col("product_id").alias("l")).join(ids.select(F.col("product_id").alias("r")), F.col("l") < F.col("r"))
    rows, p = {r.product_id: r for r in ready.collect()}, Parameters()

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            old, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                old, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, old + (x != y))
        return row[-1] / max(len(a), len(b), 1)

    def qgram(a, b):
        g = lambda s: [s[i : i + 3] for i in range(len(s) - 2)]
        size = len(set(g(a))) + len(set(g(b)))
        d = 0 if a == b else sum(abs(g(a).count(k) - g(b).count(k)) for k in {*g(a), *g(b)})
        return (size - d) / size if size else 0.0

    mixed = lambda s: {t for t in s.split() if re.match(r"[a-zA-Z0-9]*(([0-9]+[^0-9, ]+)|([^0-9, ]+[0-9]+))[a-zA-Z0-9]*", t)}
    digits, others = (lambda w: re.findall("[0-9]+", w)), (lambda w: re.findall("[^0-9]+", w))

    def mean(pairs):
        return sum((1 - lev(x, y)) * (len(x) + len(y)) for x, y in pairs) / sum(len(x) + len(y) for x, y in pairs) if pairs else None

    def title(a, b):
        for old in ("and", "or", "&", "/", "-"):
            a, b = a.replace(old, " "), b.replace(old, " ")
        A, B = set(a.split()), set(b.split())
        cos = len(A & B) / (len(A) * len(B)) ** 0.5
        if cos > p.alpha:
            return 1.0
        both = [(x, y) for x in mixed(a) for y in mixed(b)]
        like = [(x, y) for x, y in both if lev(others(x), others(y)) < p.word]
        if any(digits(x) != digits(y) for x, y in like):
            return -1.0
        f, g = mean(both) or 0.0, mean([q for q in like if digits(q[0]) == digits(q[1])])
        return f if g is None else p.delta * g + (1 - p.delta) * f

    def distance(a, b):
        met = [(x, y, qgram(x, y)) for x in a.features for y in b.features if qgram(x, y) > p.gamma]
        feature = sum(s * qgram(a.features[x], b.features[y]) for x, y, s in met) / sum(s for *_, s in met) if met else 0.0
        rest = [set().union(*[mixed(v) for k, v in r.features.items() if k not in {m[i] for m in met}]) for i, r in enumerate((a, b))]
        words = 2 * len(rest[0] & rest[1]) / (len(rest[0]) + len(rest[1])) if all(rest) else 0.0
        share, t = len(met) / min(len(a.features), len(b.features)), title(a.title, b.title)
        if t == -1:
            return 1 - (share * feature + (1 - share) * words)
        first = (1 - p.mu) * share
        return 1 - (first * feature + (1 - p.mu - first) * words + p.mu * t)

    got = scoring.distances(pairs, ready, p).collect()
    assert len(got) == 60 * 59 // 2
    for r in got:
        assert r.dist == pytest.approx(distance(rows[r.l], rows[r.r])), (r.l, r.r)


def test_titles_are_scored_once_and_never_broadcast(spark):
    """Products of one title share its scores, null titles too, and no side of a pair is broadcast."""
    ready = pipeline.prepared(offers.products(spark, SF).filter("product_id < 24"))
    copies = ready.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("product_id", F.col("product_id") + 1000 * F.col("n")).drop("n")
    copies = tables.cut(copies)
    ids = copies.select("product_id")
    pairs = tables.cut(ids.select(F.col("product_id").alias("l")).join(ids.select(F.col("product_id").alias("r")), F.col("l") < F.col("r")))
    seen = []
    got = scoring.by_titles(pairs, copies, lambda once: seen.append(once.count()) or scoring._title_scores(once, copies, Parameters()))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, scoring._title_scores(pairs, copies, Parameters()).collect()))
    assert 0 < seen[0] <= 24 * 24 < pairs.count()
    for df in (got, scoring.title_sims(pairs, copies), scoring.paired(pairs, copies, "features")):
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
    none = copies.withColumn("title", F.lit(None).cast("string"))
    assert scoring.by_titles(pairs, none, lambda once: once.withColumn("x", F.lit(1))).count() == pairs.count()


def linkage(d, epsilon):
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        best = min(((np.mean([d[i][j] for i in a for j in b]), a[0], b[0], x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if a[0] < b[0]))
        if not best[0] < epsilon:
            break
        groups[best[3]] = sorted(groups[best[3]] + groups[best[4]])
        del groups[best[4]]
    return {i: g[0] for g in groups for i in g}


def test_average_linkage_and_components(spark):
    rng = np.random.default_rng(2)
    edges, want = [], {}
    for g in range(6):
        n = int(rng.integers(2, 9))
        d = np.full((n, n), cluster.FAR)
        for i in range(n):
            for j in range(i):
                if rng.random() < 0.6:
                    d[i, j] = d[j, i] = rng.random()
                    edges.append((100 * g + j, 100 * g + i, float(d[i, j])))
        want |= {100 * g + i: 100 * g + c for i, c in linkage(d, 0.522).items()}
    frame = spark.createDataFrame(edges, "l bigint, r bigint, dist double")
    ids = spark.createDataFrame([(i,) for i in [*want, 999]], "product_id bigint")
    assert {tuple(r) for r in cluster.clusters(ids, frame, 0.522).collect()} == {*want.items(), (999, 999)}


def test_components_of_a_path(spark):
    path = spark.range(40).selectExpr("id + 1 as r", "id as l")
    assert {r.component for r in cluster.components(path).collect()} == {0}
    assert cluster.components(path.limit(0)).count() == 0


def test_metrics_without_pairs_are_zero(shop, spark):
    none = spark.createDataFrame([], "l bigint, r bigint")
    assert tuple(evaluate.blocking_metrics(none, shop).first()) == (0.0, 0.0, 0.0, 0.0)
    r = evaluate.confusion(none, shop).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (0, 0, 2, 0.0, 0.0, 0.0)


def test_tuning_keeps_the_best_and_the_literal_way(spark):
    f1 = spark.createDataFrame([(0.45, 0.2), (0.5, 0.9), (0.51, 0.9), (0.55, 0.1)], "epsilon double, f1 double")
    assert experiment.tuned(f1).first().epsilon == 0.5
    assert experiment.tuned(f1, last_positive=True).first().epsilon == 0.55


def test_bootstrap_covers_all(shop):
    rows = experiment.bootstrap(shop, "1").collect()
    assert sorted(r.product_id for r in rows) == [1, 2, 3, 4, 5]


def test_products_without_words_have_no_candidates(shop):
    found, _ = blocking.block(pipeline.prepared(shop), 0.3)
    assert all(5 not in (r.l, r.r) for r in found.collect())


def test_one_bootstrap_end_to_end(spark):
    few = pipeline.prepared(offers.products(spark, SF).filter("product_id < 120"))
    r = experiment.one_bootstrap(few, 0.5, 3, epsilons=(0.5,)).first()
    assert all(0 <= r[m] <= 1 for m in experiment.METRICS) and r.recall > 0.3
    assert experiment.curves(experiment.averaged(experiment.one_bootstrap(few, 0.5, 3, epsilons=(0.5,)))).count() == 6


def test_veto(shop):
    ready = brands.with_brand(shop)
    pairs = ready.sparkSession.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4)], "l bigint, r bigint")
    assert {tuple(r) for r in brands.comparable(pairs, ready).collect()} == {(1, 2), (3, 4)}


def test_sweeps_hold_all_thresholds_runs_and_metrics(spark, monkeypatch):
    """The registered sweeps against means by hand; splits themselves are stood in for."""
    rng, made = np.random.default_rng(4), {}

    def one(products, t, seed, p, epsilons):
        assert epsilons == experiment.EPSILONS and products.count() > 0
        made[t, seed] = values = rng.random(len(experiment.METRICS)).round(3).tolist()
        return spark.createDataFrame([(t, seed, *values)], "t double, seed int, " + ", ".join(f"{m} double" for m in experiment.METRICS))

    monkeypatch.setattr(experiment, "one_bootstrap", one)
    ready = pipeline.prepared(offers.products(spark, SF).filter("product_id < 20"))
    monkeypatch.setattr(queries, "_prepared", lambda spark, folder: ready)
    means = {r.t: r for r in queries.queries()["sweep_avg"](spark, SF).collect()}
    assert set(means) == set(experiment.THRESHOLDS) and len(made) == 35
    for t, r in means.items():
        for i, m in enumerate(experiment.METRICS):
            assert abs(r[m] - np.mean([v[i] for (u, _), v in made.items() if u == t])) < 1e-6
    made.clear()
    curve = queries.queries()["sweep_curve"](spark, SF).collect()
    assert {(r.t, r.metric) for r in curve} == {(t, m) for t in experiment.THRESHOLDS for m in experiment.METRICS if m != "fraction"}


def test_blocks_agree_with_plain_candidates(spark):
    """Pairs by classes of equal words, and with the vetoes in the joins, against bands compared product by product."""
    ready = pipeline.prepared(offers.products(spark, SF).filter("product_id < 400"))
    ready = ready.withColumn("brand", F.when(F.col("product_id") % 7 == 0, brands.MISSING).otherwise(F.col("brand")))
    made = blocking.blocks(ready, 0.5)
    words = vocab.vocabulary(ready)
    signed = minhash.signatures(vocab.representation(ready, words), made.shape, steady_coefficients(made.shape.s))
    buckets = {}
    for r in minhash.bands(signed, made.shape).collect():
        buckets.setdefault((r.band, tuple(r.key)), []).append(r.product_id)
    want = {(a, b) for ids in buckets.values() for a in ids for b in ids if a < b}
    got = [tuple(r) for r in made.candidates().collect()]
    assert want and len(got) == len(want) and set(got) == want
    rows = {r.product_id: r for r in ready.collect()}
    fits = lambda a, b: rows[a].shop != rows[b].shop and (rows[a].brand == rows[b].brand or brands.MISSING in (rows[a].brand, rows[b].brand))
    left = [tuple(r) for r in made.comparable(ready).collect()]
    assert len(left) == len(set(left)) and set(left) == {q for q in want if fits(*q)}


def test_pairs_are_made_once_in_blocks(spark, monkeypatch):
    """Buckets cut into small blocks and classes into small nodes give the same pairs, each once, with no distinct over them and no side of a join broadcast."""
    few = pipeline.prepared(offers.products(spark, SF).filter("product_id < 300"))
    ready = few.withColumn("brand", F.when(F.col("product_id") % 7 == 0, brands.MISSING).otherwise(F.col("brand")))
    copies = tables.cut(ready.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("product_id", F.col("product_id") + 1000 * F.col("n")).drop("n"))
    made = []
    for block, held in ((4096, 64), (16, 2)):
        monkeypatch.setattr(meeting, "BLOCK", block)
        monkeypatch.setattr(blocking, "HELD", held)
        b = blocking.blocks(copies, 0.5)
        every, fitting = b.candidates(), b.comparable(copies)
        for df in (every, fitting):
            plan = df._jdf.queryExecution().sparkPlan().toString()
            assert "BuildLeft" not in plan and plan.count("BroadcastHashJoin") == plan.count("LeftOuter, BuildRight")  # blocks of large buckets alone
        assert "Aggregate" not in every._jdf.queryExecution().sparkPlan().toString()
        rows = [[tuple(r) for r in df.collect()] for df in (every, fitting)]
        assert all(len(r) == len(set(r)) for r in rows)
        assert tuple(b.comparable_hits(copies).first()) == tuple(evaluate.hits(fitting, copies).first())
        made.append([set(r) for r in rows])
    assert made[0] == made[1] and made[0][1] < made[0][0]


def test_candidates_are_counted_without_a_list(spark, monkeypatch):
    """Counts by classes and models against the listed pairs, for two sets of products and all, some without a model; and of clusters."""
    ready = pipeline.prepared(offers.products(spark, SF).filter("product_id < 200"))
    copies = ready.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("product_id", F.col("product_id") + 1000 * F.col("n")).drop("n")
    copies = tables.cut(copies.withColumn("model_id", F.when(F.col("product_id") % 11 > 0, F.concat("model_id", F.lit("x")))))
    made = blocking.blocks(copies, 0.5)
    monkeypatch.setattr(evaluate, "hits", None)  # no pair is listed to be counted
    weights = F.array((F.col("product_id") % 3 > 0).cast("bigint"), (F.col("product_id") % 2).cast("bigint"))
    got = {r.run: (r.pairs, r.found) for r in made.hits(copies.select("product_id", "model_id", weights.alias("weights"))).collect()}
    every = tuple(made.all_hits(copies).first())
    model = {r.product_id: r.model_id for r in copies.collect()}
    pairs = [tuple(r) for r in made.candidates().collect()]

    def count(fits):
        inside = [q for q in pairs if all(map(fits, q))]
        return len(inside), sum(model[l] is not None and model[l] == model[r] for l, r in inside)

    assert got == {0: count(lambda i: i % 3 > 0), 1: count(lambda i: i % 2 == 1)} and every == count(lambda i: True) and all(every)
    grouped = copies.select("product_id", (F.col("product_id") % 23).alias("cluster_id"))
    both = [(l, r) for l in model for r in model if l < r and l % 23 == r % 23]
    assert tuple(evaluate.cluster_hits(grouped, copies).first()) == (len(both), sum(model[l] is not None and model[l] == model[r] for l, r in both))


def test_band_words_tell_bands_apart(spark):
    """Bands of more digits than a word holds: words are equal just where the hashes of a band are."""
    shape = minhash.Bands(900, 45, 1409, 15, 3)
    rng = np.random.default_rng(1)
    bits = [sorted({int(i) for i in rng.integers(1, 900, 3)}) for _ in range(60)]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate([*bits, *bits[:5]])], "product_id bigint, idx array<bigint>")
    family = steady_coefficients(45)
    assert minhash.word_width(shape) == (6, 3)
    words = {r.product_id: r.words for r in minhash.band_words(rows, shape, family).collect()}
    keys = {}
    for r in minhash.bands(minhash.sign(rows, shape, family), shape).collect():
        keys[r.product_id, r.band] = tuple(r.key)
    for x in words:
        for y in words:
            assert [words[x][3 * b : 3 * b + 3] == words[y][3 * b : 3 * b + 3] for b in range(3)] == [keys[x, b] == keys[y, b] for b in range(3)]


def test_linkage_of_pairs_agrees_with_the_whole_matrix():
    rng = np.random.default_rng(5)
    for n in (2, 5, 12, 30):
        d = np.full((n, n), cluster.FAR)
        pairs = [(i, j) for j in range(n) for i in range(j) if rng.random() < 0.7]
        for i, j in pairs:
            d[i, j] = d[j, i] = rng.random()
        got = cluster.average_linkage(np.array([i for i, _ in pairs], int), np.array([j for _, j in pairs], int), np.array([d[q] for q in pairs]), 0.522)
        assert {i: got.get(i, i) for i in range(n)} == linkage(d, 0.522)
    twins = cluster.average_linkage(np.array([0, 0, 1, 2]), np.array([1, 2, 2, 3]), np.array([0.1, 0.1, 0.1, 0.5]), 0.522)
    assert twins == {0: 0, 1: 0, 2: 0, 3: 3}


def test_distances_meet_texts_by_blocks(spark, monkeypatch):
    """No join by the pair, and the same distances in one unit as in many, at a glance or by sorting; values may be missing."""
    from kindred.operators import pairwise

    cases = [(f"acer {n}inch mx{n % 3} aéb{n}c", {"Size": f"{n % 4}inch", "Sizes": "4  inch", "Weight": None if n % 5 == 0 else f"{n}.5kg x1 x1"}) for n in range(24)]
    cases += [("", {}), ("1a 2b " + " ".join(f"w{k}x" for k in range(40)), {"Note": " ".join(f"k{k}" for k in range(60)), "Notes": "k1 k2"}), ("1a", {"Note": "k3 k4 k5"})]
    products = spark.createDataFrame([(n, *c) for n, c in enumerate(cases)], "product_id bigint, title string, features map<string, string>")
    ids = products.select(F.col("product_id").alias("l"))
    pairs = ids.crossJoin(ids.withColumnRenamed("l", "r")).filter("l < r")
    made = scoring.distances(pairs.select("l", "r"), products)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("Union")[0]
    want = {(r.l, r.r): r.dist for r in made.collect()}
    assert len(want) == len(cases) * (len(cases) - 1) // 2
    titles = {(r.l, r.r): r for r in scoring.title_sims(pairs, products).collect()}
    for r in scoring.feature_scores(pairs, products.withColumn("features", F.map_filter("features", lambda _, v: v.isNotNull()))).collect():
        t, k = titles[r.l, r.r].title_sim, max(min(len(cases[r.l][1]), len(cases[r.r][1])), 1)
        share, p = r.m / k, Parameters()
        first = (1 - p.mu) * share
        mixed = first * r.feature_sim + (1 - p.mu - first) * r.mw_perc + p.mu * t
        assert want[r.l, r.r] == pytest.approx(1 - (share * r.feature_sim + (1 - share) * r.mw_perc if t == -1 else mixed), abs=1e-12), (r.l, r.r)
    for name, value in (("BLOCK", 4), ("LEAST", 1), ("WIDE", 2), ("CHUNK", 7), ("TASKS", 3)):
        monkeypatch.setattr(pairwise, name, value)
    code = pairwise._scored(Parameters())  # the patched module does not reach the workers, so units are made here

    def unit(rows):
        import pyarrow as pa

        return code(iter([pa.Table.from_pylist([r.asDict() for r in rows], schema=pa.schema([("unit", pa.int32()), ("l", pa.int64()), ("r", pa.int64()), ("record", pa.list_(pa.list_(pa.string())))])).to_batches()[0]]))

    got = {}
    rows = pairwise._dealt(pairs, products).collect()
    assert len({r.unit for r in rows}) > 6
    for batch in unit(rows):
        got |= {(r["l"], r["r"]): r["dist"] for r in batch.to_pylist()}
    assert got == want


def test_edges_are_thinned_to_a_forest(spark, monkeypatch):
    """Each task keeps fewer edges than it has nodes, and components stay the same."""
    rng = np.random.default_rng(3)
    edges = {tuple(sorted(int(x) for x in 50 * g + rng.integers(0, 50, 2))) for g in range(4) for _ in range(400)}
    frame = spark.createDataFrame([e for e in edges if e[0] < e[1]], "l bigint, r bigint").coalesce(1)
    kept = cluster.forest(frame)
    assert kept.count() == 4 * 49
    assert {tuple(r) for r in cluster.components(frame).collect()} == {(50 * g + n, 50 * g) for g in range(4) for n in range(50)}
    path = np.random.default_rng(4).permutation(500)
    assert {(int(a), int(b)) for a, b in zip(*cluster.stars(path[:-1], path[1:]))} == {(n, 0) for n in range(1, 500)}


def test_linkage_takes_little_room_and_breaks_ties_by_members(spark):
    """A component is held as arrays, and equal distances, pairs to other components and several batches change nothing."""
    import tracemalloc

    rng = np.random.default_rng(6)
    for n in (8, 20, 33):
        d = np.full((n, n), cluster.FAR)
        pairs = [(i, j) for j in range(n) for i in range(j) if rng.random() < 0.9]
        for i, j in pairs:
            d[i, j] = d[j, i] = rng.choice([0.0, 0.25, 0.5, 0.75])
        got = cluster.average_linkage(np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]), np.array([d[q] for q in pairs]), 0.522)
        assert {i: got.get(i, i) for i in range(n)} == linkage(d, 0.522)
        held = cluster._Component(0.522)
        for k in range(0, len(pairs), 7):
            part = sorted(pairs)[k : k + 7]
            held.add(np.array([10 * i for i, _ in part] + [10 * part[-1][0]]), np.array([10 * j for _, j in part] + [9999]), np.array([d[q] for q in part] + [0.6]))
        found = {int(i): int(c) for i, c in zip(*held.solved())}
        assert 9999 not in found
        assert {i: found.get(10 * i, 10 * i) for i in got} == {i: 10 * c for i, c in got.items()}
    l, r = np.triu_indices(600, 1)
    dist = rng.random(len(l)) * 0.5 + 0.4
    tracemalloc.start()
    cluster.average_linkage(l, r, dist, 0.522)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80 * len(l)


def test_parts_of_scores_are_made_in_units_too(spark):
    """Scores of titles and of features meet no text by the pair, and are those of the column expressions."""
    ready = pipeline.prepared(offers.products(spark, SF).filter("product_id < 60"))
    odd = spark.createDataFrame([(900, "", {}), (901, "5x 6x7 " + " ".join(f"w{k}x" for k in range(30)), {"Item Weight": "5.5lbs", "Item Weights": "6x 7x", "Note": "8x"}), (902, "5x 6x8", {"Note": "8x 9x"})], "product_id bigint, title string, features map<string, string>")
    products = tables.cut(ready.select("product_id", "title", "features").unionByName(odd))
    ids = products.select(F.col("product_id").alias("l"))
    pairs = tables.cut(ids.crossJoin(ids.withColumnRenamed("l", "r")).filter("l < r"))
    p = Parameters()
    for made, plain in (
        (scoring.title_scores(pairs, products, p), scoring._title_scores(pairs, products, p)),
        (scoring.title_sims(pairs, products, p), scoring._title_scores(pairs, products, p).select("l", "r", "title_sim")),
        (scoring.feature_scores(pairs, products, p), scoring._feature_scores(pairs, products, p)),
    ):
        assert "Join" not in made._jdf.queryExecution().executedPlan().toString() and made.columns == plain.columns
        got, want = ({(r.l, r.r): tuple(r)[2:] for r in df.collect()} for df in (made, plain))
        assert len(got) == 63 * 62 // 2 and got.keys() == want.keys()
        for q, x in got.items():
            assert x == pytest.approx(want[q], abs=1e-12), q


def test_agreement_by_bits_counts_every_pair_once(monkeypatch):
    """Weighted counts of rows and columns that agree in some band, by bits, against all pairs; buckets are marked one by one or as a whole."""
    from kindred.operators import tally

    rng = np.random.default_rng(8)
    for few, step, rows in ((0, 3, 7), (2, 5, 50), (1000, 256, 1 << 13)):
        for name, value in (("FEW", few), ("STEP", step), ("ROWS", rows)):
            monkeypatch.setattr(tally, name, value)
        x, y = ([rng.integers(0, n, size) for n in (3, 40, 1000)] for size in (70, 131))
        w, v = rng.integers(0, 9, (70, 2)), rng.integers(0, 9, (131, 2))
        same = np.any([a[:, None] == b for a, b in zip(x, y)], 0)
        assert tally.Agreeing(x, y).weighed(w, v) == [int((np.outer(w[:, k], v[:, k]) * same).sum()) for k in range(2)]
    signed = rng.integers(0, 3, (200, 7)).astype(np.int32)
    assert len(np.unique(tally._keys(signed, 2**31 - 1))) == len(np.unique(signed, axis=0))


def test_metrics_hold_all_thresholds_and_splits(spark, monkeypatch):
    """All thresholds and five splits, each blocked on its own: means by hand of pairs that are listed."""
    ready = tables.cut(pipeline.prepared(offers.products(spark, SF).filter("product_id < 100")))
    monkeypatch.setattr(queries, "_prepared", lambda spark, folder: ready)
    got = {r.t: r for r in queries.queries()["metric_avg"](spark, SF).collect()}
    assert set(got) == set(experiment.THRESHOLDS) and len(queries.RUNS) == 5
    model, each = {r.product_id: r.model_id for r in ready.collect()}, []
    for run in queries.RUNS:
        outside = [r.product_id for r in experiment.bootstrap(ready, run).filter("not in_bag").collect()]
        listed = blocking.blocks(tables.cut(ready.filter(F.col("product_id").isin(outside))), 0.5).candidates().collect()
        found, pairs = sum(model[r.l] == model[r.r] for r in listed), len(listed)
        duplicates = sum(model[l] == model[r] for l in outside for r in outside if l < r)
        each.append((pairs / (len(outside) * (len(outside) - 1) / 2), found / pairs, found / duplicates))
    assert got[0.5][1:4] == pytest.approx(np.mean(each, 0), abs=1e-6)


def test_all_cuts_come_of_one_linkage(spark, monkeypatch):
    """Clusters at each cut, of components solved once, against clusters made for that cut alone."""
    rng, cuts = np.random.default_rng(9), experiment.EPSILONS
    edges = [(100 * g + i, 100 * g + j, float(rng.choice([0.3, 0.45, 0.5, 0.55, rng.random()]))) for g in range(5) for j in range(12) for i in range(j) if rng.random() < 0.7]
    frame = spark.createDataFrame(edges, "l bigint, r bigint, dist double")
    products = spark.createDataFrame([(100 * g + i, f"m{g}{i % 4}") for g in range(5) for i in range(13)], "product_id bigint, model_id string")
    want = {}
    for e in cuts:
        found = evaluate.cluster_hits(cluster.clusters(products, frame, e), products)
        want[e] = tuple(evaluate.confusion_rates(found, products).first())
    solved, merged = [], cluster.merged
    monkeypatch.setattr(cluster, "merged", lambda *x: solved.append(1) or merged(*x))
    got = {r.epsilon: tuple(r)[:-1] for r in experiment.by_epsilon(products, frame, cuts).collect()}
    assert got == want and len(set(want.values())) > 3 and len(solved) == 1
    none = experiment.by_epsilon(products, frame.limit(0), cuts).collect()
    assert len(none) == len(cuts) and all((r.tp, r.fp) == (0, 0) for r in none)
