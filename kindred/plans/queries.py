"""One query per operator, over the offers of the whole part table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import similarity as S
from kindred.functions import text as T
from kindred.functions.hashing import Bands, steady_coefficients
from kindred.functions.similarity import Parameters
from kindred.operators import blocking, brands, cluster, evaluate, experiment, minhash, scoring, vocab
from kindred.operators.tables import cut
from kindred.plans import pipeline
from kindred.sources import offers

THRESHOLD = 0.5
P = Parameters()
Query = Callable[[SparkSession, str], DataFrame]


def six(x: Column) -> Column:
    """Six decimals, rounded alike in every engine."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.prepared(offers.products(spark, sf_dir))


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers.products(spark, sf_dir).withColumn("title", T.clean_title(F.col("title")))


def _comparable(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ready = _prepared(spark, sf_dir)
    return ready, blocking.blocks(ready, THRESHOLD).comparable(ready)


def _distances(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ready, pairs = _comparable(spark, sf_dir)
    return ready, scoring.distances(pairs, ready, P)


def src_products(spark, sf_dir):
    return offers.products(spark, sf_dir).select("product_id", "model_id", "shop", "title", F.size("features").cast("bigint").alias("n_features"))


def clean_title(spark, sf_dir):
    return _cleaned(spark, sf_dir).select("product_id", F.col("title").alias("clean_title"))


def compare_title(spark, sf_dir):
    return _cleaned(spark, sf_dir).select("product_id", T.compare_title(F.col("title")).alias("compare_title"))


def model_words(spark, sf_dir):
    return vocab.title_words(_cleaned(spark, sf_dir))


def feature_numeric_words(spark, sf_dir):
    return vocab.value_words(_prepared(spark, sf_dir))


def word_runs(spark, sf_dir):
    words = vocab.title_words(_cleaned(spark, sf_dir)).select("word").distinct()
    return words.select("word", F.array_join(T.digit_runs(F.col("word")), "|").alias("digits"), F.array_join(T.other_runs(F.col("word")), "|").alias("others"))


def brand_norm(spark, sf_dir):
    return offers.products(spark, sf_dir).select("product_id", brands.normal_brand(F.col("features")).alias("brand"))


def brand_set(spark, sf_dir):
    return brands.brand_set(brands.with_brand(_cleaned(spark, sf_dir)))


def brand_impute(spark, sf_dir):
    return _prepared(spark, sf_dir).select("product_id", "brand", F.element_at("features", "Brand").alias("feature"))


def comparable_pairs(spark, sf_dir):
    return _comparable(spark, sf_dir)[1]


def condensed_features(spark, sf_dir):
    return vocab.physical_values(_prepared(spark, sf_dir))


def vocabulary(spark, sf_dir):
    return vocab.vocabulary(_prepared(spark, sf_dir))


def binary_repr(spark, sf_dir):
    ready = _prepared(spark, sf_dir)
    return vocab.representation(ready, cut(vocab.vocabulary(ready)))


def band_params(spark, sf_dir):
    V = vocab.vocabulary(_prepared(spark, sf_dir)).count()
    shapes = [(t, Bands.of(V, t)) for t in experiment.THRESHOLDS]
    return spark.createDataFrame([(t, x.V, x.s, x.p, x.r, x.b) for t, x in shapes], "t double, v bigint, s bigint, p bigint, r bigint, b bigint")


def _shape(ready: DataFrame) -> tuple[DataFrame, Bands]:
    words = cut(vocab.vocabulary(ready))
    return words, Bands.of(words.count(), THRESHOLD)


def hash_family(spark, sf_dir):
    _, shape = _shape(_prepared(spark, sf_dir))
    return spark.createDataFrame([(j, a, b) for j, (a, b) in enumerate(steady_coefficients(shape.s))], "j bigint, a bigint, b bigint")


def _signed(spark, sf_dir) -> tuple[DataFrame, Bands]:
    ready = _prepared(spark, sf_dir)
    words, shape = _shape(ready)
    return cut(minhash.signatures(vocab.representation(ready, words), shape, steady_coefficients(shape.s))), shape


def minhash_signature(spark, sf_dir):
    return _signed(spark, sf_dir)[0].select("product_id", F.posexplode("signature").alias("j", "v")).select("product_id", F.col("j").cast("bigint").alias("j"), "v")


def lsh_bands(spark, sf_dir):
    banded = minhash.bands(*_signed(spark, sf_dir))
    return banded.select("product_id", F.col("band").cast("bigint").alias("band"), F.array_join(F.transform("key", lambda v: v.cast("string")), "-").alias("key"))


def lsh_candidates(spark, sf_dir):
    return blocking.block(_prepared(spark, sf_dir), THRESHOLD)[0]


def qgram_sim(spark, sf_dir):
    values = offers.offer_features(spark, sf_dir).filter("k <> 'Brand'").select("k", "v").distinct()
    met = values.select("k", F.col("v").alias("a")).join(values.select("k", F.col("v").alias("b")), "k")
    return met.select("k", "a", "b", six(S.qgram_sim(F.col("a"), F.col("b"))).alias("sim"))


def _title(column: str, value) -> Query:
    def query(spark, sf_dir):
        ready, pairs = _comparable(spark, sf_dir)
        made = scoring.title_sims if column == "title_sim" else scoring.title_scores
        return made(pairs, ready, P).select("l", "r", value(F.col(column)).alias(column))

    return query


def runs_lev(spark, sf_dir):
    """Of all pairs of model words that meet in the titles of a comparable pair."""
    ready, pairs = _comparable(spark, sf_dir)
    met = scoring.paired(pairs, scoring.with_words(ready), "words").select("words_r", F.explode("words_l").alias("a"))
    met = met.select("a", F.explode("words_r").alias("b")).select("a.w", "a.digits", "a.letters", F.col("b.w").alias("b"), F.col("b.digits").alias("digits_b"), F.col("b.letters").alias("letters_b")).distinct()
    share = S.runs_share(F.col("letters"), F.col("letters_b"))
    return met.select(F.col("w").alias("a"), "b", (F.col("digits") == F.col("digits_b")).alias("same_digits"), six(share).alias("share"))


def key_matches(spark, sf_dir):
    return scoring.key_matches(_prepared(spark, sf_dir), P.gamma).select("ka", "kb", six(F.col("sim")).alias("sim"))


def feature_sim(spark, sf_dir):
    ready, pairs = _comparable(spark, sf_dir)
    return scoring.feature_scores(pairs, ready, P).select("l", "r", "m", six(F.col("feature_sim")).alias("feature_sim"))


def mw_perc(spark, sf_dir):
    ready, pairs = _comparable(spark, sf_dir)
    return scoring.feature_scores(pairs, ready, P).select("l", "r", six(F.col("mw_perc")).alias("mw_perc"))


def hybrid_dist(spark, sf_dir):
    return _distances(spark, sf_dir)[1].select("l", "r", six(F.col("dist")).alias("dist"))


def pair_components(spark, sf_dir):
    return cluster.components(_distances(spark, sf_dir)[1].filter(F.col("dist") < P.epsilon))


def clusters(spark, sf_dir):
    return pipeline.resolve(offers.products(spark, sf_dir), THRESHOLD, P)


def predicted_pairs(spark, sf_dir):
    return cluster.predicted_pairs(clusters(spark, sf_dir))


def total_comparisons(spark, sf_dir):
    return evaluate.total_comparisons(offers.products(spark, sf_dir))


def total_duplicates(spark, sf_dir):
    return evaluate.total_duplicates(offers.products(spark, sf_dir))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[six(F.col(c)).alias(c) if c in names else c for c in df.columns])


BLOCKING = ("fraction", "pair_quality", "pair_completeness", "f1_star")


def blocking_metrics(spark, sf_dir):
    ready = _prepared(spark, sf_dir)
    return _rounded(evaluate.blocking_rates(blocking.blocks(ready, THRESHOLD).all_hits(ready), ready), *BLOCKING)


def confusion(spark, sf_dir):
    ready = _prepared(spark, sf_dir)
    return _rounded(evaluate.confusion_rates(blocking.blocks(ready, THRESHOLD).comparable_hits(ready), ready), "precision", "recall", "f1")


def bootstrap_split(spark, sf_dir):
    return experiment.bootstrap(offers.products(spark, sf_dir), "1")


RUNS = ("1", "2", "3", "4", "5")


def _metrics(spark, sf_dir) -> DataFrame:
    """Blocking quality of the products outside the bag, each split being blocked on its own, at all thresholds; ``sweep_avg`` has the metrics of clusters besides, which SQL can't follow."""
    ready, rows = _prepared(spark, sf_dir), []
    for run in RUNS:
        outside = experiment.bootstrap(ready, run).filter(~F.col("in_bag")).select("product_id")
        test = cut(ready.join(outside.hint("merge"), "product_id", "left_semi"))
        hits = blocking.sets(test).hits(test.select("product_id", "model_id", F.array(F.lit(1).cast("bigint")).alias("weights")), experiment.THRESHOLDS)
        rows.append(evaluate.blocking_rates(cut(hits.drop("run")), test))
    return reduce(DataFrame.unionByName, rows)


def metric_avg(spark, sf_dir):
    return _rounded(experiment.averaged(_metrics(spark, sf_dir)), *BLOCKING)


def metric_curve(spark, sf_dir):
    return _rounded(experiment.curves(experiment.averaged(_metrics(spark, sf_dir))), "fraction", "value")


def sweep_avg(spark, sf_dir):
    """The sweep itself: all metrics at all thresholds, means of five splits, each blocked, tuned and measured on its own."""
    return _rounded(experiment.averaged(experiment.sweep(_prepared(spark, sf_dir))), *experiment.METRICS)


def sweep_curve(spark, sf_dir):
    return _rounded(experiment.curves(experiment.averaged(experiment.sweep(_prepared(spark, sf_dir)))), "fraction", "value")


def tune_epsilon(spark, sf_dir):
    """Over pairs below each cut, without clustering them, so that SQL can follow."""
    ready, d = _distances(spark, sf_dir)
    d = cut(d)
    rows = [evaluate.confusion(d.filter(F.col("dist") < e).select("l", "r"), ready).withColumn("epsilon", F.lit(e)) for e in experiment.EPSILONS]
    return _rounded(experiment.tuned(reduce(DataFrame.unionByName, rows)), "f1")


def tune_clusters(spark, sf_dir):
    """The tuning itself: clusters at each cut."""
    ready, d = _distances(spark, sf_dir)
    return _rounded(experiment.by_epsilon(ready, cut(d)), "precision", "recall", "f1")


def queries() -> dict[str, Query]:
    named = [
        src_products, clean_title, compare_title, model_words, feature_numeric_words, word_runs, brand_norm, brand_set, brand_impute,
        comparable_pairs, condensed_features, vocabulary, binary_repr, band_params, hash_family, minhash_signature, lsh_bands,
        lsh_candidates, qgram_sim, runs_lev, key_matches, feature_sim, mw_perc, hybrid_dist, pair_components, clusters,
        predicted_pairs, total_comparisons, total_duplicates, blocking_metrics, confusion, bootstrap_split, metric_avg,
        metric_curve, sweep_avg, sweep_curve, tune_epsilon, tune_clusters,
    ]
    titles = {"title_cosine": ("cosine", six), "avg_lev_sim": ("avg_lev", six), "title_veto": ("veto", lambda c: c), "title_sim": ("title_sim", six)}
    return {f.__name__: f for f in named} | {name: _title(*x) for name, x in titles.items()}
