"""The same results in DuckDB SQL: a chain of common table expressions, of which each query reads one."""

from __future__ import annotations

import re

from kindred.functions import text as T
from kindred.functions.similarity import Parameters
from kindred.operators import brands, experiment
from kindred.plans.queries import RUNS, THRESHOLD
from kindred.sources.offers import FEATURES, OFFERS

P = Parameters()
SHAPED, DRAWN = (0.3, 0.5, 0.7), ("1", "2")  # bands and splits of the whole table that are worked out for the queries that read one of them


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _replaced(expr: str, rules) -> str:
    for old, new in rules:
        expr = f"replace({expr}, {_quoted(old)}, {_quoted(new)})"
    return expr


def _six(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def _tokens(x: str) -> str:
    return rf"list_distinct(list_filter(string_split_regex({x}, '\s+'), lambda t: t <> ''))"


def _words(x: str) -> str:
    return f"list_filter({_tokens(x)}, lambda w: regexp_matches(w, {_quoted(T.MODEL_WORD)}))"


def _grams(x: str) -> str:
    return f"CASE WHEN length({x}) >= 3 THEN list_transform(range(1, length({x}) - 1), lambda i: substr({x}, i, 3)) ELSE [] END"


def _sim(source: str, keys: str = "") -> str:
    """Adds sim to a relation with texts a and b."""
    return rf"""SELECT *, CASE WHEN sa + sb = 0 THEN 0.0 ELSE (sa + sb - d) / (sa + sb)::DOUBLE END AS sim FROM (
      SELECT *, len(list_distinct(ga)) AS sa, len(list_distinct(gb)) AS sb,
        CASE WHEN a = b THEN 0 ELSE coalesce(list_sum(list_transform(list_distinct(list_concat(qa, qb)), lambda k: abs(len(list_filter(qa, lambda x: x = k)) - len(list_filter(qb, lambda y: y = k))))), 0) END AS d
      FROM (SELECT *, {_grams("a")} AS ga, {_grams("b")} AS gb, {_grams("ra")} AS qa, {_grams("rb")} AS qb
            FROM (SELECT *, regexp_replace(a, '\s+', ' ', 'g') AS ra, regexp_replace(b, '\s+', ' ', 'g') AS rb FROM ({source}))))"""


def _share(a: str, b: str) -> str:
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 0.0 ELSE levenshtein({a}, {b}) / greatest(length({a}), length({b}))::DOUBLE END"


def _runs(w: str, kind: str) -> str:
    return f"regexp_extract_all({w}, '({kind}+)', 1)"


def _runs_share(a: str, b: str) -> str:
    oa, ob = _runs(a, "[^0-9]"), _runs(b, "[^0-9]")
    both = f"list_concat({oa}, {ob})"
    coded = lambda x: f"coalesce(list_aggregate(list_transform({x}, lambda e: chr(64 + list_position({both}, e)::INTEGER)), 'string_agg', ''), '')"
    return _share(coded(oa), coded(ob))


CHAIN: dict[str, str] = {
    "offers": OFFERS,
    "feats": FEATURES,
    "cleaned": f"SELECT product_id, model_id, shop, {_replaced(f'lower({_replaced("title", T.TITLE_RULES)})', T.LOWERED_RULES)} AS title FROM offers",
    "brand0": f"""SELECT product_id, CASE b {' '.join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in brands.SPELLINGS.items())} ELSE b END AS brand
      FROM (SELECT o.product_id, lower(coalesce(max(v), {_quoted(brands.MISSING)})) AS b FROM offers o LEFT JOIN feats f ON f.product_id = o.product_id AND k = 'Brand' GROUP BY 1)""",
    "brands": f"SELECT DISTINCT brand FROM (SELECT brand FROM brand0 WHERE brand <> {_quoted(brands.MISSING)} UNION ALL SELECT unnest([{', '.join(map(_quoted, brands.KNOWN))}]))",
    "imputed": f"""SELECT product_id, brand FROM (SELECT c.product_id, s.brand, row_number() OVER (PARTITION BY c.product_id ORDER BY length(s.brand) DESC, s.brand) AS n
      FROM cleaned c JOIN brand0 b ON c.product_id = b.product_id AND b.brand = {_quoted(brands.MISSING)} JOIN brands s ON contains(c.title, s.brand)) WHERE n = 1""",
    "prods": "SELECT c.product_id, c.model_id, c.shop, c.title, coalesce(i.brand, b.brand) AS brand FROM cleaned c JOIN brand0 b USING (product_id) LEFT JOIN imputed i USING (product_id)",
    "bfeats": "SELECT product_id, k, v FROM feats WHERE k <> 'Brand' UNION ALL SELECT product_id, 'Brand', brand FROM prods",
    "phys": "SELECT product_id, k, v FROM bfeats WHERE " + " OR ".join(f"contains(lower(k), {_quoted(x)})" for x in T.PHYSICAL),
    "tw": f"SELECT product_id, unnest({_words('title')}) AS word FROM prods",
    "vw": f"SELECT DISTINCT product_id, regexp_replace(word, '[^0-9.]', '', 'g') AS word FROM (SELECT product_id, unnest({_tokens('v')}) AS word FROM phys) WHERE regexp_matches(word, {_quoted(T.NUMBER_WORD)})",
    "vocab": "SELECT row_number() OVER (ORDER BY word) AS idx, word FROM (SELECT word FROM tw UNION SELECT word FROM vw)",
    "texts": "SELECT product_id, title AS text FROM prods UNION ALL SELECT product_id, v FROM phys",
    "bits": "SELECT DISTINCT product_id, idx FROM texts JOIN vocab ON contains(text, word)",
    "vs": "SELECT count(*) AS v, CAST(round_even(count(*) * 0.5, 0) AS BIGINT) AS s FROM vocab",
    "prime": "SELECT min(v + k) AS p FROM vs, range(501, 1500) r(k) WHERE NOT EXISTS (SELECT 1 FROM range(2, 400) d(x) WHERE (v + k) % x = 0 AND x < v + k)",
    "rows_": f"""SELECT t, r FROM (SELECT t, r, row_number() OVER (PARTITION BY t ORDER BY abs(pow(r / s::DOUBLE, 1.0::DOUBLE / r) - t), r) AS n
      FROM vs, range(1, 5000) x(r), (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in experiment.THRESHOLDS)}]) AS t) WHERE r < s) WHERE n = 1""",
    "shape": "SELECT t, v, s, p, r, s // r AS b FROM rows_, vs, prime",
    "hashes": "SELECT j, (j * 7919) % 99999999 + 104730 AS a, (j * 15485863 + 32452843) % 99999999 + 1 AS b FROM vs, range(0, 5000) x(j) WHERE j < s",
    "sig": "SELECT product_id, j, min((b * idx + a) % p) AS v FROM bits, hashes, prime GROUP BY 1, 2",
    "banded": """SELECT t, product_id, band, string_agg(v::VARCHAR, '-' ORDER BY j) AS key FROM (
      SELECT t, product_id, j, sig.v, CASE WHEN j < (s % b) * (s // b + 1) THEN j // (s // b + 1) ELSE (s % b) + (j - (s % b) * (s // b + 1)) // (s // b) END AS band FROM sig, shape WHERE t IN ({swept}))
      GROUP BY 1, 2, 3""".format(swept=", ".join(map(str, SHAPED))),
    "found": "SELECT DISTINCT a.t, a.product_id AS l, b.product_id AS r FROM banded a JOIN banded b ON a.t = b.t AND a.band = b.band AND a.key = b.key AND a.product_id < b.product_id",
    "cand": f"SELECT l, r FROM found WHERE t = {THRESHOLD}",
    "comp": f"SELECT l, r FROM cand JOIN prods a ON l = a.product_id JOIN prods b ON r = b.product_id WHERE (a.brand = b.brand OR a.brand = {_quoted(brands.MISSING)} OR b.brand = {_quoted(brands.MISSING)}) AND a.shop <> b.shop",
    "shown": f"SELECT product_id, {_tokens('x')} AS tokens, {_words('x')} AS words FROM (SELECT product_id, {_replaced('title', T.COMPARE_RULES)} AS x FROM prods)",
    "wordlist": "SELECT DISTINCT unnest(words) AS w FROM shown",
    "wordpairs": f"""SELECT a.w AS x, b.w AS y, {_share('a.w', 'b.w')} AS share, length(a.w) + length(b.w) AS size,
      {_runs('a.w', '[0-9]')} = {_runs('b.w', '[0-9]')} AS same, {_runs_share('a.w', 'b.w')} < {P.word} AS alike FROM wordlist a, wordlist b""",
    "met": """SELECT l, r, x, y, share, size, same, alike FROM (SELECT l, r, wa, unnest(b.words) AS wb FROM (SELECT l, r, unnest(a.words) AS wa FROM comp JOIN shown a ON l = a.product_id) JOIN shown b ON r = b.product_id)
      JOIN wordpairs ON wa = x AND wb = y""",
    "worded": "SELECT l, r, sum((1 - share) * size) / sum(size) AS f, bool_or(alike AND NOT same) AS veto, sum((1 - share) * size) FILTER (alike AND same) / sum(size) FILTER (alike AND same) AS g FROM met GROUP BY 1, 2",
    "cosines": "SELECT l, r, CASE WHEN len(a.tokens) * len(b.tokens) = 0 THEN 0.0 ELSE len(list_intersect(a.tokens, b.tokens)) / (sqrt(len(a.tokens)) * sqrt(len(b.tokens))) END AS cosine FROM comp JOIN shown a ON l = a.product_id JOIN shown b ON r = b.product_id",
    "titles": f"""SELECT l, r, cosine, avg_lev, veto, CASE WHEN cosine > {P.alpha} THEN 1.0 WHEN veto THEN -1.0 WHEN g IS NULL THEN f ELSE {P.delta} * g + (1 - {P.delta}) * f END AS title_sim
      FROM (SELECT l, r, cosine, coalesce(w.f, 0.0) AS avg_lev, coalesce(veto, false) AS veto, g, {P.beta} * cosine + (1 - {P.beta}) * coalesce(w.f, 0.0) AS f FROM cosines LEFT JOIN worded w USING (l, r))""",
    "keypairs": f"SELECT a AS ka, b AS kb, sim FROM ({_sim('SELECT x.k AS a, y.k AS b FROM (SELECT DISTINCT k FROM bfeats) x, (SELECT DISTINCT k FROM bfeats) y')}) WHERE sim > {P.gamma}",
    "entries": "SELECT l, r, ka, kb, sim, a.v AS va, b.v AS vb FROM comp JOIN bfeats a ON l = a.product_id JOIN keypairs ON a.k = ka JOIN bfeats b ON r = b.product_id AND b.k = kb",
    "values_": f"SELECT a AS va, b AS vb, sim AS value_sim FROM ({_sim('SELECT DISTINCT va AS a, vb AS b FROM entries')})",
    "fsum": "SELECT l, r, count(*) AS m, sum(sim * value_sim) / sum(sim) AS feature_sim FROM entries JOIN values_ USING (va, vb) GROUP BY 1, 2",
    "rest": f"""SELECT DISTINCT l, r, side, unnest({_words('v')}) AS word FROM (
      SELECT l, r, 'l' AS side, v FROM comp JOIN bfeats f ON l = product_id WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.l = comp.l AND e.r = comp.r AND e.ka = f.k)
      UNION ALL SELECT l, r, 'r', v FROM comp JOIN bfeats f ON r = product_id WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.l = comp.l AND e.r = comp.r AND e.kb = f.k))""",
    "restsum": """SELECT l, r, sum(a) AS na, sum(b) AS nb, count(*) FILTER (a + b = 2) AS both_ FROM (
      SELECT l, r, word, count(*) FILTER (side = 'l') AS a, count(*) FILTER (side = 'r') AS b FROM rest GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "nkeys": "SELECT product_id, count(*) AS n FROM bfeats GROUP BY 1",
    "fscores": """SELECT l, r, coalesce(m, 0) AS m, coalesce(feature_sim, 0.0) AS feature_sim, CASE WHEN na > 0 AND nb > 0 THEN 2 * both_ / (na + nb)::DOUBLE ELSE 0.0 END AS mw_perc, least(a.n, b.n) AS k
      FROM comp LEFT JOIN fsum USING (l, r) LEFT JOIN restsum USING (l, r) JOIN nkeys a ON l = a.product_id JOIN nkeys b ON r = b.product_id""",
    "dists": f"""SELECT l, r, 1 - CASE WHEN title_sim = -1 THEN h * feature_sim + (1 - h) * mw_perc
      ELSE (1 - {P.mu}) * h * feature_sim + (1 - {P.mu} - (1 - {P.mu}) * h) * mw_perc + {P.mu} * title_sim END AS dist
      FROM (SELECT *, m / greatest(k, 1)::DOUBLE AS h FROM titles JOIN fscores USING (l, r))""",
    "edges": f"SELECT l AS u, r AS v FROM dists WHERE dist < {P.epsilon} UNION ALL SELECT r, l FROM dists WHERE dist < {P.epsilon}",
    "reach": "SELECT DISTINCT u, u AS v FROM edges UNION SELECT reach.u, e.v FROM reach JOIN edges e ON reach.v = e.u",
    "nall": "SELECT count(*) AS n FROM offers",
    "places": "SELECT product_id, row_number() OVER (ORDER BY product_id) - 1 AS place FROM offers",
    "runs": f"SELECT unnest([{', '.join(map(_quoted, DRAWN))}]) AS run",
    "draws": "SELECT DISTINCT run, CAST('0x' || substr(md5(run || '-' || place::VARCHAR), 1, 7) AS BIGINT) % n AS place FROM places, nall, runs",
    "split": "SELECT run, product_id, d.place IS NOT NULL AS in_bag FROM (SELECT * FROM places, runs) p LEFT JOIN draws d USING (run, place)",
    "mruns": f"SELECT unnest([{', '.join(map(_quoted, RUNS))}]) AS run",
    "mdraws": "SELECT DISTINCT run, CAST('0x' || substr(md5(run || '-' || place::VARCHAR), 1, 7) AS BIGINT) % n AS place FROM places, nall, mruns",
    "outside": "SELECT run, product_id, model_id FROM (SELECT p.run, product_id FROM (SELECT * FROM places, mruns) p LEFT JOIN mdraws d ON p.run = d.run AND p.place = d.place WHERE d.place IS NULL) JOIN offers USING (product_id)",
    "ovocab": """SELECT run, word, row_number() OVER (PARTITION BY run ORDER BY word) AS idx FROM (
      SELECT run, word FROM outside JOIN tw USING (product_id) UNION SELECT run, word FROM outside JOIN vw USING (product_id))""",
    "obits": "SELECT DISTINCT o.run, o.product_id, w.idx FROM outside o JOIN texts x ON o.product_id = x.product_id JOIN ovocab w ON o.run = w.run AND contains(x.text, w.word)",
    "ovs": "SELECT run, count(*) AS v, CAST(round_even(count(*) * 0.5, 0) AS BIGINT) AS s FROM ovocab GROUP BY 1",
    "oprime": "SELECT run, min(v + k) AS p FROM ovs, range(501, 1500) y(k) WHERE NOT EXISTS (SELECT 1 FROM range(2, 400) d(x) WHERE (v + k) % x = 0 AND x < v + k) GROUP BY 1",
    "oshape": f"""SELECT run, t, s, s // r AS b FROM (SELECT run, t, r, s, row_number() OVER (PARTITION BY run, t ORDER BY abs(pow(r / s::DOUBLE, 1.0::DOUBLE / r) - t), r) AS n
      FROM ovs, range(1, 5000) x(r), (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in experiment.THRESHOLDS)}]) AS t) WHERE r < s) WHERE n = 1""",
    "osig": """SELECT run, product_id, j, min((((j * 15485863 + 32452843) % 99999999 + 1) * idx + (j * 7919) % 99999999 + 104730) % p) AS v
      FROM obits JOIN ovs USING (run) JOIN oprime USING (run) JOIN range(0, 5000) x(j) ON j < s GROUP BY 1, 2, 3""",
    "obanded": """SELECT run, t, product_id, band, string_agg(v::VARCHAR, '-' ORDER BY j) AS key FROM (
      SELECT g.run, t, product_id, j, v, CASE WHEN j < (s % b) * (s // b + 1) THEN j // (s // b + 1) ELSE (s % b) + (j - (s % b) * (s // b + 1)) // (s // b) END AS band FROM osig g JOIN oshape h ON g.run = h.run)
      GROUP BY 1, 2, 3, 4""",
    "ofound": "SELECT DISTINCT a.run, a.t, a.product_id AS l, b.product_id AS r FROM obanded a JOIN obanded b ON a.run = b.run AND a.t = b.t AND a.band = b.band AND a.key = b.key AND a.product_id < b.product_id",
    "size_": "SELECT run, count(*) * (count(*) - 1) / 2 AS comparisons FROM outside GROUP BY 1",
    "dup_": "SELECT run, sum(n * (n - 1) / 2) AS duplicates FROM (SELECT run, model_id, count(*) AS n FROM outside GROUP BY 1, 2) GROUP BY 1",
    "hit_": "SELECT t, a.run, count(*) AS hits, count(*) FILTER (a.model_id = b.model_id) AS same FROM ofound f JOIN outside a ON f.run = a.run AND l = a.product_id JOIN outside b ON f.run = b.run AND r = b.product_id GROUP BY 1, 2",
    "each_": "SELECT t, run, coalesce(hits, 0) / comparisons AS fraction, coalesce(same / nullif(hits, 0)::DOUBLE, 0.0) AS pq, coalesce(same / nullif(duplicates, 0), 0.0) AS pc FROM oshape LEFT JOIN hit_ USING (t, run) JOIN size_ USING (run) JOIN dup_ USING (run)",
    "avg_": "SELECT t, avg(fraction) AS fraction, avg(pq) AS pair_quality, avg(pc) AS pair_completeness, avg(CASE WHEN pq + pc > 0 THEN 2 * pq * pc / (pq + pc) ELSE 0.0 END) AS f1_star FROM each_ GROUP BY 1",
    "dups": "SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM offers GROUP BY model_id)",
    "allpairs": "SELECT count(*) * (count(*) - 1) // 2 AS comparisons FROM offers",
}

_MODELS = "JOIN offers a ON l = a.product_id JOIN offers b ON r = b.product_id"
_F1 = "CASE WHEN pq + pc > 0 THEN 2 * pq * pc / (pq + pc) ELSE 0.0 END"


def _confusion(pairs: str) -> str:
    return f"SELECT tp, fp, duplicates - tp AS fn, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0.0) AS pq, coalesce(tp / nullif(duplicates, 0)::DOUBLE, 0.0) AS pc FROM (SELECT count(*) FILTER (a.model_id = b.model_id) AS tp, count(*) FILTER (a.model_id <> b.model_id) AS fp FROM ({pairs}) {_MODELS}), dups"


_TUNE = " UNION ALL ".join(f"SELECT {e}::DOUBLE AS epsilon, {_F1} AS f1 FROM ({_confusion(f'SELECT l, r FROM dists WHERE dist < {e}')})" for e in experiment.EPSILONS)
_LAST: dict[str, str] = {
    "src_products": "SELECT o.product_id, model_id, shop, title, (SELECT count(*) FROM feats f WHERE f.product_id = o.product_id) AS n_features FROM offers o",
    "clean_title": "SELECT product_id, title AS clean_title FROM cleaned",
    "compare_title": f"SELECT product_id, {_replaced('title', T.COMPARE_RULES)} AS compare_title FROM cleaned",
    "model_words": "SELECT product_id, word FROM tw",
    "feature_numeric_words": "SELECT product_id, word FROM vw",
    "word_runs": f"SELECT word, coalesce(list_aggregate({_runs('word', '[0-9]')}, 'string_agg', '|'), '') AS digits, coalesce(list_aggregate({_runs('word', '[^0-9]')}, 'string_agg', '|'), '') AS others FROM (SELECT DISTINCT word FROM tw)",
    "brand_norm": "SELECT product_id, brand FROM brand0",
    "brand_set": "SELECT brand FROM brands",
    "brand_impute": "SELECT product_id, brand, brand AS feature FROM prods",
    "comparable_pairs": "SELECT l, r FROM comp",
    "condensed_features": "SELECT product_id, k, v FROM phys",
    "vocabulary": "SELECT idx, word FROM vocab",
    "binary_repr": "SELECT product_id, idx FROM bits",
    "band_params": "SELECT t, v, s, p, r, b FROM shape",
    "hash_family": "SELECT j, a, b FROM hashes",
    "minhash_signature": "SELECT product_id, j, v FROM sig",
    "lsh_bands": f"SELECT product_id, band, key FROM banded WHERE t = {THRESHOLD}",
    "lsh_candidates": "SELECT l, r FROM cand",
    "qgram_sim": f"SELECT k, a, b, {_six('sim')} AS sim FROM ({_sim('SELECT x.k, x.v AS a, y.v AS b FROM (SELECT DISTINCT k, v FROM feats) x JOIN (SELECT DISTINCT k, v FROM feats) y ON x.k = y.k WHERE x.k <> ' + _quoted('Brand'))})",
    "runs_lev": f"SELECT a, b, {_runs('a', '[0-9]')} = {_runs('b', '[0-9]')} AS same_digits, {_six(_runs_share('a', 'b'))} AS share FROM (SELECT DISTINCT x AS a, y AS b FROM met)",
    "title_cosine": f"SELECT l, r, {_six('cosine')} AS cosine FROM titles",
    "avg_lev_sim": f"SELECT l, r, {_six('avg_lev')} AS avg_lev FROM titles",
    "title_veto": "SELECT l, r, veto FROM titles",
    "title_sim": f"SELECT l, r, {_six('title_sim')} AS title_sim FROM titles",
    "key_matches": f"SELECT ka, kb, {_six('sim')} AS sim FROM keypairs",
    "feature_sim": f"SELECT l, r, m, {_six('feature_sim')} AS feature_sim FROM fscores",
    "mw_perc": f"SELECT l, r, {_six('mw_perc')} AS mw_perc FROM fscores",
    "hybrid_dist": f"SELECT l, r, {_six('dist')} AS dist FROM dists",
    "pair_components": "SELECT u AS product_id, min(v) AS component FROM reach GROUP BY 1",
    "total_comparisons": "SELECT comparisons FROM allpairs",
    "total_duplicates": "SELECT duplicates FROM dups",
    "blocking_metrics": f"""SELECT {_six('fraction')} AS fraction, {_six('pq')} AS pair_quality, {_six('pc')} AS pair_completeness, {_six(_F1)} AS f1_star
      FROM (SELECT pairs / comparisons::DOUBLE AS fraction, found / pairs::DOUBLE AS pq, found / duplicates::DOUBLE AS pc FROM (SELECT count(*) AS pairs, count(*) FILTER (a.model_id = b.model_id) AS found FROM cand {_MODELS}), dups, allpairs)""",
    "confusion": f"SELECT tp, fp, fn, {_six('pq')} AS precision, {_six('pc')} AS recall, {_six(_F1)} AS f1 FROM ({_confusion('SELECT l, r FROM comp')})",
    "bootstrap_split": "SELECT product_id, in_bag FROM split WHERE run = '1'",
    "metric_avg": f"SELECT t, {', '.join(f'{_six(m)} AS {m}' for m in ('fraction', 'pair_quality', 'pair_completeness', 'f1_star'))} FROM avg_",
    "metric_curve": f"SELECT t, metric, {_six('fraction')} AS fraction, {_six('value')} AS value FROM (SELECT t, fraction, unnest(['pair_quality', 'pair_completeness', 'f1_star']) AS metric, unnest([pair_quality, pair_completeness, f1_star]) AS value FROM avg_)",
    "tune_epsilon": f"SELECT epsilon, {_six('f1')} AS f1 FROM ({_TUNE}) ORDER BY f1 DESC, epsilon LIMIT 1",
}


#: Read several times, or at the seam of two large joins: worked out once, in this order.
WRITTEN = ("prods", "bfeats", "vocab", "sig", "banded", "cand", "comp", "shown", "wordpairs", "keypairs", "entries", "dists", "outside", "ovocab", "osig", "obanded")


def _needed(sql: str) -> list[str]:
    """The names of the chain that a query reads, directly or through others, in order."""
    found, left = set(), [sql]
    while left:
        text = left.pop()
        more = [n for n in CHAIN if n not in found and re.search(rf"\b{n}\b", text)]
        found.update(more)
        left += [CHAIN[n] for n in more]
    return [n for n in CHAIN if n in found]


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, last in _LAST.items():
        chain = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in WRITTEN else ''}({CHAIN[n]})" for n in _needed(last))
        out[name] = f"WITH RECURSIVE {chain}\n{last}"
    return out
