import random
import re
from collections import defaultdict

import numpy as np

from kindred.llm import near_dedup


def brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    where, shared = defaultdict(list), defaultdict(int)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for ids in where.values():
        for a in range(len(ids)):
            for b in range(a):
                shared[ids[b], ids[a]] += 1
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def found(df, **options):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, **options).collect()), key=str)


def test_hard_rows(hard):
    assert found(hard) == brute([(r.doc_id, r.text) for r in hard.collect()])


def test_no_rows(nothing):
    assert near_dedup.near_duplicates(nothing).count() == 0
    assert near_dedup.drop_near(nothing).count() == 0


def test_one_group_around_the_threshold(spark):
    """Copies of one text with so many edits that links are of all kinds, in blocks of a few rows."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string"), block_rows=16) == brute(rows)


def test_one_group_of_sets_too_large_to_travel_whole(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(1600)]
    rows = []
    for d in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 50)):
            w[rng.randrange(1600)] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(w[: rng.choice((1600, 1000))])))
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string"), block_rows=16) == brute(rows)


def test_overlaps():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30), dtype=np.uint64)) for _ in range(50)]
    assert near_dedup.overlaps(sets[0], sets).tolist() == [len(np.intersect1d(sets[0], s)) for s in sets]
    assert not len(near_dedup.overlaps(sets[0], []))


def test_a_task_reports_less_pairs_than_it_has_members(spark):
    """A group all of whose pairs are links, each its own component: the residual step joins them inside the task."""
    rng = np.random.default_rng(10)
    for size in (300, 3000):
        core = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        rows = []
        for i in range(40):
            s = np.unique(np.concatenate([core, rng.integers(0, 1 << 63, size // 50, dtype=np.uint64)]))
            whole = len(s) <= 1 << near_dedup.FINE_BITS
            rows.append((1, 0, i, i, len(s), [7] * near_dedup.BANDS, s.view(np.int64).tolist() if whole else None, None if whole else bytearray(near_dedup.registers(s, near_dedup.FINE_BITS).tobytes()), 40))
        schema = "key bigint, band int, c bigint, comp bigint, n bigint, bands array<bigint>, shingles array<bigint>, fine binary, size bigint"
        pairs = near_dedup.residual(spark.createDataFrame(rows, schema), 75, 1024, 4.5).collect()
        assert len(pairs) == 39 and all(p.settled for p in pairs)


def test_drop_keeps_columns_and_one_of_each(hard):
    kept = near_dedup.drop_near(hard)
    assert kept.columns == hard.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({r[0] for r in brute([(r.doc_id, r.text) for r in hard.collect()]) if r[3] and r[0] is not None})


def test_margin_misses_nothing():
    rng = np.random.default_rng(5)
    for n in (6, 30, 146, 900):
        for _ in range(100):
            k = next(k for k in range(n + 1) if 100 * k >= 75 * (2 * n - k))
            x = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
            rng.shuffle(x)
            a, b = np.sort(x[:n]), np.sort(x[n - k : 2 * n - k])
            value, rests_on = near_dedup.estimate(near_dedup.registers(a, 10), near_dedup.registers(b, 10)[None], n, np.array([n]))
            assert value[0] >= 0.75 - near_dedup.margin(np.array([2 * n]), rests_on, 0.75, 4.5)[0]
