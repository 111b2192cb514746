import zlib
from collections import Counter, defaultdict

from kindred.llm import sharding


def check(df, shards=8):
    rows = sharding.shard_documents(df, n_shards=shards).collect()
    counts = Counter(r.shard for r in rows)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    return rows


def test_hard_rows(hard):
    check(hard)


def test_no_rows(nothing):
    assert sharding.shard_documents(nothing).count() == 0


def test_copies_stay_together_and_a_hot_text_is_spread(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' else concat('t', id div 6) end as text")
    rows = check(df)
    shards = defaultdict(set)
    for r in rows:
        shards[r.text_crc32].add(r.shard)
    split = sum(len(s) > 1 for s in shards.values())
    assert split <= 0.25 * len(shards)
    assert len(shards[zlib.crc32(b"hot")]) >= 3


def test_a_hot_text_gets_more_cells(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SALTS", 2)
    df = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' else concat('t', id div 6) end as text")
    rows = sharding.shard_documents(df, bucket_rows=20).collect()
    sizes = [sum(r.shard == s for r in rows) for s in range(8)]
    assert len(rows) == 3000 and max(sizes) - min(sizes) <= 1
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
