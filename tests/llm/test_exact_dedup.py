import hashlib
import re
from collections import defaultdict

import pytest

from kindred.llm import exact_dedup


def expected(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    out = []
    for t, ids in groups.items():
        keep = min((d for d in ids if d is not None), default=None)
        out += [(d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_marks_agree_with_brute_force(spark, hard, limit):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    got = exact_dedup.mark_exact(hard, broadcast_bytes=limit).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_one_row_of_each_group_stays(hard, limit):
    kept = exact_dedup.drop_exact(hard, broadcast_bytes=limit)
    assert kept.columns == hard.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in got]
    every = {re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in hard.collect()}
    assert sorted(texts) == sorted(every)
    assert next(d for d, t in got if t and t.startswith("word0 word1 word2 word3 word4 word5 word6 word7 ")) == 1


def test_no_rows(nothing):
    assert exact_dedup.mark_exact(nothing).count() == 0
    assert exact_dedup.drop_exact(nothing).count() == 0


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_only_repeated_texts_are_grouped(spark, limit):
    df = spark.range(9000).selectExpr("id as doc_id", "concat('text ', if(id < 1000, 0, id % 8900)) as text")
    hashes = df.selectExpr("xxhash64(text) as h")
    assert exact_dedup.repeated_slots(hashes, "h", exact_dedup.blocks_of(9000, 16)).count() > 1  # so the smaller limit takes the path of large filters
    bitmaps, blocks = exact_dedup.repeated_filter(hashes, "h", 16, limit)
    flagged = exact_dedup.maybe_repeated(hashes, hashes.h, bitmaps, blocks, "maybe").filter("maybe").count()
    assert 1000 <= flagged < 1400
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(map(tuple, exact_dedup.mark_exact(df, broadcast_bytes=limit).collect()), key=str) == expected(rows)
    assert sorted(r.doc_id for r in exact_dedup.drop_exact(df, broadcast_bytes=limit).collect()) == sorted({k for d, k, *_ in expected(rows)})
