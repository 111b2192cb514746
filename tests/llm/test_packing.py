import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kindred.llm import packing


def test_pieces_hold_every_id_once(hard):
    whole = Tokenizer.from_file(packing.vocabulary_file())
    rows = packing.pack_documents(hard, payload=("ids", "ids_crc32"), capacity=256, group_rows=16).collect()
    docs = defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length <= 256
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        docs[(r.doc_id, r.doc_tokens)].append((r.start, r.ids))
    want = defaultdict(int)
    for r in hard.collect():
        want[(r.doc_id, tuple([*whole.encode(r.text or "", add_special_tokens=False).ids, 1]))] += 1
    for (d, ids), times in want.items():
        cut = sorted(docs[(d, len(ids))])
        for start, part in cut:
            assert tuple(part) == ids[start : start + len(part)]
        assert sum(len(p) for _, p in cut) == len(ids) * times
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256


def test_no_rows(nothing):
    assert packing.pack_documents(nothing).count() == 0


def test_sequences_join_their_pieces(hard):
    packed = packing.pack_documents(hard, capacity=512)
    made = packing.sequences(packed, capacity=512).collect()
    assert sum(r.tokens for r in made) == sum(r.length for r in packed.collect())
    assert all(len(r.ids) == r.tokens and r.padded_length in (r.tokens, 512) for r in made)


@settings(deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=80))
def test_tournament_tree_is_first_fit(lengths):
    lengths = np.sort(np.array(lengths))[::-1]
    where, offset = packing.first_fit_decreasing(lengths, 100)
    bins: list[int] = []
    for size, w, o in zip(lengths.tolist(), where.tolist(), offset.tolist()):
        first = next((i for i, used in enumerate(bins) if used + size <= 100), len(bins))
        if first == len(bins):
            bins.append(0)
        assert (w, o) == (first, bins[first])
        bins[first] += size


def test_padding_is_small(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "repeat('some words here ', cast(id % 300 as int)) as text")
    packed = packing.pack_documents(df, payload=("ids_crc32",))
    made = packed.groupBy("sequence_id").sum("length").collect()
    used = sum(r[1] for r in made)
    assert 1 - used / (2048 * len(made)) < 0.02
