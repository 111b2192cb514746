import re

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from kindred.llm import packing, pii, quality, queries
from tests.llm.test_near_dedup import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, hard):
    docs = hard
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.filter("doc_id in (2, 10)").count() == 0
    assert docs.filter("doc_id = 11").first().n_chars == len("é 中 😀 mail [EMAIL] [PHONE]")
    assert corpus_pipeline.STAGES[4][1](spark, docs, "").count() >= docs.count()


def test_hard_and_empty_tables(spark, hard, nothing, tmp_path):
    for name, docs in (("hard", hard), ("nothing", nothing)):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1), (6, 1), (None, 1), (12, None)], "doc_id bigint, quality int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        kept = corpus_pipeline.STAGES[0][1](spark, docs, folder)
        assert kept.columns == docs.columns
        packed = corpus_pipeline.run(spark, folder).collect()
        assert all(len(r.ids) == r.length for r in packed)
        assert bool(packed) == (name == "hard")


def test_run_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    good = []
    for r in rows:  # one document at a time, by the plain formula
        x = model.scaled(quality.encode([r.text or ""])[0])
        H = np.tanh(x @ model.W + model.b)
        e = (np.tanh(H @ model.V) / (1 + np.exp(-(H @ model.U)))) @ model.w
        a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        if 1 / (1 + np.exp(-((a @ H) @ model.c + model.d[0]))) >= 0.3:
            good.append((r.doc_id, r.text))
    first = {}
    for d, t in good:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (d, t))
    single = sorted(first.values())
    marks = {d: kept for d, _, _, kept in brute(single)}
    single = [(d, t) for d, t in single if marks[d]]
    # base spans are held against brute force in test_pii; here the text around them
    spans = {r.doc_id: [tuple(s) for s in r.pii_spans] for r in pii.find_spans(spark.createDataFrame(single, "doc_id bigint, text string")).collect()}
    whole = Tokenizer.from_file(packing.vocabulary_file())
    want = {}
    for d, t in single:
        out, at, end = [], 0, 0
        for kind, s, e in sorted(spans[d], key=lambda c: (c[1], c[2])):
            if s >= end:
                out.append((t or "")[at:s] + f"[{pii.KINDS[kind].upper()}]")
            at = end = max(end, e)
        text = "".join(out) + (t or "")[at:]
        want[d] = [*whole.encode(text, add_special_tokens=False).ids, 1]
    got, places = {}, {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.ids))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {d: [i for _, ids in sorted(p) for i in ids] for d, p in got.items()} == want
    for held in places.values():
        held.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and held[0][0] == 0 and sum(held[-1]) <= 2048


def test_registry():
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 11))
