"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes, and only the document has
a label. Every passage is encoded (byte and hashed byte-trigram histograms and a
few figures of style, through a learnt layer); a gated attention layer, learnt
from the documents' labels alone, weighs the passages; the weighted sum is
scored by a logistic unit. All passages of a document count, however many.

Training takes at most ``max_train`` labelled documents of ``max_train_bytes``
in all, the first in a hashed order of their keys, and runs in one task; scoring
reads every row.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.store import arrow_rows, col, fresh, slices

PASSAGE = 1024  # bytes
GRAMS = 512
STYLE = 6
WIDTH = 256 + GRAMS + STYLE


def encode(texts: list[str], most: int = 256 * PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of the texts, and each text's first passage (with the end). An empty text is one empty passage.

    Passages are encoded on their own, about ``most`` bytes at a time, so a very
    long text needs no more room than its features.
    """
    raw = [t.encode("utf-8", "replace") for t in texts]
    first = np.concatenate([[0], np.cumsum([max(1, -(-len(r) // PASSAGE)) for r in raw])])
    cuts = [r[i : i + most] for r in raw for i in range(0, max(1, len(r)), most)]
    out, at = [], 0
    while at < len(cuts):
        end, held = at, 0
        while end < len(cuts) and (end == at or held + len(cuts[end]) <= most):
            held += len(cuts[end])
            end += 1
        out.append(_encoded(cuts[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros((0, WIDTH), np.float32), first


def _encoded(raw: list[bytes]) -> np.ndarray:
    size = np.array([len(r) for r in raw], np.int64)
    count = np.maximum(1, -(-size // PASSAGE))
    first = np.concatenate([[0], np.cumsum(count)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    n = int(first[-1])
    doc = np.repeat(np.arange(len(raw)), size)
    at = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
    passage = first[doc] + at // PASSAGE
    wide = data.astype(np.int64)
    single = np.bincount(passage * 256 + wide, minlength=n * 256).reshape(n, 256).astype(np.float32)
    length = np.maximum(1, single.sum(1, keepdims=True))
    if len(data) > 2:
        gram = (wide[:-2] * 0x9E3779B1 + wide[1:-1] * 0x85EBCA77 + wide[2:] * 0xC2B2AE3D) >> 11
        inside = passage[:-2] == passage[2:]
        gram, of = gram[inside], passage[:-2][inside]
        triple = np.bincount(of * GRAMS + (gram & (GRAMS - 1)), minlength=n * GRAMS).reshape(n, GRAMS).astype(np.float32)
        distinct = np.zeros(n, np.float32)
        for lo in range(0, n, 512):  # passages at a time, so that the table of what was seen stays small
            i, j = np.searchsorted(of, (lo, lo + 512))
            seen = np.zeros((min(512, n - lo), 4096), bool)
            seen[of[i:j] - lo, (gram[i:j] >> 9) & 4095] = True
            distinct[lo : lo + 512] = seen.sum(1)
    else:
        triple, distinct = np.zeros((n, GRAMS), np.float32), np.zeros(n, np.float32)
    share = single / length
    upper, lower, digit = share[:, 65:91].sum(1), share[:, 97:123].sum(1), share[:, 48:58].sum(1)
    marks = share[:, 33:48].sum(1) + share[:, 58:65].sum(1) + share[:, 91:97].sum(1)
    style = np.stack([upper, lower, digit, marks, distinct / length[:, 0], np.log1p(single.sum(1)) / 7], 1).astype(np.float32)
    return np.concatenate([np.sqrt(share), np.sqrt(triple / length), style], 1)


def _moments(x: np.ndarray, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every column, some rows at a time."""
    total, square = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for at in range(0, len(x), rows):
        part = x[at : at + rows].astype(float)
        total += part.sum(0)
        square += (part * part).sum(0)
    mean = total / len(x)
    return mean.astype(np.float32), np.sqrt(np.maximum(0, square / len(x) - mean * mean)).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    W: np.ndarray
    b: np.ndarray
    V: np.ndarray
    U: np.ndarray
    w: np.ndarray
    c: np.ndarray
    d: np.ndarray

    LEARNT = ("W", "b", "V", "U", "w", "c", "d")

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f.name: getattr(self, f.name) for f in fields(self)})
        return out.getvalue()

    @staticmethod
    def load(made: bytes) -> Model:
        with np.load(io.BytesIO(made)) as held:
            return Model(**{f.name: held[f.name] for f in fields(Model)})

    @staticmethod
    def fresh(x: np.ndarray, hidden: int = 32, gate: int = 16, seed: int = 3) -> Model:
        rng = np.random.default_rng(seed)
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        z = np.zeros
        f = np.float32
        mean, std = _moments(x)
        return Model(mean, std + f(1e-3), draw(x.shape[1], hidden), z(hidden, f), draw(hidden, gate), draw(hidden, gate), draw(gate, 1)[:, 0], draw(hidden, 1)[:, 0], z(1, f))

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """x: scaled features; first: where each document's passages begin, with the end."""
        H = np.tanh(x @ self.W + self.b)
        A, G = np.tanh(H @ self.V), 1 / (1 + np.exp(-(H @ self.U)))
        e = (A * G) @ self.w
        start, count = first[:-1], np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, start), count))
        a = e / np.repeat(np.add.reduceat(e, start), count)
        z = np.add.reduceat(a[:, None] * H, start)
        return {"H": H, "A": A, "G": G, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ self.c + self.d, -30, 30)))}

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        f = self.forward(x, first)
        start, count = first[:-1], np.diff(first)
        spread = lambda v: np.repeat(v, count, axis=0)
        ds = ((f["p"] - y) / len(y)).astype(np.float32)
        dz = spread(ds[:, None] * self.c)
        dH = f["a"][:, None] * dz
        da = (f["H"] * dz).sum(1)
        de = f["a"] * (da - spread(np.add.reduceat(f["a"] * da, start)))
        dA = de[:, None] * f["G"] * self.w * (1 - f["A"] ** 2)
        dG = de[:, None] * f["A"] * self.w * f["G"] * (1 - f["G"])
        dH = (dH + dA @ self.V.T + dG @ self.U.T) * (1 - f["H"] ** 2)
        return {"W": x.T @ dH, "b": dH.sum(0), "V": f["H"].T @ dA, "U": f["H"].T @ dG, "w": (f["A"] * f["G"]).T @ de, "c": f["z"].T @ ds, "d": ds.sum(keepdims=True)}


def _bounded(docs: np.ndarray, first: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Documents in runs of at most ``most`` passages; one that has more stands alone."""
    at, held = 0, 0
    for i, n in enumerate((first[docs + 1] - first[docs]).tolist()):
        if i > at and held + n > most:
            yield docs[at:i]
            at, held = i, 0
        held += n
    yield docs[at:]


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, *, epochs: int = 30, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 3, most: int = 8192) -> Model:
    """Adam on the logistic loss of whole documents.

    ``x`` may hold half floats: rows are widened and scaled for a batch alone,
    and a batch with more than ``most`` passages is added up from parts.
    """
    model = Model.fresh(x, seed=seed)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(getattr(model, k)) for k in Model.LEARNT}
    v = {k: np.zeros_like(getattr(model, k)) for k in Model.LEARNT}
    step, n = 0, len(y)
    for epoch in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            docs = order[at : at + batch]
            grads = {k: 0.0 for k in Model.LEARNT}
            for some in _bounded(docs, first, most):
                count = first[some + 1] - first[some]
                part = np.repeat(first[some] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
                for k, g in model.gradients(model.scaled(x[part].astype(np.float32)), np.concatenate([[0], np.cumsum(count)]), y[some]).items():
                    grads[k] = grads[k] + g * np.float32(len(some) / len(docs))
            step += 1
            pace = rate * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
            for k, g in grads.items():
                value = getattr(model, k)
                g = g + decay * value if k == "W" else g
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                value -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the key as text is divisible by 5; a null key is held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def train_rows(documents: DataFrame, labels: DataFrame, label: str, text: str, key: str, max_train: int, max_train_bytes: int) -> DataFrame:
    """(h, id, y) of the distinct labelled texts that are learnt from, h being the text's hash.

    Whole documents in a hashed order of their keys, while there are at most
    ``max_train`` of them and their texts add up to ``max_train_bytes`` at most.
    """
    rows = labels.filter(col(label).isNotNull() & ~held_out(col(key))).groupBy(col(key).alias("id")).agg((F.max(col(label)) > 0).cast("int").alias("y"))
    rows = rows.orderBy(F.xxhash64("id"), "id").limit(max_train)
    thin = documents.select(col(key).alias("id"), col(text).cast("string").alias("text")).join(F.broadcast(rows), "id")
    thin = thin.select("id", "y", F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    thin = thin.groupBy("id", "h").agg(F.first("y").alias("y"), F.max("size").alias("size")).orderBy(F.xxhash64("id"), "id", "h").limit(max_train)
    ahead = Window.orderBy(F.xxhash64("id"), "id", "h").rowsBetween(Window.unboundedPreceding, 0)  # over max_train thin rows at most
    return thin.withColumn("total", F.sum("size").over(ahead)).filter(F.col("total") <= max_train_bytes).select("h", "id", "y")


def _bags(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (half floats), first passages and labels from rows (h, id, part, y, x) in order; a repeated row counts once."""
    parts, count, y, before, piece = [], [], [], None, None
    for batch in batches:
        for h, key, part, label, x in zip(*(c.to_pylist() for c in batch.columns)):
            if (h, key) == before and part <= piece:
                continue
            x = np.frombuffer(x, np.float16).reshape(-1, WIDTH)
            if (h, key) != before:
                count.append(0), y.append(label)
            count[-1] += len(x)
            parts.append(x)
            before, piece = (h, key), part
    held = np.concatenate(parts) if parts else np.zeros((0, WIDTH), np.float16)
    return held, np.concatenate([[0], np.cumsum(count)]).astype(np.int64), np.array(y, np.float32)


def fit(
    documents: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", *, max_train: int = 4000, max_train_bytes: int = 128 << 20, **options
) -> Model | None:
    """A model of the labels of rows that are not held out; None without any.

    It learns from a bounded sample of labelled documents (``max_train``,
    ``max_train_bytes``), of each all passages. They are encoded where they lie
    and meet in one task, which trains; only the model comes to the driver. That
    task holds the features once, as half floats: 1.5 bytes a byte of text.

    Null labels and keys are left out; a key with several labels counts as their
    largest. Repeated rows are learnt once. A null text is an empty one. Empty
    tables give None.
    """
    picks = train_rows(documents, labels, label, text, key, max_train, max_train_bytes)
    some = documents.select(col(key).alias("id"), col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text")).join(F.broadcast(picks), ["h", "id"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 3, 250_000):
                x, first = encode(texts)
                cuts = [(i, lo, min(lo + 64, b)) for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())) for lo in range(a, b, 64)]
                at = pa.array([i for i, _, _ in cuts])
                place = pa.array([lo - int(first[i]) for i, lo, _ in cuts], pa.int64())
                held = pa.array([x[lo:hi].astype(np.float16).tobytes() for _, lo, hi in cuts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), place, part.column(2).take(at), held], ["h", "id", "part", "y", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, first, y = _bags(batches)
        if len(y):
            yield pa.RecordBatch.from_arrays([pa.array([train(x, first, y, **options).dump()], pa.binary())], ["model"])

    kind = documents.schema[key].dataType.simpleString()
    rows = some.select("h", "id", "y", "text").mapInArrow(features, f"h bigint, id {kind}, part bigint, y int, x binary")
    with arrow_rows(documents.sparkSession, 128):  # of 100 KB at most
        got = rows.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "h", "part").mapInArrow(learn, "model binary").collect()
    return Model.load(got[0]["model"]) if got else None


def score(df: DataFrame, model: Model | None, text: str = "text", *, out: str = "score", top: str = "top_passage") -> DataFrame:
    """``df`` with the probability of label 1 and the index of the passage that weighs most.

    A null text counts as empty. Without a model every score is 0.5. Columns of
    ``df`` with the results' names are replaced, all others are kept. Equal texts
    get equal scores, so repeated rows do; no rows give no rows. Very long texts
    are scored whole, about 250,000 bytes of text at a time, or one text.
    """
    names = [c for c in df.columns if c not in (out, top)]
    if model is None:
        return df.select(*map(col, names), F.lit(0.5).alias(out), F.lit(0).alias(top))
    made = model.dump()  # some 100 KB, sent with the function

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.load(made)
        for batch in batches:
            for part, texts in slices(batch, batch.num_columns - 1, 250_000):
                x, first = encode(texts)
                found = model.forward(model.scaled(x), first)
                best = [int(np.argmax(found["a"][a:b])) for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found["p"].astype(float)), pa.array(best, pa.int32())], schema=None, names=[*part.schema.names[:-1], out, top])

    sent = df.select(*map(col, names), col(text).cast("string").alias("k_scored"))
    schema = T.StructType([*df.select(*map(col, names)).schema.fields, T.StructField(out, T.DoubleType()), T.StructField(top, T.IntegerType())])
    return sent.mapInArrow(run, schema)


def classify(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", *, threshold: float = 0.3, **options) -> DataFrame:
    """Per row: key, held_out, score, predicted (1 from ``threshold`` on), top_passage.

    Null keys count as held out; repeated rows each give a row; no rows give none.
    """
    model = fit(documents, labels, text=text, key=key, **options)
    thin = documents.select(col(key).alias("k_id"), col(text).alias("k_text"))
    scored = score(thin, model, "k_text").drop("k_text")
    return scored.select(F.col("k_id").alias(key), held_out(F.col("k_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "top_passage")


def keep_good(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", *, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``documents`` that are not rejected, all columns as they were, whatever their names.

    Null keys, null texts (as empty ones) and repeated rows are judged like others.
    """
    model = fit(documents, labels, text=text, key=key, **options)
    names = documents.columns
    out, top = fresh(documents, "k_score"), fresh(documents, "k_top")
    return score(documents, model, text, out=out, top=top).filter(F.col(out) >= threshold).select(*map(col, names))
