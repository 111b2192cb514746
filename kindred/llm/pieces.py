"""SentencePiece encoding and decoding: a batched Viterbi in numpy.

Texts are cut into words at blanks, where no piece of the vocabulary crosses,
and each distinct word is encoded once. Words of equal length advance together,
a character at a time: the hashes of all substrings that end there probe the
sorted hashes of the pieces, the best admissible piece is kept with a pointer
to where it begins, and the pointers are followed back at the end.

The model is a BPE model, whose right answer is not the path of the greatest
total score but the one its merges lead to. So a piece is admissible after the
piece before it only if no merge would have crossed the seam between the two;
exactly one path is admissible throughout, and it is what the merges give. The
test undoes the two pieces' merges from the latest on and sees whether the seam
would have merged first. Characters without a piece become their bytes.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.store import col, slices

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
NEVER = np.iinfo(np.int64).max
SPACE = "▁"
WORD = re.compile(SPACE + r"+[^▁\n]*|[^▁\n]+|\n+")
KEPT_WORDS = 300_000  # distinct words that a worker remembers


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def merged(chars: list[str], rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """What merges make of characters, best rank first and leftmost of equals, and the last merge."""
    parts, last = list(chars), None
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (rank.get(parts[i] + parts[i + 1], NEVER), i))
        if parts[best] + parts[best + 1] not in rank:
            break
        last = (parts[best], parts[best + 1])
        parts[best : best + 2] = ["".join(last)]
    return parts, last


class Pieces:
    """A vocabulary ready for encoding, and the words that were encoded so far."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        known = set(plain)
        self.byte = np.zeros(256, np.int64)
        raw = [b""] * n
        for i in range(n):
            if model.is_byte(i):
                self.byte[int(self.texts[i][3:5], 16)] = i
                raw[i] = bytes([int(self.texts[i][3:5], 16)])
            elif i in known:
                raw[i] = self.texts[i].replace(SPACE, " ").encode()
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(r) for r in raw])
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        order = sorted(plain, key=lambda i: -model.get_score(i))
        rank = {self.texts[i]: k for k, i in enumerate(order)}
        ids = {self.texts[i]: i for i in plain}
        self.rank_of, self.ids_of, self.n = rank, ids, n
        # of each piece: when it is made, and of what; characters are there from the start
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        pairs, reachable = [], []
        for text, i in ids.items():
            if len(text) > 1:
                parts, last = merged(list(text), rank)
                if len(parts) > 1 or last[0] not in ids or last[1] not in ids:
                    continue  # no merges lead to it
                self.rank[i], self.left[i], self.right[i] = rank[text], ids[last[0]], ids[last[1]]
                pairs += [(ids[text[:k]] * n + ids[text[k:]], rank[text]) for k in range(1, len(text)) if text[:k] in ids and text[k:] in ids]
            reachable.append(i)
        pairs.sort()
        self.pair_key = np.array([p[0] for p in pairs], np.int64)
        self.pair_rank = np.array([p[1] for p in pairs], np.int64)
        self.longest = max(len(self.texts[i]) for i in reachable)
        hashes = np.array([self.hash_of(self.texts[i]) for i in reachable], U)
        at = np.argsort(hashes)
        self.hash, self.hash_id = hashes[at], np.array(reachable)[at]
        if (self.hash[1:] == self.hash[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.forget()

    @staticmethod
    def hash_of(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def seam_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """When x and y would merge; NEVER where they make no piece."""
        key = x * self.n + y
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NEVER)

    def holds(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the seam between pieces x and y is never merged across."""
        out = self.seam_rank(x, y) == NEVER
        live = np.flatnonzero(out)
        x, y = x[live], y[live]
        while len(live):
            rx, ry = self.rank[x], self.rank[y]
            left = rx > ry  # of equal merges the left one comes first, so the right one is undone first
            done = (rx < 0) & (ry < 0)
            x, y = np.where(left & ~done, self.right[x], x), np.where(~left & ~done, self.left[y], y)
            seam = self.seam_rank(x, y)
            bad = ~done & np.where(left, seam < rx, seam <= ry)
            out[live[bad]] = False
            go = ~done & ~bad
            live, x, y = live[go], x[go], y[go]
        return out

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, one after the other, and how many each has."""
        n, count = len(words[0]), len(words)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(count, n).astype(U)
        prefix = np.zeros((count, n + 1), U)
        for i in range(n):
            prefix[:, i + 1] = prefix[:, i] * BASE + points[:, i] + U(1)
        power = [U(1)]
        for _ in range(min(n, self.longest)):
            power.append(np.multiply(power[-1:], BASE)[0])
        last = np.full((count, n + 1), -1, np.int64)  # the piece that ends here, of the one admissible path
        back = np.zeros((count, n + 1), np.int32)
        row = np.arange(count)
        for i in range(1, n + 1):
            who, what, size = [], [], []
            for k in range(1, min(i, self.longest) + 1):
                h = prefix[:, i] - prefix[:, i - k] * power[k]
                at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
                hit = np.flatnonzero((self.hash[at] == h) & ((last[:, i - k] != -1) | (i == k)))
                who.append(hit), what.append(self.hash_id[at[hit]]), size.append(np.full(len(hit), k))
            who, what, size = np.concatenate(who), np.concatenate(what), np.concatenate(size)
            before = np.where(size == i, -2, last[who, i - size])
            fine = before < 0  # begins the word, or follows a character without a piece
            seam = np.flatnonzero(~fine)
            both, inverse = np.unique(before[seam] * self.n + what[seam], return_inverse=True)
            fine[seam] = self.holds(both // self.n, both % self.n)[inverse]
            # the longest admissible piece; at most one is
            best = np.zeros(count, np.int64)
            np.maximum.at(best, who[fine], size[fine])
            take = fine & (best[who] == size)
            last[who[take], i], back[who[take], i] = what[take], size[take]
            bare = row[last[:, i] == -1]  # a character without a piece, if no piece ends here
            single = prefix[bare, i] - prefix[bare, i - 1] * BASE
            known = self.hash[np.minimum(np.searchsorted(self.hash, single), len(self.hash) - 1)] == single
            bare = bare[~known]
            last[bare, i], back[bare, i] = -2, 1
        at, steps = np.full(count, n), []
        stuck = np.zeros(count, bool)
        while at.any():
            here = np.where(at > 0, last[row, at], -1)
            stuck |= (here == -1) & (at > 0) | (here == -2)
            steps.append(here)
            at = np.where(stuck, 0, at - back[row, at])
        path = np.stack(steps[::-1], 1)
        path[stuck] = -1
        flat, size = path[path != -1], (path != -1).sum(1)
        if stuck.any():  # words with characters that have no piece
            parts = np.split(flat, np.cumsum(size)[:-1])
            for w in np.flatnonzero(stuck).tolist():
                parts[w] = np.array(self.spelt(words[w], last[w], back[w]), np.int64)
            flat, size = np.concatenate(parts), np.array([len(x) for x in parts])
        return flat.astype(np.int32), size

    def spelt(self, word: str, last: np.ndarray, back: np.ndarray) -> list[int]:
        """Follows one word's pointers, with the bytes of characters that have no piece."""
        ids, i = [], len(word)
        while i > 0:
            if last[i] == -1:
                return self.plainly(word)
            if last[i] == -2:
                ids += self.byte[np.frombuffer(word[i - 1].encode("utf-8", "replace"), np.uint8)].tolist()[::-1]
            else:
                ids.append(int(last[i]))
            i -= int(back[i])
        return ids[::-1]

    def plainly(self, word: str) -> list[int]:
        """Merges one after the other: for a word that no admissible path spans."""
        out = []
        for part in merged(list(word), self.rank_of)[0]:
            out += [self.ids_of[part]] if part in self.ids_of else self.byte[np.frombuffer(part.encode("utf-8", "replace"), np.uint8)].tolist()
        return out

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.index]
        by_length: dict[int, list[str]] = {}
        for w in new:
            by_length.setdefault(len(w), []).append(w)
        ids, sizes, known = [self.flat], [self.size], len(self.size)
        for length, group in sorted(by_length.items()):
            step = max(1, 2_000_000 // (length + 1))
            for at in range(0, len(group), step):
                part = group[at : at + step]
                flat, size = self.viterbi(part)
                self.index.update(zip(part, range(known, known + len(part)), strict=True))
                known += len(part)
                ids.append(flat), sizes.append(size)
        self.flat, self.size = np.concatenate(ids), np.concatenate(sizes)
        self.start = np.cumsum(self.size) - self.size

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with a blank before it; an empty text has none."""
        cut = [WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.index) > KEPT_WORDS:
            self.forget()
        self.learn(set().union(*cut) if cut else set())
        out = []
        for words in cut:
            at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
            size = self.size[at]
            where = np.repeat(self.start[at] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            out.append(self.flat[where] if len(words) else np.zeros(0, np.int32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the blank before it; bytes that are no UTF-8 become U+FFFD."""
        size = self.raw_size[ids]
        where = np.repeat(self.raw_start[ids] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        text = self.raw[where].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", *, path: str | None = None) -> DataFrame:
    """(key, ids): the piece ids of every row's whole text; none for a null or empty text.

    Null keys and repeated rows give rows like others; no rows give none. Other columns are not read, so their names are free.
    """
    kind, path = df.schema[key].dataType.simpleString(), path or model_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for part, texts in slices(batch, 1, 2_000_000):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.encode(texts), pa.list_(pa.int32()))], ["id", "ids"])

    return df.select(col(key).alias("id"), col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", key)


def decode(df: DataFrame, ids: str = "ids", key: str = "doc_id", *, path: str | None = None) -> DataFrame:
    """(key, text) of rows of piece ids; null ids decode to the empty text.

    Null keys and repeated rows give rows like others; no rows give none.
    """
    kind, path = df.schema[key].dataType.simpleString(), path or model_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [model.decode(np.array(x or [], np.int64)) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return df.select(col(key).alias("id"), col(ids).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", key)


def round_trip(df: DataFrame, text: str = "text", key: str = "doc_id", *, path: str | None = None) -> DataFrame:
    """(key, n_pieces, ids_crc32, restored): every text encoded, decoded again and compared, in one pass.

    ``restored`` says that the decoded text is the text (the model writes a
    blank as U+2581, so that character comes back as a blank). Null texts count
    as empty; null keys and repeated rows give rows like others; no rows give none.
    """
    kind, path = df.schema[key].dataType.simpleString(), path or model_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for part, texts in slices(batch, 1, 2_000_000):
                ids = model.encode(texts)
                same = [model.decode(x) == t.replace(SPACE, " ") for x, t in zip(ids, texts, strict=True)]
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["id", "n_pieces", "ids_crc32", "restored"])

    rows = df.select(col(key).alias("id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_pieces bigint, ids_crc32 bigint, restored boolean").withColumnRenamed("id", key)
