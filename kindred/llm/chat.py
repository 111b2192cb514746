"""Chat formatting by incremental black-box rendering.

The template is a function from a list of (role, text) to a string, of which
nothing else is known. Rendering the prefixes of a conversation one after the
other and comparing consecutive outputs shows which characters each turn added.
Rendering the last turn once more with a probe as its text shows which of those
are the text itself and which are marks. A template whose output for a longer
prefix does not begin with that for the shorter one rewrites history: no turn
has a fixed span then, and the row says so.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.store import col

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

#: Strings that mark turns; a text that holds one has it escaped.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
_UNSAFE = re.compile("|".join(map(re.escape, ("\\", *CONTROLS))))
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(
    r"\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>|<<SYS>>(?P<system>.*?)<</SYS>>|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<other>.*?)</s>",
    re.DOTALL,
)


def escape(text: str) -> str:
    """A backslash is doubled, and one is put into each control string after its first character."""
    return _UNSAFE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def inst_template(turns: Turns) -> str:
    """The public [INST] marks, each turn closed, and any other role written out."""
    marks = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
    out = []
    for role, text in turns:
        before, after = marks.get(role) or (f"[ROLE]{escape(role)}[/ROLE]", "</s>")
        out += (before, escape(text), after)
    return "".join(out)


def read_back(formatted: str) -> Turns:
    """The turns from the text alone: the inverse of ``inst_template``."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn begins at {at}")
        kind = m.lastgroup
        out.append((unescape(m["role"]) if kind == "other" else kind, unescape(m[kind])))
        at = m.end()
    return out


PROBES = ("", "")


def render(turns: Turns, template: Template = inst_template) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], bool]:
    """Output, span of each turn, span of each turn's text in it, and whether the template rewrites history."""
    out, spans, texts, rewrites = template([]), [], [], False
    for i in range(len(turns)):
        longer = template(turns[: i + 1])
        if not longer.startswith(out):
            rewrites = True
            break
        # two probes in place of the text: what they share before and after is marks
        one, two = (template([*turns[:i], (turns[i][0], p)]) for p in PROBES)
        a = len(out)
        while a < min(len(one), len(two)) and one[a] == two[a]:
            a += 1
        tail = len(one) - a - 1
        spans.append((len(out), len(longer)))
        texts.append((a, len(longer) - tail))
        out = longer
    return (template(turns), [], [], True) if rewrites else (out, spans, texts, False)


def format_chats(
    df: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    *,
    template: Template = inst_template,
    learn: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation: ``key``, ``formatted``, ``spans``, ``loss_spans``, ``rewrites``.

    ``spans`` (start, end, role) and ``loss_spans`` (start, end: the texts of
    roles in ``learn``) are in code points, end exclusive; both are empty where
    the template rewrites history. Rows are ordered by turn, a null turn first,
    equal turns by role and text; repeated rows are turns of their own. A null
    text or role counts as empty; rows with a null key are one conversation.
    Other columns are not read. A conversation is one string in the end, so its
    rows meet in one task.
    """
    kind = df.schema[key].dataType.simpleString()
    empty = F.lit("")
    row = F.struct(col(turn).alias("turn"), F.coalesce(col(role).cast("string"), empty).alias("role"), F.coalesce(col(text).cast("string"), empty).alias("text"))
    grouped = df.select(col(key).alias("id"), row.alias("row")).groupBy("id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    grouped = grouped.select("id", F.col("rows.role").alias("roles"), F.col("rows.text").alias("texts"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("role", pa.string())])
    loss = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = []
                for roles, texts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    out, spans, inner, rewrites = render(list(zip(roles, texts, strict=True)), template)
                    rows.append((out, [(a, b, r) for (a, b), r in zip(spans, roles)], [x for x, r in zip(inner, roles) if r in learn], rewrites))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([r[0] for r in rows], pa.string()),
                        pa.array([[{"start": a, "end": b, "role": c} for a, b, c in r[1]] for r in rows], pa.list_(span)),
                        pa.array([[{"start": a, "end": b} for a, b in r[2]] for r in rows], pa.list_(loss)),
                        pa.array([r[3] for r in rows], pa.bool_()),
                    ],
                    ["id", "formatted", "spans", "loss_spans", "rewrites"],
                )

    schema = f"id {kind}, formatted string, spans array<struct<start:bigint,end:bigint,role:string>>, loss_spans array<struct<start:bigint,end:bigint>>, rewrites boolean"
    return grouped.mapInArrow(write, schema).withColumnRenamed("id", key)


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """What the output alone says: turns and texts under the loss mask, read back from it."""
    import hashlib

    kind = formatted.schema[key].dataType.simpleString()
    names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for out, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(out)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                learnt = "".join(unescape(out[s["start"] : s["end"]]) for s in mask)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(out)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    schema = f"id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return formatted.select(col(key).alias("id"), "formatted", "loss_spans").mapInArrow(read, schema).withColumnRenamed("id", key)
