import random

import pytest

#: Columns that operators use or return themselves.
CLASHING = ("id", "h", "sha", "kept", "keep_id", "group_size", "c", "n", "size", "g", "salt", "shard", "score", "row", "t", "length", "start", "k_text", "words")


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rng = random.Random(1)
    long = " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9))) for _ in range(20_000))
    body = " ".join(f"word{i}" for i in range(80))
    texts = [
        (1, body), (2, body), (2, body), (3, None), (4, ""), (5, " \t\n"), (6, long), (7, long + " end"), (None, body),
        (None, None), (8, "a b c"), (9, "A  B\tc"), (10, body.replace("word7 ", "other ")), (11, "é 中 😀 mail x.y@z.org +1 (555) 123-4567"), (12, "x"),
    ]
    rows = [(d, t, None if i % 3 else i, *["clash"] * len(CLASHING)) for i, (d, t) in enumerate(texts)]
    schema = "doc_id bigint, text string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def nothing(hard):
    return hard.limit(0)
