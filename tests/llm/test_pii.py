import hashlib
import re

from kindred.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and luhn) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    "a@b.c_d@e.f x@y.z", "+1 (2) 3456789 +", "1.2.3.4.5.6.7.8 999.1.1.1 255.255.255.255 000000255.1.1.1", "4111111111111111 4111 1111 1111 1111  4111-1111-1111-1111 411111111111111 1",
    "é中😀 a@b.co 😀 1.2.3.4", "version 3.0 of 2024-01-02, 10:20:30", "", None, "1" * 20000, "a." * 20000, "1 " * 20000, "+1" + "(" * 20000, "a@" * 9000, "1." * 20000, "x" * 100000,
]


def test_base_spans_and_clean_texts(spark):
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, k_base string, row string")
    for r in pii.digests(df).collect():
        want = base(TEXTS[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == w[0] for w in want) for k in pii.KINDS)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.spans == said


def test_the_method_adds_spans(spark):
    texts = ["or call (555) 234-5678 now", "card 4111.1111.1111.1111 here", "ip 2001:0db8:85a3:0000:0000:8a2e:0370:7334 x", "id 123-456-789", "at 12:34:56:78"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [r.spans for r in pii.digests(df).orderBy("doc_id").collect()]
    assert got == ["phone:8:22", "card:5:24", "ip:3:42", "", ""]


def test_redaction(spark, hard, nothing):
    df = spark.createDataFrame([(1, "x a@b.org, 1.2.3.4!", "kept"), (2, None, None), (3, "a@1.2.3.4", None)], "doc_id bigint, text string, spans string")
    assert [r.text for r in pii.redact(df).orderBy("doc_id").collect()] == ["x [EMAIL], [IP]!", None, "[EMAIL]"]
    clean = pii.redact(hard)
    assert clean.columns == hard.columns and clean.count() == hard.count()
    assert clean.filter("doc_id = 11").first().text == "é 中 😀 mail [EMAIL] [PHONE]"
    assert pii.redact(nothing).count() == 0 and pii.digests(nothing).count() == 0


def test_boosting_separates_and_thresholds_hold():
    rows = [([1, 0] + [0] * 9, 50.0, 1.0), ([0, 1] + [0] * 9, 1.0, 50.0), ([1, 1] + [0] * 9, 5.0, 5.0)]
    trees = pii.boost(rows)
    values = [sum(pii._value(t, r[0]) for t in trees) for r in rows]
    assert values[0] > values[2] > values[1]


def test_more_matches_than_a_block(spark):
    text = "é a@b.co, 1.2.3.4 and +1.2.3.4.5678 " * 600
    df = spark.createDataFrame([(0, text)], "doc_id bigint, text string")
    want = base(text)
    assert pii.digests(df).first().spans == ",".join(f"{k}:{a}:{b}" for k, a, b in want)
    out, end = [], 0
    for s, e, kind in sorted((a, b, pii.KINDS.index(k)) for k, a, b in want):
        if s >= end:
            out += [text[end:s], f"[{pii.KINDS[kind].upper()}]"]
        end = max(end, e)
    assert pii.redact(df).first().text == "".join(out) + text[end:]
