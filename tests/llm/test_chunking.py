import hashlib
import random

import pytest

from gleanery.llm import chunking

SCHEMA = "doc_id long, text string, i string, k int, fingerprint int"


def slow_cuts(data):
    """Byte by byte, with the hash over the last 32 bytes of the whole text."""
    out, start, h = [], 0, 0
    for at, byte in enumerate(data):
        h = ((h << 1) + int(chunking._GEAR[byte])) & 0xFFFFFFFF
        n = at + 1 - start
        mask = int(chunking._HARD if n < chunking.NORMAL else chunking._EASY)
        if n >= chunking.LEAST and (h & mask == 0 or n == chunking.MOST):
            out.append(at + 1)
            start = at + 1
    return out + [len(data)] * (start < len(data))


def brute(rows):
    rows = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for n, (i, text) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]

        def chunks(t):
            data, at, found = t.encode(), 0, {}
            for end in slow_cuts(data):
                found[data[at:end]] = end - at
                at = end
            return found

        def near(a, b):
            return sum(v for c, v in a.items() if c in b) / sum(a.values()) if a else float(not b)

        a = chunks(text)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), near(a, chunks(edited)), near(a, chunks(following))))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", ["1", "4", "50"])
def test_against_brute_force(spark, parts):
    rng = random.Random(3)
    rows = [(rng.randrange(10**12), "".join(rng.choice("abc déf🙂\n") for _ in range(rng.choice([0, 1, 2, 10, 300, 3000]))), "x", 1, 1) for _ in range(70)]
    rows += [(5, None, None, None, None), (5, "twice", None, None, None), (5, "twice", None, None, None), (None, "no id", None, None, None), (None, None, None, None, None), (9, "é" * 60000, None, None, None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = chunking.edited_fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=str) == brute(rows)
    for r in got:
        assert chunking.as_text(chunking.from_text(r.fingerprint)) == r.fingerprint


def test_one_and_no_document(spark):
    (row,) = chunking.edited_fingerprints(spark.createDataFrame([(1, "abcdef" * 50, None, None, None)], SCHEMA)).collect()
    assert row.near_next == 1.0
    assert chunking.edited_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shifts_leave_most_chunks():
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000)).encode()
    moved = text[:5000] + b"inserted" + text[5000:]
    assert chunking.containment(chunking.chunk_set(text), chunking.chunk_set(moved)) > 0.95
    ends = chunking.cuts(text)
    assert max(b - a for a, b in zip(ends, ends[1:])) <= chunking.MOST
    assert 40 < len(text) / len(ends) < 120
