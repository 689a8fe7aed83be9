import hashlib
import math
import random

import pytest

from gleanery.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, key int, s int"


def brute(rows, weights, repeats=3):
    sizes = [(i, s, len((t or "").encode().split())) for i, t, s, *_ in rows]
    total = {}
    for _, s, n in sizes:
        total[s] = total.get(s, 0) + n
    words, full = sum(total.values()), set()
    while True:
        rest = sum(weights[s] for s in total if s not in full)
        level = max(0, words - sum(repeats * total[s] for s in full)) / rest if rest else 0
        more = {s for s in total if level * weights[s] >= repeats * total[s]}
        if more <= full or not rest:
            break
        full |= more
    target = {s: round(min(repeats * total[s], level * weights[s]), 6) for s in total}
    taken = []
    for s in total:
        epochs = math.floor(target[s] / total[s]) if total[s] else 0
        rest = target[s] - epochs * total[s]
        units = {}
        for i, q, n in sizes:
            if q == s:
                u = (int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                units[(-math.log(u), -1 if i is None else i)] = units.get((-math.log(u), -1 if i is None else i), 0) + n
        upto, chosen = 0, set()
        for unit in sorted(units):
            upto += units[unit]
            if rest > 0 and 2 * upto - units[unit] <= 2 * rest:
                chosen.add(unit[1])
        taken += [(i, s, n, target[s], n * (epochs + ((-1 if i is None else i) in chosen))) for i, q, n in sizes if q == s]
    return sorted(taken, key=str)


def run(spark, rows, weights):
    table = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "s string, weight double")
    got = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA), table).collect()
    return sorted(((r.doc_id, r.source, r["size"], r.target, r.taken) for r in got), key=str)


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, " \t".join("w" for _ in range(rng.randrange(60))), rng.choice(["a", "a", "a", "b", "c", None]), "x", 1, 2) for i in range(300)]
    rows += [(1000, None, "a", None, None, None), (1001, "", "d", None, None, None), (1002, "long " * 20000, "b", None, 1, 1)]
    rows += [(5, "again again", "a", None, None, None)] * 2 + [(None, "no id", "a", None, None, None)] * 2
    weights = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    got, expected = run(spark, rows, weights), brute(rows, weights)
    assert [(x[0], x[1], x[2], x[4]) for x in got] == [(x[0], x[1], x[2], x[4]) for x in expected]
    assert all(abs(a[3] - b[3]) < 1e-5 for a, b in zip(got, expected))


def test_targets_stop_at_three_sizes(spark):
    rows = [(i, "w " * 10, "big", None, None, None) for i in range(50)] + [(99, "w " * 10, "small", None, None, None)]
    got = {(r[0], r[1]): r for r in run(spark, rows, {"big": 1, "small": 5})}
    assert got[(99, "small")][3:] == (30.0, 30)
    big = [r for r in got.values() if r[1] == "big"]
    assert big[0][3] == 480.0 and abs(sum(r[4] for r in big) - 480) <= 5


def test_empty_table_and_missing_weight(spark):
    assert run(spark, [], {"a": 1}) == []
    assert run(spark, [(1, "a b", "other", None, None, None)], {"a": 1}) == [(1, "other", 2, 0.0, 0)]


def test_cyclic_weights(spark):
    docs = spark.createDataFrame([("b",), (None,), ("a",), ("B",), ("a",)], "source string")
    got = {r.s: r.weight for r in mixing.cyclic_weights(docs).collect()}
    assert got == {"B": 1.0, "a": 2.0, "b": 3.0, None: 1.0}


def test_plainness_and_other_weights(spark):
    assert [mixing.plainness(t.encode()) for t in ("ab", "a!", "", "é!!", "éé!é")] == [1.0, 0.1, 0.1, 0.1, 0.5]
    docs = spark.createDataFrame([(i, "w " * 5 + "x" * (i < 5), s, None, 0, 0) for i in range(10) for s in "ab"], SCHEMA)
    table = spark.createDataFrame([("a", 0.5), ("b", 1.5)], "s string, weight double")
    got = mixing.mix_sources(docs, table, weigh=lambda found: [1e9 if b"x" in t else 1.0 for t in found]).collect()
    assert {r.doc_id for r in got if r.source == "a" and r.taken} <= set(range(5))


def test_given_quality_and_clashing_names(spark):
    docs = spark.createDataFrame([(i, "w " * 5, "a", 1e9 if i < 5 else None, 0, 0) for i in range(10)], "doc_id long, text string, source string, t double, plain int, key int")
    table = spark.createDataFrame([("a", 0.5)], "s string, weight double")
    docs = docs.unionByName(docs.selectExpr("doc_id", "text", "'b' as source", "t", "plain", "key"))
    table = spark.createDataFrame([("a", 0.5), ("b", 1.5)], "s string, weight double")
    got = mixing.mix_sources(docs, table, quality_col="t", keep=("t", "plain", "key", "text")).collect()
    assert {r.doc_id for r in got if r.source == "a" and r.taken} == set(range(5))
    assert all(r.text == "w " * 5 for r in got)


def test_repeated_weights_add_up(spark):
    docs = spark.createDataFrame([(i, "w " * 9, "ab"[i % 2], None, None, None) for i in range(20)], SCHEMA)
    twice = spark.createDataFrame([("a", 0.5), ("b", 1.0), ("a", 0.5)], "s string, weight double")
    once = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "s string, weight double")
    got, expected = (sorted(mixing.mix_sources(docs, w).collect()) for w in (twice, once))
    assert got == expected and len(got) == 20


def test_kept_columns_must_not_clash(spark):
    docs = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError, match="size"):
        mixing.mix_sources(docs, mixing.cyclic_weights(docs), keep=("size",))
