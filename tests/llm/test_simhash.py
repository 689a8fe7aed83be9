import random
import re

import numpy as np
import xxhash

from gleanery.llm import golay, simhash

SCHEMA = "doc_id long, text string, f0 string, size int"


def brute(rows):
    """n_near and component of every row, from all pairs."""
    prints = []
    for _, text, *_ in rows:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)))
    n = len(rows)
    linked = [[j for j in range(n) if j != i and bin(prints[i] ^ prints[j]).count("1") <= 2] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], f"{prints[i]:016x}", len(linked[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def broadcast_python(plan):
    """Whether a physical plan broadcasts what Python makes, of which the planner does not know the size."""
    inside = None
    for line in plan.splitlines():
        depth = len(re.match(r"[ :+-]*", line)[0])
        if inside is not None and depth <= inside:
            inside = None
        if inside is None and line[depth:].startswith("BroadcastExchange"):
            inside = depth
        if inside is not None and line[depth:].startswith("MapInArrow"):
            return True
    return False


def plans(monkeypatch, run):
    """The physical plans of what ``run`` writes to the shared folder, by tag, as first chosen."""
    found, write = {}, simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, tag: found.update({tag: df._jdf.queryExecution().executedPlan().toString()}) or write(df, tag))
    run()
    return found


def test_golay_neighbours_meet():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    for shift in [None, *range(23)]:
        other = words if shift is None else words ^ (1 << shift)
        assert (golay.near_indices(other) == golay.nearest_index(words)[:, None]).any(axis=1).all()


def test_guaranteed_keys_find_all_pairs_of_two_bits():
    rng = random.Random(2)
    specs = simhash.guaranteed_specs()
    for _ in range(400):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.choice([0, 1, 2])):
            y ^= 1 << b
        a, b = (np.array([z], np.uint64) for z in (x, y))
        hit = False
        for s in specs:
            if simhash._gather(a, s.exact)[0] == simhash._gather(b, s.exact)[0]:
                hit |= golay.nearest_index(simhash._gather(a, s.fuzzy))[0] in golay.near_indices(simhash._gather(b, s.fuzzy))[0]
        assert hit


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 60, 200]))]
        rows.append((i * 3, " ".join(base), "x", 1))
        for k in range(rng.randrange(3)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "other"
            rows.append((i * 3 + 1 + k, "\t".join(copy).upper(), None, 2))
    rows += [(900, None, None, None), (901, "", None, None), (902, " \n", "a", 1), (903, "a b", "a", 1), (903, "a b", "a", 1), (None, "a b", "a", 1), (904, "word " * 30000, None, 1)]
    got = simhash.simhash_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted(((r.doc_id, f"{r.f0 & (2**64 - 1):016x}", r.n_near, r.component_id) for r in got), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash_groups(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).columns == empty.columns


def test_drop_keeps_one_of_each_group(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 9)))
    rows = []
    for g in range(30):
        base = [word() for _ in range(250)]
        for k in range(3):
            copy = list(base)
            for _ in range(6 * bool(k)):
                copy[rng.randrange(250)] = word()
            rows.append((g * 10 + k, " ".join(copy), "src", 1))
    rows += [(1000, None, None, None), (1001, "", None, None), (None, "loose row", None, None)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    ids = [r.doc_id for r in kept]
    assert {1000, 1001, None} <= set(ids)
    assert {g * 10 for g in range(30)} <= set(ids)
    assert len(ids) <= 33 + 2


def test_groups_do_not_broadcast_keys(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(40)), None, 1) for i in range(50)]
    rows += [(100 + i, rows[i][1], None, 1) for i in range(20)]
    found = plans(monkeypatch, lambda: simhash.simhash_groups(spark.createDataFrame(rows, SCHEMA)))
    assert "MapInArrow" in found["pairs"]
    assert not any(map(broadcast_python, found.values()))


def test_groups_of_copies_do_not_broadcast_rows(spark, monkeypatch):
    """The planner knows the size of a file, which says little where rows are copies or have no id."""
    rows = [(None, f"some text of {i % 3}", None, 1) for i in range(300)] + [(7, "some text of 0", None, 1), (8, "another", None, 1)]
    kept = []
    found = plans(monkeypatch, lambda: kept.append(simhash.simhash_groups(spark.createDataFrame(rows, SCHEMA))))
    found["last"] = kept[0]._jdf.queryExecution().executedPlan().toString()
    for tag in ("labelled", "last"):
        assert "SortMergeJoin" in found[tag] and "Broadcast" not in found[tag]
    got = sorted(((r.doc_id, f"{r.f0 & (2**64 - 1):016x}", r.n_near, r.component_id) for r in kept[0].collect()), key=str)
    assert got == brute(rows)


def test_near_pairs_are_those_within_two_bits(spark):
    rng = random.Random(6)
    prints = {rng.getrandbits(64) for _ in range(80)}
    for x in list(prints):
        prints.update(x ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3))
    signed = [x - (x >> 63 << 64) for x in prints]
    got = simhash.near_pairs(spark.createDataFrame([(x,) for x in signed], "f0 long")).collect()
    expected = {(u, v) for u in signed for v in signed if u < v and ((u ^ v) & (1 << 64) - 1).bit_count() <= 2}
    assert len(got) == len(expected) and {(r.u, r.v) for r in got} == expected
