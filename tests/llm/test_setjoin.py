import random
from fractions import Fraction

from gleanery.llm import setjoin, simhash


def similar(a, b, t):
    """Sizes within a factor of two, and the Jaccard of the hashes that end with as many zeros as bring the larger set to 128."""
    if 2 * min(len(a), len(b)) < max(len(a), len(b)):
        return False
    halvings = 0
    while max(len(a), len(b)) > 128 << halvings:
        halvings += 1
    a, b = ({x for x in s if x % (1 << halvings) == 0} for s in (a, b))
    return bool(a & b) and len(a & b) >= t * len(a | b)


def components(nodes, pairs):
    least = {c: c for pair in pairs for c in pair}
    while True:
        moved = {c: min([least[c], *(least[d] for pair in pairs if c in pair for d in pair)]) for c in least}
        if moved == least:
            return least
        least = moved


def rows_of(texts):
    out = {}
    for x in texts:
        found = setjoin.shingle_set(x.encode())
        out[setjoin.set_number(found)] = found
    return [(c, len(f), setjoin.select(f, setjoin.level_of(len(f))).tolist()) for c, f in out.items()], {c: set(f.tolist()) for c, f in out.items()}


def test_components_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = ["one", "one two", "Two one", "a b c", "a b c a b c"]
    for _ in range(24):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 129, 300]))]
        texts.append(" ".join(base))
        for share in (0.02, 0.1, 0.15, 0.2, 0.3):
            texts.append(" ".join(rng.choice(vocabulary) if rng.random() < share else w for w in base))
        texts.append(" ".join(base[: len(base) * 2 // 3]))
    rows, sets = rows_of(texts)
    table = spark.createDataFrame(rows, "c long, n int, s array<long>")
    nodes = sorted(sets)
    given = [(nodes[k], nodes[k + 9]) for k in range(0, len(nodes) - 9, 20)]
    for t, stars, links in ((setjoin.JACCARD, 4, []), (Fraction(4, 5), 0, []), (setjoin.JACCARD, 0, given)):
        pairs = {(u, v) for u in sets for v in sets if u < v and similar(sets[u], sets[v], t)}
        got = {r.node: r.component for r in setjoin.linked_sets(table, spark.createDataFrame(links, "u long, v long"), t, stars).collect()}
        assert got == components(nodes, pairs | set(links)) and len(got) > 20


def test_levels():
    assert [setjoin.level_of(n) for n in (0, 1, 128, 129, 256, 257, 512, 513)] == [0, 0, 0, 1, 1, 2, 2, 3]
    assert all(setjoin.level_of(2 * n) - setjoin.level_of(n) <= 1 for n in range(1, 5000))


def test_copies_at_the_very_threshold_are_dropped(spark):
    """58 shingles each, 36 shared: Jaccard 9/20 exactly; and 35 shared, just below."""
    rows = []
    for g in range(10):
        word = lambda k, g=g: f"w{g}x{k}"
        base = [word(k) for k in range(60)]
        rows.append((g * 10, " ".join(base)))
        rows.append((g * 10 + 1, " ".join([*base[:38], *(word(1000 + k) for k in range(22))])))
        rows.append((g * 10 + 2, " ".join([*(word(2000 + k) for k in range(23)), *base[-37:]])))
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {g * 10 + k for g in range(10) for k in (0, 2)}


def test_sets_that_meet_by_chance_give_no_postings(spark):
    """Each set shares eight of its twenty shingles with one other; the twelve that are its own come
    first, however few of the sets a sample would have taken."""
    rows = [(c, 20, sorted([*(1000 * c + i for i in range(12)), *(-1000 * (c // 2) - i for i in range(1, 9))])) for c in range(6000)]
    table = spark.createDataFrame(rows, "c long, n int, s array<long>")
    assert setjoin._postings(table, setjoin.JACCARD).count() == 0
