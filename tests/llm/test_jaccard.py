import random

import numpy as np
import pytest

from tablecare.llm import jaccard, shingles


def brute_set(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).translate(
        {c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    if len(words) < 4:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)}


def brute(rows):
    """Rows of equal doc_id are told apart by their place."""
    sets = [brute_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * len(sets[i] | sets[j]):
                label[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = root(i)
        least[r] = min((x for x in (least.get(r), doc_id) if x is not None), default=None)
    return [(d, len(s), least[root(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(30)]
    rows = []
    for group in range(14):
        base = [word() for _ in range(rng.choice([1, 2, 3, 5, 8, 20, 60, 120, 400]))]
        if group % 3 == 0:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 6, 25])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows) * 7 % 1000, rng.choice([" ", "  ", "\n"]).join(text).swapcase() if rng.random() < 0.2 else " ".join(text)))
    return rows


ODD = [(None, None), (5000, ""), (5001, " \t\n"), (5002, "one"), (5003, "ONE"), (5004, "one two three"), (None, "one"),
       (5005, "a b c d"), (5005, "a b c d"), (5005, "x y z w v"), (None, "only null here"), (None, "Only null here"),
       (5006, "é É a b c"), (5007, "é é a b c"), (5008, "w " * 70000), (5009, "w" * 5000 + " a b c"), (5010, "w" * 5000 + " a b c")]
KEY = lambda r: tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize(
    "seed,settings",
    [(1, {}), (2, {"CELL": 3, "LEAF": 4, "COMMON": 2}), (3, {"CELL": 5, "COMMON": 3, "FREQUENT": 50})],
)
def test_components_equal_brute_force(docs, monkeypatch, seed, settings):
    for name, value in settings.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(seed) + ODD
    got = jaccard.similar_components(docs(rows)).collect()
    assert sorted(map(tuple, got), key=KEY) == sorted(brute(rows), key=KEY)


@pytest.mark.parametrize("cell", [2, jaccard.CELL])
def test_links_between_rings_at_exactly_one_and_two_radii(docs, monkeypatch, cell):
    monkeypatch.setattr(jaccard, "CELL", cell)
    words = [f"v{i}" for i in range(23)]
    whole, pivot, other = words, words[3:], words[:-3]
    # All classes but two hang on the pivot; only ``whole`` leads to ``other``.
    texts = [other, whole, pivot, pivot, pivot] + [pivot + [f"x{i}"] for i in range(jaccard.CELL + 2)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = sorted(map(tuple, jaccard.similar_components(docs(rows)).collect()))
    assert got == sorted(brute(rows)) and {c for _, _, c in got} == {0}


def test_small_sets_of_a_large_block_go_to_few_cells(docs, spark):
    rng = np.random.default_rng(3)
    base, sets = rng.integers(0, 2**64 - 1, 40, dtype=np.uint64), []
    for _ in range(1200):
        # All at a distance of 0.3 from what most are copies of, so none links to it.
        sets.append(np.unique(np.concatenate([rng.permutation(base)[:33], rng.integers(0, 2**64 - 1, 7, dtype=np.uint64)])))
    rows = [(1, k, 1 + 9 * (k == 0), bytearray(s.tobytes())) for k, s in enumerate([base, *sets])]
    table = spark.createDataFrame(rows, "block long, key long, copies long, elements binary")
    members, _ = jaccard.cells(table)
    assert members.count() <= 3 * len(rows)
    assert members.select("key").distinct().count() >= len(sets)


def test_empty_table_and_rows_that_stay(docs):
    assert jaccard.similar_components(docs([])).collect() == []
    rows = corpus(4)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    kept = jaccard.keep_one(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute(rows)})


def test_one_row_stays_whatever_the_ids(docs):
    text = " ".join(f"w{i}" for i in range(60))
    near, other = text + " more", " ".join(f"v{i}" for i in range(40))
    rows = [(None, text), (None, near), (7, text), (7, near), (7, text), (None, other), (None, other + " x"), (9, other), (9, ""), (9, ""), (None, None)]
    kept = [(r.doc_id, r.text) for r in jaccard.keep_one(docs(rows)).collect()]
    of = lambda words: [(i, t) for i, t in kept if t and t.startswith(words)]
    assert [i for i, _ in of("w0")] == [7] and [i for i, _ in of("v0")] == [9]
    assert sorted((i is None, t) for i, t in kept if not t) == [(False, ""), (False, ""), (True, None)]
    nameless = [(None, text), (None, near), (None, near), (3, other)]
    assert len(jaccard.keep_one(docs(nameless)).collect()) == 2


@pytest.mark.parametrize("n", [1, 2, 5, 7, 18, 40, 150, 900])
def test_linked_sets_share_a_signature(n):
    rng = np.random.default_rng(n)
    for _ in range(40):
        a = np.unique(rng.integers(0, 2**64 - 1, n, dtype=np.uint64))
        drop = rng.integers(0, n * 15 // 100 + 1)
        add = rng.integers(0, n * 15 // 85 + 1)
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**64 - 1, add, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 85 * (len(a) + len(b) - both):
            continue
        every = np.union1d(a, b)
        for frequent in (np.empty(0, np.uint64), every[::2], every[: len(every) * 9 // 10], every):
            assert set(shingles.signatures(a, frequent).tolist()) & set(shingles.signatures(b, frequent).tolist())


def test_sets_that_share_a_few_elements_do_not_meet():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**64 - 1, 100, dtype=np.uint64)
    label = list(range(1500))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    holder = {}
    for i in range(len(label)):
        own = rng.integers(0, 2**64 - 1, rng.integers(30, 60), dtype=np.uint64)
        for mark in shingles.signatures(np.union1d(own, rng.choice(pool, 10)), np.empty(0, np.uint64)).tolist():
            label[root(i)] = root(holder.setdefault(mark, i))
    roots = [root(i) for i in range(len(label))]
    assert max(roots.count(r) for r in set(roots)) <= 10


def test_regions_with_and_without_pivots():
    rng = np.random.default_rng(9)
    for spread in (0.02, 0.1, 0.3):
        centres = [rng.integers(0, 2**63, 60).astype(np.uint64) for _ in range(6)]
        sets = []
        for i in range(150):
            s = centres[i % 6].copy()
            s[rng.random(60) < rng.random() * spread] = rng.integers(0, 2**63)
            sets.append(np.unique(s))
        keys = rng.permutation(1000)[:150].tolist()
        pairs = [(i, j) for i in range(150) for j in range(i)]
        linked = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
        label = {k: k for k in keys}
        changed = True
        edges = [(keys[i], keys[j]) for i, j in pairs if linked(sets[i], sets[j])]
        while changed:
            changed = False
            for a, b in edges:
                least = min(label[a], label[b])
                changed |= label[a] != least or label[b] != least
                label[a] = label[b] = least
        got = dict(jaccard.links_of(keys, sets))
        assert {k: got.get(k, k) for k in keys} == label
