import random
from collections import Counter

import pytest

from tablecare.llm import repeats
from tablecare.llm.suffixes import suffix_array


def test_suffix_arrays():
    for seed in range(1500):
        rng = random.Random(seed)
        s = [rng.randint(0, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.3:
            s = s[: len(s) // 4 + 1] * 5
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(x[p : p + length] for x in raw for p in range(len(x) - length + 1))
    out = []
    for (doc_id, _), x in zip(rows, raw):
        gone = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc_id, len(x), sum(gone), spans, bytes(b for b, g in zip(x, gone) if not g)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    base, passage = text(300), text(60)
    rows = [(i, text(rng.randint(0, 200))) for i in range(10)]
    for i in range(30):
        t = list(base[rng.randint(0, 100) : rng.randint(150, 300)])
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        rows.append((100 + i, "".join(t)))
    rows += [(200 + i, text(rng.randint(0, 40)) + passage + text(rng.randint(0, 40))) for i in range(12)]
    rows += [(300, "ab" * 100), (301, "ab" * 60 + "c"), (302, "z" * 130), (303, base), (303, base), (None, None), (304, "")]
    return rows + [(None, passage + "q"), (305, text(50) * 3)]


@pytest.mark.parametrize("length,gram,settings", [(40, 20, {}), (40, 39, {"CROWD": 2}), (30, 5, {"TOGETHER": 50, "PART": 17}), (21, 1, {"CROWD": 5})])
def test_equals_brute_force(docs, monkeypatch, length, gram, settings):
    for name, value in settings.items():
        monkeypatch.setattr(repeats, name, value)
    rows = corpus(length)
    got = [
        (r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), bytes(r.kept))
        for r in repeats.remove_repeats(docs(rows), length, gram).collect()
    ]
    key = lambda r: tuple((x is None, x or (b"" if isinstance(x, bytes) else 0)) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows, length), key=key)


def test_production_length_and_empty_table(docs):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, long), (2, long[:1000] + "X" + long[1000:]), (3, long[700:1100]), (4, long[700:1099]), (5, "q" * 399), (6, "r" * 401)]
    got = {r.doc_id: (r.n_bytes, bytes(r.kept)) for r in repeats.remove_repeats(docs(rows)).collect()}
    assert got == {i: (n, kept) for i, n, _, _, kept in brute(rows, 400)}
    assert repeats.remove_repeats(docs([])).collect() == []
