import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from tablecare.llm import periods


def plain_runs(words, least=6, times=4):
    """Every stretch with its smallest period, by trying each period at each place."""
    found = {}
    n = len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, times * q):
                found.setdefault((i, length), q)
            i = j + 1
    return sorted(((s, l, q) for (s, l), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, l, q in runs for i in range(s + q, s + l)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("seed", range(6))
def test_runs_by_brute_force(seed):
    random.seed(seed)
    texts = []
    for _ in range(150):
        words = [random.choice("abc"[: random.randint(1, 3)]) for _ in range(random.randint(0, 40))]
        if random.random() < 0.6:
            at, piece = random.randint(0, len(words)), [random.choice("abcd") for _ in range(random.randint(1, 6))]
            words[at:at] = (piece * 8)[: random.randint(1, 8 * len(piece))]
        texts.append([w.encode() for w in words])
    found = periods.find_runs(texts)
    assert found == [plain_runs(t) for t in texts]
    assert sum(map(len, found)) > 50
    assert [periods.collapsed(t, r) for t, r in zip(texts, found)] == [plain_collapsed(t, r) for t, r in zip(texts, found)]
    assert periods.find_runs(texts, 3, 2) == [plain_runs(t, 3, 2) for t in texts]


def test_collapse_of_runs_in_one_another():
    words = b"x a a a a a a x a a a a a a x a a a a a a x a a a a a a x".split()
    runs = periods.find_runs([words])[0]
    assert runs == plain_runs(words) and {r[2] for r in runs} == {1, 7}
    assert periods.collapsed(words, runs) == plain_collapsed(words, runs)


def test_long_periodic_texts():
    one = [b"w"] * 30_000
    many = [b"%d" % (i % 701) for i in range(20_000)]
    words = [b"%d" % (i * i % 97) for i in range(5_000)] + one[:9]
    found = periods.find_runs([one, many, words])
    assert found[:2] == [[(0, 30_000, 1)], [(0, 20_000, 701)]]
    assert found[2] == plain_runs(words)


def test_defined_cases_and_query_columns(spark, docs, tmp_path):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 9), (4, "a " * 9), (None, "b c " * 5), (7, "a b " * 6)]
    rows += [(i, " ".join(random.Random(i).choices("abcdefgh", k=random.Random(i).randint(0, 60)))) for i in range(10, 150)]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = periods.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    expected = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        expected.append(
            (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
             hashlib.sha256("".join(f"{s},{l},{q}\n" for s, l, q in runs).encode()).hexdigest(),
             hashlib.sha256(plain_collapsed(words, runs)).hexdigest())
        )
    assert sorted(map(tuple, out), key=str) == sorted(expected, key=str)
    assert sum(r["n_runs"] for r in out) > 5
    assert out[0].asDict().keys() == {
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"
    }
    assert periods.periodic_runs(docs([])).count() == 0
    with pytest.raises(ValueError):
        periods.periodic_runs(docs([]), times=1)
