import hashlib
import random
import re

from tablecare.llm import exact


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    order = lambda i: (i is None, i or 0)
    out = []
    for (i, _), t in zip(rows, norm):
        group = [j for (j, _), u in zip(rows, norm) if u == t]
        out.append((i, min(group, key=order), len(group), hashlib.sha256(t.encode()).hexdigest()))
    return out


ROWS = (
    [(i, random.Random(i % 7).choice(["a  b", "a b", "a\tb", "c", "", " ", "a b"])) for i in range(60)]
    + [(5, "dup"), (5, "dup"), (5, "dup"), (None, "dup"), (None, None), (None, "only null"), (None, "only null")]
    + [(1000 + i, f"text {i}") for i in range(40)]
    + [(2000, "long " * 30000), (1999, "long  " * 30000)]
)


def check(docs, rows):
    got = exact.label_copies(docs(rows)).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(
        brute(rows), key=key
    )
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)
    return kept


def test_labels_and_rows_that_stay(docs):
    kept = check(docs, ROWS)
    stay = exact.keep_first(docs(ROWS))
    assert stay.columns == docs(ROWS).columns
    order = lambda i: (i is None, i or 0)
    assert sorted((r.doc_id for r in stay.collect()), key=order) == sorted((r.doc_id for r in kept), key=order)


def test_without_heavy_groups(docs, monkeypatch):
    monkeypatch.setattr(exact, "HEAVY", 2)
    check(docs, ROWS)


def test_all_alike_and_empty(docs):
    assert len(check(docs, [(3, "x")] * 50)) == 1
    assert exact.label_copies(docs([])).collect() == []
    assert exact.keep_first(docs([])).collect() == []
