import hashlib
import random
import re

import pytest

from tablecare.llm import decontaminate as D


def brute_words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items):
    windows = {}
    for item_id, text in items:
        w = brute_words(text)
        size = min(10, len(w))
        for p in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + size]), set()).add(item_id)
    out = []
    for doc_id, text in rows:
        w, hit, found = brute_words(text), set(), set()
        for size in {len(x) for x in windows}:
            for p in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[p : p + size]))) is not None:
                    hit.update(range(p, p + size))
                    found |= own
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def corpus(seed, sizes):
    rng = random.Random(seed)
    words = lambda n: [rng.choice(["a", "b", "c", "Ä", "ä", "x1", "Foo", "日本"]) + rng.choice(["", "q", "z"]) for _ in range(n)]
    texts = [words(n) for n in sizes]
    items = [(i * 3 % 50, rng.choice([" ", ", ", "-\n"]).join(t)) for i, t in enumerate(texts)]
    items += [(7, items[0][1]), (8, items[0][1]), (None, items[0][1].upper()), (9, None), (10, "!!")]
    rows = []
    for i in range(40):
        w = words(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(texts)
            a = rng.randint(0, len(t))
            at = rng.randint(0, len(w))
            w[at:at] = t[a : a + rng.randint(1, 30)]
        rows.append((i, " ".join(w)))
    return rows + [(5, rows[5][1]), (5, "other text"), (None, None), (None, items[0][1]), (60, ""), (61, " ".join(texts[0] * 3000))], items


@pytest.mark.parametrize("seed,sizes,most", [(1, [30, 25, 60, 12], 10**6), (2, [30, 9, 3, 1, 10, 11], 10**6), (3, [5, 14], 0), (4, [2], 10**6), (5, [30, 25, 60, 12], 0)])
def test_equals_brute_force(spark, docs, monkeypatch, request, seed, sizes, most):
    monkeypatch.setattr(D, "BROADCAST_ROWS", most)
    if not most:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    rows, items = corpus(seed, sizes)
    benchmark = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, window string")
    got = D.mark_contaminated(docs(rows), benchmark).drop("mark")
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    key = lambda r: tuple((x is None, x or 0) for x in r[:5])
    want = sorted(brute(rows, items), key=key)
    assert sorted(map(tuple, got.collect()), key=key) == want
    clean = D.keep_clean(docs(rows), benchmark)
    assert clean.columns == docs(rows).columns
    order = lambda i: (i is None, i or 0)
    assert sorted((r.doc_id for r in clean.collect()), key=order) == sorted((r[0] for r in want if not r[5]), key=order)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.mark_contaminated(docs([]), none).collect() == []
    got = D.mark_contaminated(docs([(1, "a b c")]), none).collect()
    assert [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got] == [(1, 3, 0, 0, False)]


def test_runs_that_are_shuffled_carry_few_words(spark, docs, monkeypatch):
    """What a text sends grows with its length, and no key is common to all documents."""
    carried = []
    real = D.carried_runs
    monkeypatch.setattr(D, "carried_runs", lambda own: carried.append(real(own)) or carried[-1])
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    rng = random.Random(9)
    rows = [(n, " ".join(f"w{rng.randint(0, 999)}" for _ in range(n))) for n in (500, 5_000, 50_000)]
    items = spark.createDataFrame([(1, rows[0][1][:300]), (2, "w1 w2 w3")], "item_id long, text string")
    assert {r.doc_id for r in D.mark_contaminated(docs(rows), items).where("contaminated").collect()} >= {500}
    runs = carried[0].groupBy("doc_id").agg({"*": "count"}).collect()
    words = {r.doc_id: r.n for r in carried[0].selectExpr("doc_id", "size(part) AS n").groupBy("doc_id").agg({"n": "sum"}).toDF("doc_id", "n").collect()}
    assert all(words[n] < 9 * n for n in (500, 5_000, 50_000)) and len(runs) == 3
    assert carried[0].groupBy("print", "size").count().agg({"count": "max"}).first()[0] < 1000
