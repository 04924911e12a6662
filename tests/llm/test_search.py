import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tablecare.llm import search


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(rows, items, top=10):
    """Every document scored for every item."""
    words = [(i, Counter(split(t))) for i, t in rows]
    words = [(i, c) for i, c in words if c]
    n_docs, n_words = len(words), sum(sum(c.values()) for _, c in words)
    holders = Counter(t for _, c in words for t in c)
    out = []
    for item, text in items:
        found = []
        for doc_id, c in words:
            m = 10 + 90 * sum(c.values()) * n_docs // n_words
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(split(text))
                if c[t]
            )
            if score:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def corpus(seed, n, vocabulary):
    random.seed(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    return [(i, " ".join(random.choices(words, weights, k=random.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("seed,block,limit", [(1, 4096, 1 << 22), (2, 7, 1 << 22), (3, 50, 200), (4, 1, 1)])
def test_ranks_by_brute_force(spark, docs, monkeypatch, seed, block, limit):
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "FIRST", 2)
    rows = corpus(seed, 300, 80)
    rows += [(1000 + i, rows[5][1]) for i in range(30)]
    items = [(i, " ".join(f"W{random.randint(0, 90)}" for _ in range(random.choice([1, 3, 12, 70])))) for i in range(9)]
    asked = spark.createDataFrame(items, "item_id int, text string")
    found = search.search(docs(rows), asked, limit=limit)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows, items)


def test_masks_of_many_terms_and_what_need_not_be_scored():
    rows = corpus(7, 3000, 500)
    vocabulary = {b"w%d" % i: i for i in range(100)}
    n_words = sum(len(split(t)) for _, t in rows)
    queries = [np.arange(70), np.arange(8, 30), np.array([90, 95])]
    weights = np.arange(1, 101, dtype=np.int64) * 50
    ranking = search.Ranking(queries, weights, 10)
    counts = np.zeros((100, len(rows)), np.int32)
    for k, (_, text) in enumerate(rows):
        for w in split(text):
            if w.encode() in vocabulary:
                counts[vocabulary[w.encode()], k] += 1
    m = np.array([10 + 90 * len(split(t)) * len(rows) // n_words for _, t in rows])
    for at in range(0, len(rows), 500):
        ranking.add([i for i, _ in rows[at : at + 500]], m[at : at + 500], counts[:, at : at + 500])
    for query, best in zip(queries, ranking.best):
        score = (weights[query][:, None] * search._part(counts[query].astype(np.int64), m)).sum(axis=0)
        assert [(-s, d) for s, _, d in best] == sorted(
            ((int(s), i) for i, s in enumerate(score) if s), key=lambda x: (-x[0], x[1])
        )[:10]
    assert ranking.scored < 0.6 * ranking.seen


def test_defined_cases(spark, docs):
    rows = [(3, "Alpha beta"), (2, "alpha BETA"), (2, "alpha BETA"), (None, "alpha beta"), (5, None), (6, ""), (7, "?!")]
    items = [(1, "ALPHA"), (1, "ALPHA"), (None, "beta beta alpha"), (4, None), (5, "none of these"), (6, "")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = search.search(docs(rows), asked, top=3)
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows, items, 3)
    assert search.search(docs([]), asked).count() == 0
    assert search.search(docs(rows), asked.where("false")).count() == 0
    long = docs([(1, "x " * 300_000 + "y"), (2, "y")])
    assert [r["doc_id"] for r in search.search(long, asked.selectExpr("item_id", "'y' AS text").limit(1)).collect()] == [2, 1]
    with pytest.raises(ValueError):
        search.search(docs(rows), asked, top=0)


def test_query_agrees_with_sql(spark):
    folder = "/root/testdata/sf0.01"
    found = search.op13_ranked_search(spark, folder).toPandas()
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = db.execute(search.SQL).df()
    keys = ["item_id", "rank"]
    assert found.sort_values(keys).values.tolist() == want.sort_values(keys)[list(found)].values.tolist()
    assert found["rank"].dtype == "int32" and want["rank"].dtype == "int32" and len(found) == 400
