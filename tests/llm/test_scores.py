import math
import random
import re
import zlib

import numpy as np
import pytest
import regex

from tablecare.llm import quality as Q
from tablecare.llm import toxicity as T


def rows_and_labels(seed=0, n=400):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["the", "er", "on", "ing", "sh", "an"]) for _ in range(rng.randint(1, 3)))
    bad_words = ["grumbo", "vexel", "vexelan", "vexelor", "snarf", "plonk"]
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 80))]
        poor, toxic = i % 4 == 0, i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randint(0, len(words)), rng.choice(bad_words))
        text = " ".join(w + "%%%" for w in words) if poor and i % 8 else " ".join(w for w in words for _ in range(6 if poor else 1))
        rows.append((i, text))
        if i % 3:
            labels.append((i, int(not poor), int(toxic)))
    return rows, labels


ODD = [(900, None), (901, ""), (None, "the er on"), (902, "word " * 40000), (903, "é日本 🙂"), (903, "é日本 🙂")]


@pytest.fixture(scope="module")
def label_table(spark):
    return lambda rows: spark.createDataFrame(
        [(*r, "x") for r in rows], "doc_id long, quality int, toxic int, text string"
    )


def folds(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


@pytest.mark.parametrize("module,column,n,held", [(Q, 1, 3, 1), (T, 2, 5, 0)])
def test_held_out_accuracy(docs, label_table, module, column, n, held):
    rows, labels = rows_and_labels()
    truth = {i: int(i % 4 != 0) if column == 1 else int(i % 5 == 0) for i, _ in rows}
    got = module.predict(docs(rows + ODD), label_table(labels)).collect()
    assert len(got) == len(rows) + len(ODD)
    assert set(got[0].asDict()) == {"doc_id", "held_out", "score", "predicted"}
    assert all(r.held_out == (folds(r.doc_id, n) == held) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    own = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in own]) >= 0.9

    # Labels of held-out rows change nothing, nor do rows that contradict each other or have none.
    def other(r):
        return (r[0], 1 - r[1], 1 - r[2]) if folds(r[0], n) == held else r

    more = [other(r) for r in labels] + [(77777, 1, 1), (77777, 0, 0), (None, 1, 1), (88888, None, None)]
    again = [r for r in module.predict(docs(rows + ODD), label_table(more)).collect() if r.doc_id in truth]
    score = {r.doc_id: r.score for r in got if r.doc_id in truth}
    assert all(abs(score[r.doc_id] - r.score) < 1e-5 for r in again)


def test_nothing_to_learn_from(docs, label_table):
    rows = [(1, "a b"), (2, "c d"), (3, None)]
    for module, few, score in ((Q, [], 0.5), (Q, [(i, 1, 0) for i in range(12)], 1.0), (T, [], 0.0)):
        got = module.predict(docs(rows), label_table(few)).collect()
        assert {r.score for r in got} == {score} and len(got) == 3
        assert module.predict(docs([]), label_table(few)).collect() == []


def test_exact_neighbours():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(50, 6)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = np.arange(50) % 2
    projection = rng.normal(size=(Q.TERMS, 6)).astype(np.float32)
    model = Q.Model(np.ones(Q.TERMS, np.float32), projection, vectors, labels, np.full(50, 0.04), 0.7)
    texts = ["some text here", "other words", ""]
    z = Q.latent(np.array([Q.counts_of(t) for t in texts]), model.idf) @ projection
    for text, v, got in zip(texts, z, model.scores(texts)):
        if not text:
            assert got == 0.7
            continue
        near = sorted(((float(v @ w) / np.linalg.norm(v), k) for w, k in zip(vectors, labels)), reverse=True)[: Q.NEIGHBOURS]
        votes = [(max(s, 0), k) for s, k in near]
        assert abs(sum(s * k for s, k in votes) / sum(s for s, _ in votes) - got) < 1e-4


def test_label_model_finds_good_and_repeated_voters():
    rng = np.random.default_rng(4)
    y = rng.random(3000) < 0.3
    good = [np.where(y & (rng.random(3000) < 0.6), 1, 0) for _ in range(6)]
    noise = [np.where(rng.random(3000) < 0.2, 1, 0) for _ in range(2)]
    clean = np.where(np.any(good, 0), 0, -1)
    votes = np.stack([*good, good[0], good[0], *noise, clean], 1).astype(np.int8)
    posterior, say = T.label_model(votes, 0.3, 8)
    assert ((posterior > 0.5) == y).mean() > 0.97
    assert say[0] < 0.5 and say[6] < 0.5 and say[1] > 0.7


def test_few_toxic_rows_and_few_clean_ones(docs, label_table):
    rng = random.Random(5)
    clean_text = lambda: " ".join(rng.choice(["the", "shing", "eran", "onth", "ingre", "ndst", "thera", "oner"]) for _ in range(30))

    def scores(toxic, clean):
        learned = [i for i in range(4 * (toxic + clean) + 20) if folds(i, 5)]
        bad, good, free = learned[:toxic], learned[toxic : toxic + clean], learned[toxic + clean :]
        rows = [(i, f"{clean_text()} grumbo {clean_text()}") for i in [*bad, free[0]]] + [(i, clean_text()) for i in [*good, free[1]]]
        labels = [(i, 1, 1) for i in bad] + [(i, 1, 0) for i in good]
        got = {r.doc_id: r.score for r in T.predict(docs(rows), label_table(labels)).collect()}
        return got[free[0]], got[free[1]]

    for toxic, clean in ((4, 96), (40, 960), (12, 8)):
        high, low = scores(toxic, clean)
        assert high >= 0.5 > low, (toxic, clean)
    # Nothing can be told from one row, or without clean ones.
    assert scores(1, 5) == scores(9, 0) == (0.0, 0.0)


def test_chance_by_counting():
    from itertools import combinations

    draws = [sum(x < 4 for x in c) for c in combinations(range(9), 3)]
    for least in range(5):
        assert abs(T.by_chance(least, 3, 4, 9) - np.mean([d >= least for d in draws])) < 1e-9


@pytest.mark.parametrize("module,column", [(Q, 1), (T, 2)])
def test_one_doc_id_on_many_rows_counts_once(docs, label_table, spark, module, column):
    rows, labels = rows_and_labels()
    hot = next(i for i, *_ in labels if i % 5 == 0 and i % 4 == 0 and folds(i, 15) and folds(i, 3) != 1 and folds(i, 5))
    base = docs([r for r in rows if r[0] != hot])
    one = docs([(hot, "grumbo vexel the shing eran " * 3)])
    many = spark.range(10_000).select().crossJoin(one)
    model = [module.fit(base.unionByName(x.select(base.columns)), label_table(labels)) for x in (one, many)]
    if module is T:
        assert model[0].voters.lexicon == model[1].voters.lexicon
        assert np.allclose(model[0].weights, model[1].weights)
    else:
        assert len(model[0].vectors) == len(model[1].vectors) and (model[0].labels == model[1].labels).all()


def test_toxicity_scores_by_plain_loops(docs, label_table):
    rows, labels = rows_and_labels(3, 150)
    model = T.fit(docs(rows), label_table(labels))
    texts = [t for _, t in rows] + ["", "GRUMBO!!! vexelitis", "snarf " * 500, "é日本 1234567890"]
    got = model.scores(texts)
    for text, score in zip(texts, got):
        words = set(re.findall("[a-z]+", text.lower()) if text.isascii() else regex.findall(r"\p{L}+", text.lower()))
        total, spoke = model.intercept, False
        for entry, weight in zip(model.voters.lexicon, model.weights):
            if any(w == entry or entry.endswith("*") and w.startswith(entry[:-1]) for w in words):
                total, spoke = total + weight, True
        letters = [c for c in text if "A" <= c <= "Z"], [c for c in text if "a" <= c <= "z" or ord(c) >= 0x80]
        n = max(1, len(text))
        shares = [
            len(letters[0]) / max(1, len(letters[0]) + len(letters[1])),
            text.count("!") / n, sum(c in "#$%&*@^~|<>{}" for c in text) / n, sum("0" <= c <= "9" for c in text) / n,
        ]
        for (which, least, vote), weight in zip(T.PATTERNS, model.weights[len(model.voters.lexicon) :]):
            total += vote * weight * (shares[which] >= least)
        total -= 0 if spoke else model.weights[-1]
        assert abs(score - 1 / (1 + math.exp(-min(30, max(-30, total))))) < 1e-9


def test_label_model_by_plain_loops():
    rng = np.random.default_rng(2)
    votes = rng.choice([-1, 0, 0, 1], (40, 5)).astype(np.int8)
    got, say = T.label_model(votes, 0.3, 3, rounds=2)
    n, m = votes.shape
    p = [0.98 if any(votes[i][j] == 1 for j in range(3)) else 0.02 for i in range(n)]
    for _ in range(2):
        n1, n0 = sum(p) + 1, sum(1 - x for x in p) + 1
        odds = {}
        for j in range(m):
            for v, right in ((1, (0.9, 0.1)), (-1, (0.1, 0.9))):
                a = sum(p[i] for i in range(n) if votes[i][j] == v) + right[0] * 10
                b = sum(1 - p[i] for i in range(n) if votes[i][j] == v) + right[1] * 10
                odds[j, v] = math.log(a / n1) - math.log(b / n0)
        mean = [(sum((1 - p[i]) * votes[i][j] for i in range(n)) / n0, sum(p[i] * votes[i][j] for i in range(n)) / n1) for j in range(m)]
        rest = [[votes[i][j] - (1 - p[i]) * mean[j][0] - p[i] * mean[j][1] for j in range(m)] for i in range(n)]
        spread = [math.sqrt(sum(r[j] ** 2 for r in rest) / n) + 1e-6 for j in range(m)]
        plain = []
        for j in range(m):
            both = [j == k or any(v[j] == v[k] != 0 for v in votes) for k in range(m)]
            c = [1 if j == k else both[k] * sum(r[j] * r[k] for r in rest) / n / spread[j] / spread[k] for k in range(m)]
            plain.append(1 / sum(x for x in c if x > T.DEPENDENT))
        p = [
            1 / (1 + math.exp(-(math.log(0.3 / 0.7) + sum(odds[j, votes[i][j]] * plain[j] for j in range(m) if votes[i][j]))))
            for i in range(n)
        ]
    assert np.allclose(got, p) and np.allclose(say, plain)
