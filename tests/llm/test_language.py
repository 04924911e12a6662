import zlib

import numpy as np
import pytest

from tablecare.llm import language as L

PARTS = {
    "aa": ["the", "ing", "er", "tion", "and", "sh"],
    "bb": ["ung", "sch", "ein", "ber", "keit", "ö"],
    "cc": ["eau", "eux", "que", "é", "ment", "la"],
}


def prose(lang, seed, words=40):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(PARTS[lang], rng.integers(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def rows():
    langs = list(PARTS)
    return [(i, prose(langs[i % 3], i, 2 + i % 50), langs[i % 3]) for i in range(240)]


@pytest.fixture(scope="module")
def table(spark):
    return lambda rows: spark.createDataFrame(
        [(*r, "s", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double"
    )


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in L.initial(3, 4).items()}
    x, y = rng.integers(97, 123, (5, 9)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    x[2, 6:] = 0
    real, L.np.float32 = L.np.float32, np.float64
    try:
        _, g = L.gradients(w, x, y)
        for k in w:
            at = tuple(np.unravel_index(np.abs(g[k]).argmax(), g[k].shape))
            up, down = ({**w, k: w[k].copy()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            slope = (L.gradients(up, x, y)[0] - L.gradients(down, x, y)[0]) / 2e-5
            assert abs(slope - g[k][at]) < 1e-5 + 1e-3 * abs(slope), k
    finally:
        L.np.float32 = real


def test_held_out_accuracy_and_special_texts(table, rows):
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "123 !?", None), (None, prose("bb", 1), None),
           (903, prose("cc", 5, 9000), None), (903, prose("cc", 5, 9000), None)]
    got = L.predict(table(rows + odd)).collect()
    assert len(got) == len(rows) + len(odd)
    assert set(got[0].asDict()) == {"doc_id", "held_out", "lang_pred", "score"}
    want = {i: lang for i, _, lang in rows}
    held = [r for r in got if r.doc_id in want and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert np.mean([r.lang_pred == want[r.doc_id] for r in held]) >= 0.9
    by_id = {r.doc_id: r for r in got}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert by_id[None].lang_pred == "bb" and by_id[903].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_rows_do_not_matter(table, rows):
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    wrong = [(i, t, "zz" if held(i) else lang) for i, t, lang in rows]
    a, b = (sorted(map(tuple, L.predict(table(x)).collect())) for x in (rows, wrong))
    assert a == b


def test_every_language_with_text_is_learned(table, monkeypatch):
    def learned(i):
        return zlib.crc32(str(i).encode()) % 4 != 2

    ids = [i for i in range(1000) if learned(i)][:420]
    many = [(i, f"text of {i}", f"l{k % 140:03}") for k, i in enumerate(ids)]
    _, labels, languages = L.training_windows(table(many))
    assert len(languages) == 140 and (np.bincount(labels) == 3).all()
    # A fixed total is divided; null and empty texts take no places.
    monkeypatch.setattr(L, "ROWS", 280)
    absent = [(i, None if i % 2 else "", "l000") for i in range(2000, 2400) if learned(i)]
    _, labels, languages = L.training_windows(table(many + absent))
    assert len(languages) == 140 and (np.bincount(labels) == 2).all()
    monkeypatch.setattr(L, "ROWS", 1)
    assert len(L.training_windows(table(many + absent))[2]) == 140


def test_nothing_to_learn_from_and_empty(table):
    got = L.predict(table([(1, "abc", None), (2, None, "aa")])).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert L.predict(table([])).collect() == []


def test_kept_rows_keep_their_columns(table, rows):
    df = table(rows + [(900, None, "aa"), (901, "... 12", "aa")])
    kept = L.keep_identified(df)
    assert kept.schema.simpleString() == df.schema.simpleString()
    got = {tuple(r) for r in kept.collect()}
    assert got <= {tuple(r) for r in df.collect()}
    assert not {900, 901} & {r[0] for r in got} and len(got) >= 0.97 * len(rows)


def test_pooling_by_a_loop_over_bytes():
    """Every byte's label from plain recurrences, and the mean over the bytes of letters."""
    rng = np.random.default_rng(6)
    network = L.Network(["a", "b", "c"], L.initial(3, 4, seed=7))
    w = {k: v.astype(np.float64) for k, v in network.weights.items()}
    texts = ["", None, "abc", "é日本 12", "".join(chr(x) for x in rng.integers(32, 300, 333)), "x" * L.WINDOW, "y z" * 100]
    got = L.document_probabilities(network, texts)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for text, found in zip(texts, got):
        raw = (text or "").encode()
        raw += b"\0" * (-len(raw) % L.WINDOW)
        total, n = np.zeros(3), 0
        for at in range(0, len(raw), L.WINDOW):
            window = raw[at : at + L.WINDOW]
            states = {}
            for d in "fb":
                h = np.zeros(4)
                for t in range(L.WINDOW) if d == "f" else reversed(range(L.WINDOW)):
                    x, a = w["in" + d][window[t]], h @ w["re" + d]
                    update, reset = sigmoid(x[:4] + a[:4]), sigmoid(x[4:8] + a[4:8])
                    h = h + update * (np.tanh(x[8:] + reset * a[8:]) - h)
                    states[d, t] = h
            for t, byte in enumerate(window):
                if byte >= 128 or chr(byte).isalpha():
                    z = np.concatenate([states["f", t], states["b", t]]) @ w["out"] + w["bias"]
                    total, n = total + np.exp(z) / np.exp(z).sum(), n + 1
        assert np.allclose(found, total / max(n, 1), atol=1e-4)


def test_least_hashed_is_the_plain_sample(spark):
    from pyspark.sql import functions as F

    from tablecare.llm.common import least_hashed

    rows = spark.range(20_000).selectExpr("id AS k", "concat('g', id % 3) AS g")
    hot = spark.range(30_000).selectExpr("CAST(7 AS BIGINT) AS k", "'g9' AS g").unionByName(spark.range(9).selectExpr("id AS k", "'g9' AS g"))
    rows = rows.unionByName(hot)
    got = sorted(map(tuple, least_hashed(rows, "g", "k", lambda n: 40 // n).collect()))
    want = []
    for g in ("g0", "g1", "g2", "g9"):
        keys = rows.where(F.col("g") == g).select("g", "k", F.xxhash64("k").alias("h")).distinct().collect()
        want += [(r.g, r.k) for r in sorted(keys, key=lambda r: r.h)[:10]]
    assert got == sorted(want)
    assert least_hashed(rows.where("false"), "g", "k", lambda n: 5).count() == 0
