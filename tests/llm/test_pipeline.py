"""Every stage of the pipeline on its own input against brute force."""

import hashlib
import os
import random
import sys

import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline
import test_decontaminate
import test_exact
import test_jaccard
from test_language import prose

from tablecare.llm import bpe


def corpus():
    rng = random.Random(3)
    langs = ["aa", "bb", "cc"]
    rows = [(i, prose(langs[i % 3], i, 30 + i % 60), langs[i % 3]) for i in range(150)]
    item = prose("aa", 9999, 14)
    rows += [(200 + i, rows[i][1].replace(" ", "  "), rows[i][2]) for i in range(0, 40, 4)]
    for i in range(0, 30, 3):
        words = rows[i][1].split()
        words[rng.randrange(len(words))] = "sher"
        rows.append((300 + i, " ".join(words), rows[i][2]))
    rows += [(400 + i, prose("bb", 500 + i, 20) + " " + item.upper() + ". " + prose("bb", 600 + i, 5), "bb") for i in range(5)]
    rows += [(500, None, "aa"), (501, "", None), (502, "12 -- 34", "bb"), (None, prose("cc", 77, 30), "cc")]
    return rows, [(1, item), (2, prose("cc", 4, 40)), (3, None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long, keep_id long"
    spark.createDataFrame([(i, t, x, "s", len(t or ""), 7) for i, t, x in rows], schema).write.parquet(
        f"{folder}/documents.parquet"
    )
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def test_stages(spark, tables):
    folder, items = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "jaccard_join", "decontaminate", "byte_bpe",
    ]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    key = lambda i: (i is None, i or 0)
    steps = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, folder)
        path = f"{folder}/stage-{k}"
        out.write.parquet(path)
        if name != "byte_bpe":
            assert out.columns == docs.columns
        docs = spark.read.parquet(path)
        steps[name] = before, docs.collect()

    def ids(name):
        return sorted((r.doc_id for r in steps[name][1]), key=key)

    before, after = steps["language_id"]
    assert not {500, 501, 502} & set(ids("language_id")) and len(after) >= len(before) - 3 - 3
    before, after = steps["exact_dedup"]
    best = {}
    for (i, t), (_, keep, _, _) in zip(before, test_exact.brute(before)):
        best[keep] = t
    assert ids("exact_dedup") == sorted(best, key=key) and len(after) < len(before)
    before, after = steps["jaccard_join"]
    assert ids("jaccard_join") == sorted({c for _, _, c in test_jaccard.brute(before)}, key=key)
    assert len(after) < len(before)
    before, after = steps["decontaminate"]
    clean = [r[0] for r in test_decontaminate.brute(before, items) if not r[5]]
    assert ids("decontaminate") == sorted(clean, key=key) and not {400, 401, 402, 403, 404} & set(clean)
    before, after = steps["byte_bpe"]
    ranks = bpe.Vocabulary(public_tokenizers.path(bpe.VOCABULARY)).rank
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: library.encode_ordinary(t) for i, t in before}
    assert {r.doc_id: list(r.ids) for r in after} == want
    assert all(r.decoded_sha256 == hashlib.sha256(dict(before)[r.doc_id].encode()).hexdigest() for r in after)
    whole = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id for r in whole.collect()), key=key) == ids("byte_bpe")


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
