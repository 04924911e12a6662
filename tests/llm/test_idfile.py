import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tablecare.llm import idfile


@pytest.mark.parametrize("top", [0, 1, 2, 7, 40, 500, 50257, 2**30, 2**59, 2**60 - 1, 2**62, 2**64 - 1])
def test_words_round_trip(top):
    rng = random.Random(top)
    for n in (0, 1, 2, 239, 240, 241, 1023, 1024, 1025, 5000):
        ids = np.array([rng.randint(0, top) if rng.random() < 0.8 else 0 for _ in range(n)], np.uint64)
        words, index = idfile.pack(ids)
        assert (idfile.unpack(words) == ids).all()
        assert len(index) == -(-n // idfile.BLOCK)
        for b in range(len(index)):
            end = int(index[b + 1]) if b + 1 < len(index) else len(words)
            block = idfile.unpack(words[int(index[b]) : end])
            assert (block == ids[b * idfile.BLOCK : (b + 1) * idfile.BLOCK]).all()


def test_escapes_that_look_like_escapes():
    ids = np.array([2**64 - 1, 2**64 - 1, 1, 15 << 60, 3] * 300, np.uint64)
    words, _ = idfile.pack(ids)
    assert (idfile.unpack(words) == ids).all()


def test_selectors_that_fit_no_run_end_the_search(monkeypatch):
    tried, copyto = [], np.copyto
    monkeypatch.setattr(np, "copyto", lambda *a, **k: tried.append(a) or copyto(*a, **k))
    ids = np.array([40_000] * 1000 + [0], np.uint64)
    assert (idfile.unpack(idfile.pack(ids)[0]) == ids).all()
    assert len(tried) == 2


def test_file_round_trip():
    keys = [None, -5, 2**62, 7]
    ids = [np.array(x, np.uint64) for x in ([1, 2, 3], [], [50256] * 3000, [0])]
    got_keys, got = idfile.read_file(idfile.file_bytes(keys, ids))
    assert got_keys == keys and all((a == b).all() and len(a) == len(b) for a, b in zip(ids, got))
    with pytest.raises(ValueError):
        idfile.read_file(b"nonsense" * 10)


ROWS = [(i * 37 % 101, f"Document {i}, it's  number\n{i * i} 'll <|endoftext|> é日本" * (i % 9)) for i in range(101)]


@pytest.mark.parametrize("file_ids", [50, 1 << 21])
def test_equals_the_library(docs, file_ids):
    rows = ROWS + [(None, None), (None, "x"), (200, "<|endoftext|>"), (201, " <|endoftext|><|endoftext|>\n<|endoftext|"), (4, "again"), (4, "again"), (2**60 + 1, "w " * 40000)]
    library = Tokenizer.from_file(public_tokenizers.path(idfile.VOCABULARY))
    assert 50256 in library.encode("a <|endoftext|> b", add_special_tokens=False).ids
    got = idfile.read_ids(idfile.write_ids(docs(rows), file_ids=file_ids)).collect()
    got.sort(key=lambda r: r.start)
    order = [r.doc_id for r in got]
    assert order == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    start, want = 0, sorted((i is not None, i or 0, n, crc) for i, n, crc in (
        (i, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes()))
        for i, ids in ((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    ))
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want


def test_empty_table(docs):
    assert idfile.read_ids(idfile.write_ids(docs([]))).collect() == []


def test_workers_get_bounded_batches(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rows = [(i, f"text {i}") for i in range(1500)]
    spark.createDataFrame(rows, "doc_id LONG, text STRING").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    try:
        spark.conf.set(name, 10_000)
        assert idfile.op3_token_files(spark, str(tmp_path)).count() == 1500
        sizes = spark.range(1500, numPartitions=1).mapInArrow(
            lambda batches: (pa.RecordBatch.from_pydict({"id": [b.num_rows]}) for b in batches), "id long"
        )
        assert sorted(r[0] for r in sizes.collect()) == [500, 1000]
    finally:
        spark.conf.set(name, before)
