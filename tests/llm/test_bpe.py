import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from tablecare.llm import bpe


@pytest.fixture(scope="module")
def library():
    ranks = bpe.Vocabulary(public_tokenizers.path(bpe.VOCABULARY)).rank
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "", " ", "Hello, it's 12 o'clock   now\n\n\tfoo'll 'LL", "x" * 700, "  \n " * 300, "a" * 70 + "é" * 90,
    "日本語のテキスト 🙂 and 'r 're 've" * 9, "word " * 400 + "tail", "ab  " * 200 + "\n\n" * 50 + "end", "\x00�<|endoftext|>",
]


@pytest.mark.parametrize("chunk,overlap", [(64, 20), (32, 8), (500, 60), (32768, 512)])
def test_equals_the_library(docs, library, chunk, overlap):
    rows = list(enumerate(TEXTS)) + [(None, None), (3, "x" * 700), (8, TEXTS[8]), (None, TEXTS[7]), (2**60 + 1, "big id")]
    got = bpe.encode(docs(rows), chunk=chunk, overlap=overlap).collect()
    want = [(i, library.encode_ordinary(t or "")) for i, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(want, key=key)


def test_digests_and_decoding(docs, library):
    got = {r.doc_id: r for r in bpe.token_digests(docs(list(enumerate(TEXTS))), chunk=100, overlap=30).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode_ordinary(t)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_decoding_null_ids(spark):
    tokens = spark.createDataFrame([(1, [5, 6]), (2, None), (None, [])], "doc_id long, ids array<int>")
    raw = bpe.Vocabulary(public_tokenizers.path(bpe.VOCABULARY)).bytes
    got = {r.doc_id: bytes(r.bytes) for r in bpe.decode(tokens).collect()}
    assert got == {1: raw[5] + raw[6], 2: b"", None: b""}


def test_empty_table(docs):
    assert bpe.token_digests(docs([])).collect() == []


@pytest.mark.parametrize("chunk,overlap", [(8, 5), (30, 12), (200, 40)])
def test_chunks_inside_a_task_are_stitched(chunk, overlap):
    cut, rng = bpe.splitter(public_tokenizers.PATTERN), random.Random(chunk)
    for t in TEXTS + ["".join(rng.choices("ab 1's\n!ré'll  ", k=rng.randint(0, 900))) for _ in range(400)]:
        assert bpe.stitched(cut, t, chunk, overlap) == cut(t)
    long = "x" * 400_000 + " " + "y z " * 50_000
    assert bpe.stitched(cut, long) == cut(long)


def test_texts_of_a_few_chunks(docs, library):
    rows = [(i, t * (3 * bpe.INNER // max(1, len(t)))) for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r.ids for r in bpe.encode(docs(rows)).collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in rows}


def test_both_engines_split_alike():
    full, cut, rng = regex.compile(public_tokenizers.PATTERN), bpe.splitter(public_tokenizers.PATTERN), random.Random(1)
    pool = [chr(c) for c in range(0x2100) if not 0xD800 <= c < 0xE000]
    for c in pool:
        for t in (c, f"a{c}b", f" {c}1", f"'{c}s {c}{c}"):
            assert cut(t) == full.findall(t)
    for _ in range(5000):
        t = "".join(rng.choice(pool) if rng.random() < 0.3 else rng.choice("ab 1'sré\n!_  ll") for _ in range(25))
        assert cut(t) == full.findall(t)


def test_a_batch_of_long_texts_is_taken_in_parts(spark, tmp_path):
    rows = [{"doc_id": i, "digest": "d", "c": 1, "last": 2, "text": "ab c " * 40} for i in range(100)]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema(list(bpe.SPLIT_TYPE)[:5]))
    marked = list(bpe._boundaries(iter([batch]), 100, 20, public_tokenizers.PATTERN))
    assert sum(b.num_rows for b in marked) == 300 and max(b.num_rows for b in marked) <= 48
    seams = {"copies": [1] * 100, "start": [100] * 100, "stop": [200] * 100}
    for name, values in seams.items():
        batch = batch.append_column(name, pa.array(values, pa.int64()))
    encoded = list(bpe._piece_ids(iter([batch]), 100, public_tokenizers.PATTERN, None))
    assert sum(b.num_rows for b in encoded) == 100 and max(b.num_rows for b in encoded) <= 16

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.createDataFrame([(1, "a")], "doc_id LONG, text STRING").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r["n_tokens"] for r in bpe.op1_byte_bpe(spark, str(tmp_path)).collect()] == [1]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1_000


def test_characters_up_to_ffff_need_the_quicker_engine_only(monkeypatch):
    text = "x² ½a  Ⅷ'll é日本'sa\x1c_ \u00a0\u3000\u180e१२ ೲ٣b\n"
    want = regex.findall(public_tokenizers.PATTERN, text)
    monkeypatch.setattr(bpe.regex, "compile", lambda pattern: None)
    assert bpe.splitter(public_tokenizers.PATTERN)(text) == want
