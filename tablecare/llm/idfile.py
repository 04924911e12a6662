"""Token ids as binary files of Simple-8b words.

A word has 64 bits. Its top four choose a selector: how many ids it holds and how many bits each
gets (``PACKS``); selector 15 is an escape, whose following word is one id of any 64 bits. Ids
are cut into blocks of ``BLOCK``; a word never crosses a block, and the index holds the number of
words before each block. So blocks are independent: the packer follows all of them at once, and
the reader can begin at any. Both work on whole arrays.

A file is self-contained (little-endian):

    magic "S8B1" | documents u64 | ids u64 | words u64
    key of each document i64 | key present u8 (padded to 8) | ids of each document u64
    words before each block u64 | words u64

Documents are dealt out by ranges of doc_id and sorted, so file after file holds ascending
doc_ids. Files are cells of a table in the shared folder, written by Spark itself, so they work
in any store, and a task that runs again replaces its own file only. Each has its place:
(part, seq).

Defined cases: the string of an added token, such as ``<|endoftext|>``, is that token, as the
library has it; null text is the empty text; an empty document is its end id alone; documents
with a null doc_id come first; documents that repeat follow one another, and of equal doc_ids
the order is by the hash of the text; an empty table gives no files; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablecare.llm.bpe import Remembered, splitter
from tablecare.llm.common import documents, small_batches, staged, text_of

VOCABULARY = "byte_bpe_50k.json"
#: Ids of a block.
BLOCK = 1024
#: A file is closed when it holds so many ids.
FILE_IDS = 1 << 19
#: The id that ends a document.
END = 0
#: Pre-tokens of a generation whose ids a worker remembers: about 80 MB.
REMEMBERED = 400_000
#: Selector, ids of a word, bits of an id. Fixed values of the Simple-8b family; 15 is the escape.
PACKS = (
    (0, 240, 0), (1, 120, 0), (2, 60, 1), (3, 30, 2), (4, 20, 3), (5, 15, 4), (6, 12, 5), (7, 10, 6),
    (8, 8, 7), (9, 7, 8), (10, 6, 10), (11, 5, 12), (12, 4, 15), (13, 3, 20), (14, 1, 60),
)
ESCAPE = 15
_COUNTS = np.array([*(count for _, count, _ in PACKS), 1])
MAGIC = b"S8B1"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of ``ids`` and the number of words before each block."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    ends = np.minimum(np.arange(1, blocks + 1) * BLOCK, n)
    # One row for each block; what is beyond the end fits no word.
    grid = np.full(blocks * BLOCK, ~np.uint64(0))
    grid[:n] = ids
    grid = grid.reshape(blocks, BLOCK)
    chosen = np.full(grid.shape, ESCAPE, np.int8)
    for selector, count, bits in reversed(PACKS):
        fits = grid < np.uint64(1 << bits)
        # Whether this id and the next ones, up to ``count``, all do.
        have = 1
        while have < count:
            more = min(have, count - have)
            fits[:, :-more] &= fits[:, more:]
            fits[:, -more:] = False
            have += more
        # The selectors that are left ask for more ids of fewer bits.
        if not fits.any():
            break
        np.copyto(chosen, np.int8(selector), where=fits)
    chosen = chosen.ravel()
    step = _COUNTS[chosen]
    # All blocks walk from word to word together.
    at, live, starts = np.arange(blocks) * BLOCK, np.arange(blocks), []
    while len(live):
        starts.append(at[live])
        at[live] += step[at[live]]
        live = live[at[live] < ends[live]]
    starts = np.sort(np.concatenate(starts))
    kinds = chosen[starts]
    width = 1 + (kinds == ESCAPE)
    place = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    words[place] = kinds.astype(np.uint64) << np.uint64(60)
    words[place[kinds == ESCAPE] + 1] = ids[starts[kinds == ESCAPE]]
    for selector, count, bits in PACKS:
        mine = kinds == selector
        if bits and mine.any():
            first, word = starts[mine], words[place[mine]]
            for k in range(count):
                word |= ids[first + k] << np.uint64(k * bits)
            words[place[mine]] = word
    return words, place[np.searchsorted(starts, np.arange(blocks) * BLOCK)].astype(np.uint64)


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of ``words``, which begin at a block."""
    if not len(words):
        return np.empty(0, np.uint64)
    kinds = (words >> np.uint64(60)).astype(np.int8)
    marks = np.flatnonzero(kinds == ESCAPE)
    is_head = np.ones(len(words), bool)
    if len(marks):
        # A word after an escape is data, whatever its top bits say.
        previous = -2
        for m in marks.tolist():
            if m != previous + 1:
                is_head[m + 1] = False
                previous = m
    heads = np.flatnonzero(is_head)
    kinds = kinds[heads]
    counts = _COUNTS[kinds]
    place = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    escaped = kinds == ESCAPE
    out[place[escaped]] = words[heads[escaped] + 1]
    for selector, count, bits in PACKS:
        mine = kinds == selector
        if bits and mine.any():
            first, word = place[mine], words[heads[mine]]
            for k in range(count):
                out[first + k] = word >> np.uint64(k * bits) & np.uint64((1 << bits) - 1)
    return out


def file_bytes(keys: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One file of documents."""
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint64)
    words, index = pack(flat)
    present = np.array([k is not None for k in keys], np.uint8)
    present = np.pad(present, (0, -len(present) % 8))
    return b"".join(
        [
            MAGIC,
            struct.pack("<QQQ", len(keys), len(flat), len(words)),
            np.array([k or 0 for k in keys], "<i8").tobytes(),
            present.tobytes(),
            np.array([len(x) for x in ids], "<u8").tobytes(),
            index.astype("<u8").tobytes(),
            words.astype("<u8").tobytes(),
        ]
    )


def read_file(raw: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """Keys and ids of the documents of one file."""
    if raw[:4] != MAGIC:
        raise ValueError("not a file of token ids")
    docs, n, n_words = struct.unpack_from("<QQQ", raw, 4)
    at = 28
    keys = np.frombuffer(raw, "<i8", docs, at).tolist()
    at += 8 * docs
    present = np.frombuffer(raw, np.uint8, docs, at).tolist()
    at += docs + -docs % 8
    sizes = np.frombuffer(raw, "<u8", docs, at).astype(np.int64)
    at += 8 * docs + 8 * (-(-n // BLOCK))
    ids = unpack(np.frombuffer(raw, "<u8", n_words, at).astype(np.uint64))
    if len(ids) != n:
        raise ValueError("a file of token ids is damaged")
    return [k if there else None for k, there in zip(keys, present)], np.split(ids, np.cumsum(sizes)[:-1])


class Encoder:
    """The library's ids, asked for once per pre-token.

    It takes the strings of added tokens out of the text first, special ones too, and gives each its
    id. Its byte-level pre-tokeniser cuts what is between them by ``public_tokenizers.PATTERN`` and
    writes each byte as a character; its model merges inside a pre-token. So the ids of a text are
    those of its added tokens and those that the model gives for its pre-tokens.
    """

    def __init__(self, path: str | None):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        added = library.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that depend on what is around them are not supported")
        self.added = {t.content: np.array([i], np.uint32) for i, t in added.items() if t.content}
        # Of tokens that begin alike the longest is taken.
        self.apart = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))
        self.model = library.model
        self.cut = splitter(public_tokenizers.PATTERN)
        # Printable bytes of Latin-1 stand for themselves, the others for characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.written = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}
        self.space = chr(self.written[ord(" ")])
        self.remembered = Remembered(self._piece, REMEMBERED)

    def encode(self, text: str) -> np.ndarray:
        if not any(token in text for token in self.added):
            return self._plain(text)
        ids, done = [], 0
        for found in self.apart.finditer(text):
            ids += [self._plain(text[done : found.start()]), self.added[found[0]]]
            done = found.end()
        return np.concatenate([*ids, self._plain(text[done:])])

    def _plain(self, text: str) -> np.ndarray:
        return self.remembered.ids(self.cut(text)).view(np.uint32)

    def _piece(self, piece: str) -> list[int]:
        if piece.isascii() and piece.isprintable():
            written = piece.replace(" ", self.space)
        else:
            written = piece.encode().decode("latin-1").translate(self.written)
        return [t.id for t in self.model.tokenize(written)]


@lru_cache(maxsize=1)
def _encoder(path: str | None) -> Encoder:
    return Encoder(path)


def write_ids(docs: DataFrame, path: str | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write the files; the table of files: part, seq, n_ids, file."""

    def rows_of(part: pa.RecordBatch) -> Iterator[tuple[int | None, str]]:
        return zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [{"part": part, "seq": seq, "n_ids": held, "file": file_bytes(keys, ids)}], kind
            )

        encoder = _encoder(path)
        for batch in batches:
            for key, text in (x for at in range(0, batch.num_rows, 128) for x in rows_of(batch.slice(at, 128))):
                keys.append(key)
                ids.append(np.append(encoder.encode(text), np.uint32(END)))
                held += len(ids[-1])
                if held >= file_ids:
                    yield close()
                    keys, ids, held, seq = [], [], 0, seq + 1
        if keys:
            yield close()

    kind = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("file", pa.binary())])
    order = ["doc_id", "tie"]
    return staged(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(files, "part int, seq int, n_ids long, file binary"),
        "ids",
    )


def read_ids(files: DataFrame) -> DataFrame:
    """Read files back; per document: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it. The files' own counts, one row each,
    are summed up; nothing else crosses tasks but one row per document.
    """
    place = ["part", "seq"]
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = parts.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        files.select(*place, F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("inside"))
        .join(base, "part")
        .select(*place, (F.col("base") + F.col("inside")).alias("base"))
    )

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, raw in zip(*(batch.column(x) for x in ("part", "seq", "file"))):
                keys, ids = read_file(raw.as_py())
                sizes = np.array([len(x) for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.as_py()] * len(keys), pa.int32()),
                        pa.array([seq.as_py()] * len(keys), pa.int32()),
                        pa.array(keys, pa.int64()),
                        pa.array(np.cumsum(sizes) - sizes),
                        pa.array(sizes),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    ],
                    ["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    return (
        files.select(*place, "file")
        .mapInArrow(parsed, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
        .join(starts, place)
        .select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return read_ids(write_ids(documents(spark, sf_dir)))
