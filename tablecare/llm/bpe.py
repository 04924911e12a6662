"""Byte-level BPE: overlapping chunks are split into pre-tokens, stitched, and encoded.

A text becomes chunks that overlap by ``overlap`` characters, and every chunk is pre-tokenised by
itself, wherever it lies. The pattern looks ahead only, so once two neighbours have a boundary
in common inside their overlap, both agree from there on: the first such boundary is the seam.
Boundaries within ``MARGIN`` characters of a cut are not trusted, since a match could have gone
on. Each chunk then encodes the pre-tokens between its two seams, and the ids are put together
in order.

There are two sizes of chunk. Those of ``INNER`` characters lie in one task, which stitches them as
it goes; where an overlap holds no common boundary (one pre-token longer than the overlap), the
chunk grows. Texts beyond ``chunk + overlap`` characters are dealt out to tasks in
chunks of that size first, which are stitched by joining their boundaries; without a common one
such a text is not dealt out: it is one cell of one row anyway.

Decoding looks the bytes of each id up and concatenates them.

Defined cases: null text is the empty text and has no ids; null ids decode to no bytes; rows
that repeat are each encoded; a null doc_id is kept; other columns are ignored; an id that is
not in the vocabulary is an error. Lone surrogates cannot occur in a Spark string.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecare.llm.common import documents, small_batches, staged, text_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Characters of a chunk that is dealt out, of one inside a task, and of an overlap.
CHUNK, INNER, OVERLAP = 1 << 16, 1 << 12, 512
#: A contraction such as 'll looks this many characters ahead.
MARGIN = 3
#: Pre-tokens of a generation whose ids a worker remembers: about 25 MB.
REMEMBERED = 120_000
#: Rows that a worker turns into Python objects at a time: of whole short texts, and of long ones or their chunks.
TOGETHER, CHUNKS_TOGETHER = 128, 16


class Remembered(dict):
    """Ids of pre-tokens seen lately, four bytes an id, so that joining them is all that a text takes.

    Two generations: when the younger is full the older goes, so what recurs is never forgotten.
    """

    def __init__(self, encode: Callable[[str], Iterable[int]], most: int = REMEMBERED):
        super().__init__()
        self.encode, self.most = encode, most
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = array("i", self.encode(piece)).tobytes()
        self[piece] = found
        return found

    def ids(self, pieces: list[str]) -> np.ndarray:
        """The ids of ``pieces``, one after the other."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, pieces)), np.int32)


class Vocabulary:
    """Ranks of byte strings; encodes one pre-token by merging the pair of lowest rank first."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = {b: a for a, b in self.rank.items()}
        self.encode = Remembered(self._piece).ids

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each list's ids, one after the other."""
        flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy().tolist()
        of = self.bytes.__getitem__
        out = [
            b"".join(map(of, flat[a:b].tolist())) if known else b""
            for a, b, known in zip(ends, ends[1:], ids.is_valid().to_pylist())
        ]
        return pa.array(out, pa.binary())

    def _piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        whole = self.rank.get(raw)
        return [whole] if whole is not None else self._merge(raw)

    def _merge(self, raw: bytes) -> list[int]:
        if len(raw) > 64:
            return self._merge_long(raw)
        rank, none = self.rank, 1 << 62
        parts = [raw[i : i + 1] for i in range(len(raw))]
        ranks = [rank.get(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] + parts[i + 1], none)
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + parts[i], none)
        return [rank[p] for p in parts]

    def _merge_long(self, raw: bytes) -> list[int]:
        """The same order of merges, with a heap of pairs over a linked list of parts."""
        rank, n = self.rank, len(raw)
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (r := rank.get(raw[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if j == 0 or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(rank[raw[i : end[i]]])
            i = end[i]
        return out


@lru_cache(maxsize=2)
def _vocabulary(path: str | None) -> Vocabulary:
    return Vocabulary(path or public_tokenizers.path(VOCABULARY))


class Alike(dict):
    """Whether a character is the same to ``re`` and ``regex``: as a letter, a number and white space."""

    PAIRS = [(re.compile(a), regex.compile(b)) for a, b in ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\s"))]

    def __missing__(self, c: str) -> bool:
        self[c] = all((a.match(c) is None) == (b.match(c) is None) for a, b in self.PAIRS)
        return self[c]


def _ranges(kind: str) -> str:
    """The characters up to U+FFFF that ``regex`` counts as ``kind``, written for a class of ``re``."""
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    return "".join(f"\\u{ord(run[0][0]):04x}-\\u{ord(run[0][-1]):04x}" for run in regex.finditer(f"{kind}+", plane))


def splitter(pattern: str):
    """A function from a text to its pre-tokens. Texts up to U+FFFF, and others whose characters are
    the same to both, go to the quicker engine of the standard library."""
    full = regex.compile(pattern)
    if pattern != public_tokenizers.PATTERN:
        return full.findall
    space, letter, number = map(_ranges, (r"\s", r"\p{L}", r"\p{N}"))
    # No character is of two kinds, so what a run has taken is never given back.
    plane = re.compile(
        pattern.replace(" ?", " ?+")
        .replace(r"[^\s\p{L}\p{N}]+", f"[^{space}{letter}{number}]++")
        .replace(r"\p{L}+", f"[{letter}]++")
        .replace(r"\p{N}+", f"[{number}]++")
        .replace(r"\S", f"[^{space}]")
        .replace(r"\s", f"[{space}]")
    )
    beyond = re.compile("[\U00010000-\U0010ffff]")
    bare = re.compile(
        pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    )
    alike = Alike()

    def split(text: str) -> list[str]:
        if text.isascii() or not beyond.search(text):
            return plane.findall(text)
        return (bare if all(map(alike.__getitem__, set(text))) else full).findall(text)

    return split


def stitched(cut: Callable[[str], list[str]], text: str, chunk: int = INNER, overlap: int = OVERLAP) -> list[str]:
    """The pre-tokens of ``text``, from chunks that are cut apart one by one."""
    size = chunk + overlap
    pieces, base, end = cut(text[:size]), 0, min(len(text), size)
    out: list[str] = []
    seam = 0  # how many of ``pieces`` belong to the chunk before
    while end < len(text):
        start = end - overlap
        ahead_end = min(len(text), start + size)
        ahead = cut(text[start:ahead_end])
        # Boundaries of both chunks, from the overlap's first character on.
        ours = list(accumulate(map(len, pieces), initial=base))
        theirs = {b: k for k, b in enumerate(accumulate(map(len, ahead), initial=start)) if b <= end - MARGIN}
        at = next((k for k in range(max(seam, bisect_left(ours, start)), len(ours)) if ours[k] in theirs), None)
        if at is None:
            # Twice as much at a time, so that a text which is one pre-token is read a few times only.
            ahead_end = min(len(text), max(ahead_end, 2 * end - ours[seam]))
            pieces = pieces[:seam] + cut(text[ours[seam] : ahead_end])
        else:
            out += pieces[seam:at]
            pieces, base, seam = ahead, start, theirs[ours[at]]
        end = ahead_end
    return out + pieces[seam:]


def splitter_of_chunks(pattern: str):
    """A function from a text to its pre-tokens, chunk by chunk."""
    cut = splitter(pattern)
    return lambda text: stitched(cut, text) if len(text) > INNER + OVERLAP else cut(text)


def _lists(values: list[np.ndarray]) -> pa.Array:
    """Arrow lists of ``values``."""
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *values])))


CHUNK_ROW = "doc_id long, digest string, c int, last int, text string"
SPLIT_ROW = CHUNK_ROW + ", head array<long>, tail array<long>, tail_before array<long>, head_after array<long>"
SPLIT_TYPE = pa.schema(
    [("doc_id", pa.int64()), ("digest", pa.string()), ("c", pa.int32()), ("last", pa.int32()), ("text", pa.string())]
    + [(x, pa.list_(pa.int64())) for x in ("head", "tail", "tail_before", "head_after")]
)
ONE = "doc_id long, ids array<int>"


def _slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, so many at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def _splits(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    kind = pa.schema(list(SPLIT_TYPE)[:5])
    for batch in _slices(batches, 1):
        for r in batch.to_pylist():
            text = r["text"]
            last = max(0, -(-(len(text) - overlap) // chunk) - 1)
            for first in range(0, last + 1, 64):
                rows = [
                    r
                    | {
                        "c": c,
                        "last": last,
                        "text": text[c * chunk : len(text) if c == last else (c + 1) * chunk + overlap],
                    }
                    for c in range(first, min(first + 64, last + 1))
                ]
                yield pa.RecordBatch.from_pylist(rows, kind)


def _boundaries(
    batches: Iterator[pa.RecordBatch], chunk: int, overlap: int, pattern: str
) -> Iterator[pa.RecordBatch]:
    """Three rows of a chunk: itself, the end's boundaries for the next, the head's for the one before."""
    cut = splitter_of_chunks(pattern)
    for batch in _slices(batches, CHUNKS_TOGETHER):
        out = []
        for r in batch.to_pylist():
            c, key = r["c"], {"doc_id": r["doc_id"], "digest": r["digest"]}
            found = [0, *accumulate(map(len, cut(r["text"])))][:-1]
            if c:
                r["head"] = [c * chunk + b for b in found if b <= overlap]
                out.append(key | {"c": c - 1, "head_after": r["head"]})
            if c < r["last"]:
                trusted = len(r["text"]) - MARGIN
                r["tail"] = [c * chunk + b for b in found if chunk <= b <= trusted]
                out.append(key | {"c": c + 1, "tail_before": r["tail"]})
            out.append(r)
        yield pa.RecordBatch.from_pylist(out, SPLIT_TYPE)


def _piece_ids(
    batches: Iterator[pa.RecordBatch], chunk: int, pattern: str, path: str | None
) -> Iterator[pa.RecordBatch]:
    """Encode the pre-tokens of each chunk from one seam to the other."""
    cut, vocabulary = splitter_of_chunks(pattern), _vocabulary(path)
    for batch in _slices(batches, CHUNKS_TOGETHER):
        ids = []
        for c, text, start, stop in zip(*(batch.column(x).to_pylist() for x in ("c", "text", "start", "stop"))):
            # Up to the end of the chunk, beyond the seam, so that the last ones see what follows them.
            pieces = cut(text[start - c * chunk :])
            ids.append(vocabulary.encode(pieces[: bisect_left([*accumulate(map(len, pieces), initial=0)], stop - start)]))
        kept = [batch.column(x) for x in ("doc_id", "digest", "c", "last", "copies")]
        yield pa.RecordBatch.from_arrays(
            [*kept, _lists(ids)], ["doc_id", "digest", "c", "last", "copies", "ids"]
        )


def _text_ids(
    batches: Iterator[pa.RecordBatch], pattern: str, path: str | None, decoded: bool = False
) -> Iterator[pa.RecordBatch]:
    """Encode whole texts; with ``decoded``, the bytes of their ids too."""
    cut, vocabulary = splitter_of_chunks(pattern), _vocabulary(path)
    for part in _slices(batches, TOGETHER):
        ids = _lists([vocabulary.encode(cut(text)) for text in part.column("text").to_pylist()])
        if decoded:
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), ids, vocabulary.decode(ids)], ["doc_id", "ids", "bytes"]
            )
        else:
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])


def encode(
    docs: DataFrame,
    path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    decoded: bool = False,
) -> DataFrame:
    """(doc_id, ids) for every row of ``docs`` (doc_id, text).

    With ``decoded`` also bytes, as ``decode`` gives them. Most texts are then encoded and decoded by
    the same worker, where two at a time would each hold a vocabulary.
    """
    if not chunk > overlap > MARGIN:
        raise ValueError("chunk > overlap > MARGIN is needed")
    one = f"{ONE}, bytes binary" if decoded else ONE
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    is_long = F.char_length("text") > chunk + overlap
    short = texts.where(~is_long).mapInArrow(lambda batches: _text_ids(batches, pattern, path, decoded), one)

    # Rows of long texts that repeat share their chunks, and are counted.
    long = texts.where(is_long).withColumn("digest", F.sha2("text", 256))
    key = ["doc_id", "digest"]
    chunks = staged(
        long.mapInArrow(lambda batches: _splits(batches, chunk, overlap), CHUNK_ROW)
        .repartition("digest", "c")
        .mapInArrow(
            lambda batches: _boundaries(batches, chunk, overlap, pattern), SPLIT_ROW
        )
        .groupBy(*key, "c")
        .agg(
            F.count("last").alias("copies"),
            *(F.max(x).alias(x) for x in ("last", "text", "head", "tail", "tail_before", "head_after")),
        )
        .withColumns(
            {
                "start": F.when(F.col("c") == 0, F.lit(0)).otherwise(
                    F.array_min(F.array_intersect("tail_before", "head"))
                ),
                "stop": F.when(
                    F.col("c") == F.col("last"), F.col("c") * F.lit(chunk).cast("long") + F.char_length("text")
                ).otherwise(F.array_min(F.array_intersect("tail", "head_after"))),
            }
        )
        .select(*key, "c", "last", "copies", "text", "start", "stop"),
        "chunks",
    )
    seamless = F.col("start").isNull() | F.col("stop").isNull()
    single = chunks.where(seamless).select(*key).distinct()
    whole = (
        long.alias("l")
        .join(single.alias("s"), _same_key("l", "s"), "left_semi")
        .mapInArrow(lambda batches: _text_ids(batches, pattern, path, decoded), one)
    )
    stitched = (
        chunks.where(~seamless)
        .mapInArrow(
            lambda batches: _piece_ids(batches, chunk, pattern, path),
            "doc_id long, digest string, c int, last int, copies long, ids array<int>",
        )
        .groupBy(*key, "copies")
        .agg(F.array_sort(F.collect_list(F.struct("c", "ids"))).alias("parts"), F.max("last").alias("last"))
        .alias("t")
        .join(single.alias("s"), _same_key("t", "s"), "left_anti")
        .select(
            "doc_id",
            F.flatten(F.col("parts.ids")).alias("ids"),
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))),
        )
        .select("doc_id", "ids")
    )
    return short.unionByName(decode(stitched, path) if decoded else stitched).unionByName(whole)


def _same_key(a: str, b: str):
    return F.col(f"{a}.digest").eqNullSafe(F.col(f"{b}.digest")) & F.col(f"{a}.doc_id").eqNullSafe(
        F.col(f"{b}.doc_id")
    )


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``tokens`` (doc_id, ids) with the column ``bytes``: the bytes of all ids, one after the other."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        for part in _slices(batches, TOGETHER):
            yield pa.RecordBatch.from_arrays(
                [*part.columns, vocabulary.decode(part.column("ids"))], ["doc_id", "ids", "bytes"]
            )

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(
        joined, "doc_id long, ids array<int>, bytes binary"
    )


def token_digests(docs: DataFrame, **settings) -> DataFrame:
    """Encode and decode; per row: doc_id, n_tokens, ids, ids_sha256, decoded_sha256."""
    return encode(docs, decoded=True, **settings).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return token_digests(documents(spark, sf_dir)).drop("ids")
