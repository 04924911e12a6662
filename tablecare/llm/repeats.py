"""Removal of every byte that lies in a string of ``LENGTH`` bytes which occurs more than once.

1. Anchors. Of the ``LENGTH - GRAM + 1`` grams of ``GRAM`` bytes in a window of LENGTH bytes, the
   one with the smallest hash, the leftmost of equal ones, is the window's anchor. Equal windows
   have equal anchors at equal offsets. Windows in a row with the same anchor are a run, and the
   bytes they cover are its segment, less than ``2 * LENGTH`` of them.
2. Anchors that occur once go: their windows are unique. What is left are the repeats' places.
   Counts come from an aggregate that combines in the map tasks, so a common anchor is no burden.
3. Equal segments are one class. A class of several runs is repeated whole.
4. The distinct segments of an anchor are put into one string, and its suffix array (see
   ``suffixes``) brings equal windows next to each other. In that string the anchor's gram is one
   symbol, since all have it, and what no other segment shares at either end is cut off first.
   A task sorts ``TOGETHER`` symbols or one anchor at a time.
5. An anchor of more than ``CROWD`` distinct segments is not gathered anywhere. Its windows are
   split into ``PARTS`` by how many bytes they have before the gram; all windows of a part have a
   longer core in common, and the core is the new anchor of segments that are a part's windows.
   Steps 3 and 4 follow for these. What is still crowded is counted by 128-bit hashes of windows.
6. Repeated windows come back to their documents as spans; documents are judged on the input, so
   all spans are removed at once.

Texts are read as UTF-8 bytes, in parts of ``PART`` windows, so arrays stay small.

Defined cases: null text is the empty text; texts of fewer than LENGTH bytes stay as they are;
rows that repeat are copies of each other; a null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecare.llm.common import documents, staged, text_of
from tablecare.llm.shingles import mixed
from tablecare.llm.suffixes import suffix_array

LENGTH, GRAM = 400, 200
CROWD, PARTS = 128, 8
PART = 1 << 18
#: Symbols sorted together, of several anchors.
TOGETHER = 20_000
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Rolling:
    """Hashes of any spans of some bytes."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        up, self.down = _powers(base, 1 << max(12, int(len(data)).bit_length()))
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.prefix[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[stop] - self.prefix[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.prefix) - size
        return mixed((self.prefix[size:] - self.prefix[:-size]) * self.down[:n])


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row, from the least up to and from block borders."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, ~np.uint64(0))]).reshape(-1, width)
    upto = np.minimum.accumulate(padded, 1).ravel()
    onward = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(onward[:n], upto[width - 1 : width - 1 + n])


def runs_of(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first and last window, anchor, its hash, the segment's hash."""
    parts: list[tuple[np.ndarray, ...]] = []
    width = length - gram + 1
    for at in range(0, len(data) - length + 1, PART):
        rolling = Rolling(data[at : at + PART + length - 1])
        grams = rolling.grams(gram)
        least = window_least(grams, width)
        changes = np.flatnonzero(least[1:] != least[:-1]) + 1
        start, anchor = [], []
        for first, end in zip([0, *changes.tolist()], [*changes.tolist(), len(least)]):
            # The leftmost place of the least value holds for windows up to itself; then the next.
            while first < end:
                place = first + int(grams[first : first + width].argmin())
                start.append(first)
                anchor.append(place)
                first = place + 1
        start, anchor = np.array(start), np.array(anchor)
        last = np.append(start[1:], len(least)) - 1
        segment = mixed(rolling.of(start, last + length) ^ (anchor - start).astype(np.uint64))
        parts.append((at + start, at + last, at + anchor, grams[anchor].view(np.int64), segment.view(np.int64)))
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _shared_ends(texts: list[bytes]) -> list[int]:
    """For each text, the longest beginning it has in common with another one."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    best = [0] * len(texts)
    for i, j in zip(order, order[1:]):
        a, b = texts[i], texts[j]
        low, high = 0, min(len(a), len(b))
        while low < high:
            middle = (low + high + 1) // 2
            if a[:middle] == b[:middle]:
                low = middle
            else:
                high = middle - 1
        best[i], best[j] = max(best[i], low), max(best[j], low)
    return best


def repeated_windows(
    anchors: list[list[tuple[bytes, bytes, bytes]]], length: int, gram: int
) -> list[list[list[tuple[int, int]]]]:
    """For segments (before, gram, after) of some anchors: spans of first bytes of repeated windows.

    Two segments of an anchor that are alike count as one.
    """
    symbols: list[int] = []
    windows: list[tuple[int, int, int, int]] = []
    numbers: dict[bytes, int] = {}
    for i, segments in enumerate(anchors):
        before = _shared_ends([s[0][::-1] for s in segments])
        after = _shared_ends([s[2] for s in segments])
        for j, (left, middle, right) in enumerate(segments):
            a, b = before[j], after[j]
            if a + b + gram < length:
                continue
            cut = len(left) - a
            windows.append((len(symbols), i, j, cut))
            symbols.extend(x + 1 for x in left[cut:])
            symbols.append(257 + numbers.setdefault(middle, len(numbers)))
            symbols.extend(x + 1 for x in right[:b])
            symbols.append(0)
    found: list[list[list[tuple[int, int]]]] = [[[] for _ in segments] for segments in anchors]
    if not windows:
        return found
    # Windows are as many symbols long as bytes that are not the gram's, and one.
    width = length - gram + 1
    starts = [w[0] for w in windows] + [len(symbols)]
    owner = np.full(len(symbols), -1, np.int64)
    for k, (at, _, _, _) in enumerate(windows):
        owner[at : starts[k + 1] - width] = k
    text = np.array(symbols, np.uint32).tobytes()
    order = np.array(suffix_array(symbols), np.int64)
    order = order[owner[order] >= 0].tolist()
    repeated = set()
    for p, q in zip(order, order[1:]):
        if text[4 * p : 4 * (p + width)] == text[4 * q : 4 * (q + width)]:
            repeated.add(p)
            repeated.add(q)
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for p in sorted(repeated):
        at, i, j, cut = windows[owner[p]]
        own = spans.setdefault((i, j), [])
        first = cut + p - at
        if own and own[-1][1] == first - 1:
            own[-1] = (own[-1][0], first)
        else:
            own.append((first, first))
    for (i, j), own in spans.items():
        found[i][j] = own
    return found


KEY = ["doc_id", "mark"]
RUN = "doc_id long, mark long, first int, last int, anchor int, print long, segment long"


def _runs(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [
                    runs_of(np.frombuffer(t.as_py().encode(), np.uint8), length, gram) for t in part.column("text")
                ]
                owner = pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]))
                first, last, anchor, value, segment = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(owner),
                        part.column("mark").take(owner),
                        *(pa.array(x.astype(np.int32)) for x in (first, last, anchor)),
                        pa.array(value),
                        pa.array(segment),
                    ],
                    ["doc_id", "mark", "first", "last", "anchor", "print", "segment"],
                )

    return texts.mapInArrow(rows, RUN)


def _cut_segments(texts: DataFrame, classes: DataFrame, length: int, gram: int) -> DataFrame:
    """(print, segment, copies, crowded, left, middle, right): the bytes of one run of each class."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema(
            [("print", pa.int64()), ("segment", pa.int64()), ("copies", pa.int64()), ("crowded", pa.bool_())]
            + [(x, pa.binary()) for x in ("left", "middle", "right")]
        )
        for batch in batches:
            for wanted, text in zip(batch.column("wanted"), batch.column("text")):
                raw, out = text.as_py().encode(), []
                for w in wanted.as_py():
                    out.append(
                        {x: w[x] for x in ("print", "segment", "copies", "crowded")}
                        | {
                            "left": raw[w["first"] : w["anchor"]],
                            "middle": raw[w["anchor"] : w["anchor"] + gram],
                            "right": raw[w["anchor"] + gram : w["last"] + length],
                        }
                    )
                yield pa.RecordBatch.from_pylist(out, kind)

    wanted = classes.groupBy(F.col("row.doc_id").alias("row_id"), F.col("row.mark").alias("row_mark")).agg(
        F.collect_list(
            F.struct("print", "segment", "copies", "crowded", "row.first", "row.last", "row.anchor")
        ).alias("wanted")
    )
    return (
        texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("row_id")) & (F.col("mark") == F.col("row_mark")))
        .select("text", "wanted")
        .mapInArrow(
            rows,
            "print long, segment long, copies long, crowded boolean, left binary, middle binary, right binary",
        )
    )


def _split_segments(segments: DataFrame, length: int, gram: int) -> DataFrame:
    """Segments of crowded anchors in parts: as segments of the parts' cores, with their owners."""
    kind = pa.schema(
        [(x, pa.int64()) for x in ("print", "segment", "owner_print", "owner_segment", "owner_copies")]
        + [("shift", pa.int32())]
        + [(x, pa.binary()) for x in ("left", "middle", "right")]
    )
    spare = length - gram
    bounds = [spare * i // PARTS for i in range(PARTS)] + [spare + 1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                left, middle, right = r["left"], r["middle"], r["right"]
                for i, (least, end) in enumerate(zip(bounds, bounds[1:])):
                    # Bytes before the gram that this segment's windows of the part have.
                    low, high = max(least, spare - len(right)), min(end - 1, len(left))
                    if low > high:
                        continue
                    core = left[len(left) - least :] + middle + right[: spare - (end - 1)]
                    own = left[len(left) - high :] + middle + right[: spare - low]
                    out.append(
                        {
                            "print": _hash(core, i),
                            "segment": _hash(own, high),
                            "owner_print": r["print"],
                            "owner_segment": r["segment"],
                            "owner_copies": r["copies"],
                            "shift": len(left) - high,
                            "left": left[len(left) - high :],
                            "middle": middle,
                            "right": right[: spare - low],
                        }
                    )
            yield pa.RecordBatch.from_pylist(out, kind)

    return segments.where("crowded").mapInArrow(
        rows,
        "print long, segment long, owner_print long, owner_segment long, owner_copies long, shift int, "
        "left binary, middle binary, right binary",
    )


def _hash(data: bytes, tag: int) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=tag.to_bytes(4, "little")).digest(), "little", signed=True)


def _found_windows(segments: DataFrame, length: int, gram: int) -> DataFrame:
    """(print, segment, from, to): repeated windows of staged segments whose class has one run."""
    parts = staged(_split_segments(segments, length, gram), "parts")
    bytes_of = F.struct("left", "middle", "right")
    classes = parts.groupBy("print", "segment").agg(F.count("*").alias("copies"), F.max(bytes_of).alias("bytes"))
    classes = staged(classes.select("print", "segment", "copies", "bytes.*"), "part-classes")
    crowds = classes.groupBy("print").agg((F.count("*") > CROWD).alias("crowded"), F.count("*").alias("n"))
    inner = classes.join(crowds.where("n > 1").drop("n"), "print")
    last = F.octet_length("left") + F.octet_length("middle") + F.octet_length("right") - length
    whole = classes.where("copies > 1").select("print", "segment", F.lit(0).alias("from"), last.alias("to"))
    within = (
        _sorted_windows(inner, length, gram)
        .unionByName(_counted_windows(inner, length))
        .unionByName(whole)
        .join(
            parts.where("owner_copies = 1").select("print", "segment", "owner_print", "owner_segment", "shift"),
            ["print", "segment"],
        )
        .select(
            F.col("owner_print").alias("print"),
            F.col("owner_segment").alias("segment"),
            (F.col("from") + F.col("shift")).alias("from"),
            (F.col("to") + F.col("shift")).alias("to"),
        )
    )
    return _sorted_windows(segments, length, gram).unionByName(within)


def _sorted_windows(segments: DataFrame, length: int, gram: int) -> DataFrame:
    """(print, segment, from, to): repeated windows by suffix arrays, anchors one after the other."""
    kind = pa.schema([("print", pa.int64()), ("segment", pa.int64()), ("from", pa.int32()), ("to", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: list[dict[int, tuple]] = []
        held, current = 0, None

        def closed() -> pa.RecordBatch:
            spans = repeated_windows([[s[1:] for s in a.values()] for a in anchors], length, gram)
            out = []
            for a, of_anchor in zip(anchors, spans):
                for (segment, (head, *_)), own in zip(a.items(), of_anchor):
                    # Classes of several runs are repeated whole anyway.
                    if head["copies"] == 1:
                        out += [{"print": head["print"], "segment": segment, "from": x, "to": y} for x, y in own]
            return pa.RecordBatch.from_pylist(out, kind)

        for batch in batches:
            for r in batch.to_pylist():
                if r["print"] != current:
                    if held >= TOGETHER:
                        yield closed()
                        anchors, held = [], 0
                    anchors.append({})
                    current = r["print"]
                if r["segment"] not in anchors[-1]:
                    anchors[-1][r["segment"]] = (
                        {"print": r["print"], "copies": r["copies"]}, r["left"], r["middle"], r["right"],
                    )
                    held += len(r["left"]) + len(r["right"]) + 2
        if anchors:
            yield closed()

    return (
        segments.where("NOT crowded")
        .repartition("print")
        .sortWithinPartitions("print")
        .mapInArrow(rows, "print long, segment long, `from` int, `to` int")
    )


def _counted_windows(segments: DataFrame, length: int) -> DataFrame:
    """(print, segment, from, to): repeated windows of crowded anchors, by counting their hashes.

    Classes of several runs are counted, but not told: they are repeated whole anyway.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data = np.frombuffer(r["left"] + r["middle"] + r["right"], np.uint8)
                a, b = (Rolling(data, base).grams(length).view(np.int64) for base in BASES)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(a), r["print"])),
                        pa.array(np.full(len(a), r["segment"])),
                        pa.array(np.full(len(a), r["copies"] == 1)),
                        pa.array(np.arange(len(a), dtype=np.int32)),
                        pa.array(a),
                        pa.array(b),
                    ],
                    ["print", "segment", "single", "from", "a", "b"],
                )

    windows = segments.where("crowded").mapInArrow(
        rows, "print long, segment long, single boolean, `from` int, a long, b long"
    )
    several = (
        windows.groupBy("a", "b")
        .agg(F.min("segment").alias("low"), F.max("segment").alias("high"))
        .where("low <> high")
        .select("a", "b")
    )
    return (
        windows.where("single").join(several, ["a", "b"]).select("print", "segment", "from", F.col("from").alias("to"))
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, spans (start, stop) removed, kept bytes."""
    if not 0 < gram < length:
        raise ValueError("0 < gram < length is needed")
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("mark")
    )
    runs = _runs(texts, length, gram)
    # Staged, so that the join below is one of two shuffles whose large partitions Spark can split.
    seen = staged(
        runs.groupBy("print")
        .agg(F.count("*").alias("n"), F.min("segment").alias("low"), F.max("segment").alias("high"))
        .where("n > 1")
        .select("print", (F.col("low") != F.col("high")).alias("differ")),
        "anchors",
    )
    repeated = staged(runs.join(seen, "print"), "repeated")
    classes = repeated.where("differ").groupBy("print", "segment").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "mark", "first", "last", "anchor")).alias("row")
    )
    classes = staged(classes, "classes")
    crowds = classes.groupBy("print").agg((F.count("*") > CROWD).alias("crowded"))
    segments = staged(_cut_segments(texts, classes.join(crowds, "print"), length, gram), "segments")
    found = _found_windows(segments, length, gram)

    several = classes.where("copies > 1").select("print", "segment")
    whole = repeated.where("NOT differ").unionByName(repeated.where("differ").join(several, ["print", "segment"], "left_semi").select(repeated.columns))
    spans = whole.select(*KEY, F.col("first").alias("start"), (F.col("last") + length).alias("stop")).unionByName(
        repeated.where("differ")
        .join(found, ["print", "segment"])
        .select(*KEY, (F.col("first") + F.col("from")).alias("start"), (F.col("first") + F.col("to") + length).alias("stop"))
    )
    spans = spans.groupBy(F.col("doc_id").alias("row_id"), F.col("mark").alias("row_mark")).agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans")
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema(
            [("doc_id", pa.int64()), ("n_bytes", pa.int64()),
             ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("kept", pa.binary())]
        )
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(at, 256).to_pylist():
                    raw, merged, kept, end = r["text"].encode(), [], [], 0
                    for s in r["spans"] or ():
                        if merged and s["start"] <= merged[-1]["stop"]:
                            merged[-1]["stop"] = max(merged[-1]["stop"], s["stop"])
                        else:
                            merged.append(dict(s))
                    for s in merged:
                        kept.append(raw[end : s["start"]])
                        end = s["stop"]
                    kept.append(raw[end:])
                    out.append({"doc_id": r["doc_id"], "n_bytes": len(raw), "spans": merged, "kept": b"".join(kept)})
                yield pa.RecordBatch.from_pylist(out, kind)

    return (
        texts.join(
            spans, F.col("doc_id").eqNullSafe(F.col("row_id")) & (F.col("mark") == F.col("row_mark")), "left"
        )
        .select("doc_id", "text", "spans")
        .mapInArrow(rows, "doc_id long, n_bytes long, spans array<struct<start int, stop int>>, kept binary")
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
