"""Runs of words that repeat with a period, and texts without the repeats.

A run is a stretch of words with smallest period q, at least ``LEAST`` words and ``TIMES`` periods
long, that no neighbouring word extends. Suffixes of a document that begin alike form classes, and
these are united in the order of decreasing common length, as Kruskal's algorithm takes edges:

1. Ranks by the first 1, 2, 4, ... words sort the suffixes, many documents' at a time; suffixes
   whose rank is theirs alone drop out. Of neighbours in the order, the ranks tell how many words
   L they have in common. Pairs with too few for any run are never looked at.
2. Neighbours are united from the largest L on. Each class keeps its positions in order, the
   smaller class is put into the larger.
3. Positions i < j that are next to each other only since this union have exactly L words in
   common. If L is at least ``TIMES - 1`` times their distance q, words i to j + L have period q, no
   smaller one (a position in between would have been nearer), and end there; if the words before
   i and j differ, this is a run, and every run shows itself once, at its first word.

Documents are independent, so nothing is shuffled; a task holds ``TOGETHER`` bytes of texts, or one
text, at a time.

Defined cases: null text is the empty text, without words or runs; a null doc_id is kept; rows
that repeat are each returned; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablecare.llm.common import documents, text_of

LEAST, TIMES = 6, 4
#: Bytes of text whose suffixes are sorted together.
TOGETHER = 1 << 20
#: What ``bytes.split`` takes apart as well.
WORD = r"[^\x20\x09-\x0D]+"
RUN = "array<struct<start long, length long, period long>>"


def _ranked(words: np.ndarray, owner: np.ndarray, least: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of suffixes by their first 1, 2, 4, ... words, and those with a twin at ``least`` words or just below.

    A rank is how many suffixes come before its class; classes never span documents.
    """
    n = len(words)
    key = owner * (words.max() + 1) + words
    order = np.argsort(key, kind="stable")
    ahead = np.append(True, key[order[1:]] != key[order[:-1]])
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(ahead, np.arange(n), 0))
    home = np.append(owner, -1)
    levels, width, twins = [rank], 1, order
    alone = ahead & np.append(ahead[1:], True)
    live = order[~alone]
    while len(live):
        if width <= least:
            twins = live
        then = np.minimum(live + width, n)
        second = np.where(home[then] == home[live], rank[then] + 1, 0)
        first = rank[live]
        order = np.argsort(first * (n + 2) + second, kind="stable")
        live, first, second = live[order], first[order], second[order]
        at = np.arange(len(live))
        new_first = np.append(True, first[1:] != first[:-1])
        new_pair = new_first | np.append(True, second[1:] != second[:-1])
        rank = rank.copy()
        rank[live] = first + (
            np.maximum.accumulate(np.where(new_pair, at, 0)) - np.maximum.accumulate(np.where(new_first, at, 0))
        )
        levels.append(rank)
        width *= 2
        live = live[~(new_pair & np.append(new_pair[1:], True))]
    if width <= least:
        twins = live
    return levels, twins


def common_lengths(words: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours a, b in the order of a document's suffixes that have at least ``least`` words in common, and how many."""
    levels, twins = _ranked(words, owner, least)
    order = twins[np.argsort(levels[-1][twins], kind="stable")]
    a, b = order[:-1], order[1:]
    # Those with a twin at the widest level up to ``least`` are whole classes of it.
    level = levels[min(len(levels), int(least).bit_length()) - 1]
    near = level[a] == level[b]
    a, b = a[near], b[near]
    length = np.zeros(len(a), np.int64)
    for k in reversed(range(len(levels))):
        # Two suffixes never end at the same place, and past a document's end no rank is the same.
        same = levels[k][a + length] == levels[k][b + length]
        length += same.astype(np.int64) << k
    enough = length >= least
    return a[enough], b[enough], length[enough]


def find_runs(
    texts: list[list[bytes]], least: int = LEAST, times: int = TIMES
) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each of some texts' words, by start and period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    number = numbers.setdefault
    words = np.array([number(w, len(numbers)) for t in texts for w in t], np.int64)
    if not len(words):
        return found
    owner = np.repeat(np.arange(len(texts)), sizes)
    # A run with period q has least - q words in common with itself q further, and (times - 1) * q.
    enough = min(max(least - q, (times - 1) * q) for q in range(1, least + 1))
    first, second, length = common_lengths(words, owner, enough)
    order = np.argsort(-length, kind="stable")
    label: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    for a, b, common in zip(first[order].tolist(), second[order].tolist(), length[order].tolist()):
        x, y = label.setdefault(a, a), label.setdefault(b, b)
        large, small = members.pop(x, [a]), members.pop(y, [b])
        if len(large) < len(small):
            x, y, large, small = y, x, small, large
        if 8 * len(small) < len(large):
            for p in small:
                insort(large, p)
        else:
            large += small
            large.sort()
        for p in small:
            k = bisect_left(large, p)
            for i, j in ((large[k - 1] if k else p, p), (p, large[k + 1] if k + 1 < len(large) else p)):
                q = j - i
                if (
                    q
                    and common >= (times - 1) * q
                    and common + q >= least
                    and label[i] != label[j]
                    and (i == begin[owner[i]] or words[i - 1] != words[j - 1])
                ):
                    found[owner[i]].append((i - int(begin[owner[i]]), common + q, q))
        for p in small:
            label[p] = x
        members[x] = large
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by spaces."""
    kept, done = [], 0
    for start, stop in sorted((start + period, start + length) for start, length, period in runs):
        kept += words[done:start]
        done = max(done, stop)
    return b" ".join(kept + words[done:])


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, runs (start, length, period), collapsed text."""
    if least < 2 or times < 2:
        raise ValueError("runs have at least two words and two periods")
    kind = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()),
         ("runs", pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))),
         ("collapsed", pa.string())]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("size").to_numpy()
            part = (np.cumsum(size) - size) // TOGETHER
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for at, end in zip(cuts, cuts[1:]):
                some = batch.slice(at, end - at)
                texts = [t.as_py().split() for t in some.column("text")]
                runs = find_runs(texts, least, times)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc_id"),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs], kind.field("runs").type),
                        pa.array([collapsed(t, r).decode() for t, r in zip(texts, runs)], pa.string()),
                    ],
                    schema=kind,
                )

    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_of().cast("binary").alias("text"),
        F.octet_length(text_of()).cast("long").alias("size"),
    )
    return texts.mapInArrow(rows, f"doc_id long, n_words long, runs {RUN}, collapsed string")


def with_periods(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) where every tenth text by hash repeats some of its words to its end.

    With h the crc32 of the decimal doc_id (null: of no text) and g = h div 10, a text with h mod 10
    = 0 and n > 0 words has, from word a = g mod n on, the 1 + (n - a) div (3 + g mod 8) words from a
    on again and again.
    """
    words = F.regexp_extract_all(text_of(), F.lit(WORD), F.lit(0))
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    chosen = docs.select(F.col("doc_id"), text_of().alias("text"), h.alias("h")).select(
        "doc_id",
        "text",
        F.expr("h div 10").alias("g"),
        F.when(F.col("h") % 10 == 0, words).otherwise(F.array().cast("array<string>")).alias("words"),
    )
    n = F.size("words")
    start = F.when(n > 0, (F.col("g") % n).cast("int"))
    period = (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int")

    def place(i: Column) -> Column:
        return F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))

    again = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", place(i))), " ")
    return (
        chosen.withColumn("a", start)
        .withColumn("p", period)
        .select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))
    )


def strongest(runs: str) -> Column:
    """The run with the most periods, the earliest of equal ones, then the one with the least period."""
    better = "a.length * b.period < b.length * a.period"
    return F.expr(
        f"aggregate({runs}, get({runs}, 0), (a, b) -> CASE WHEN {better} THEN b ELSE a END)"
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return (
        periodic_runs(with_periods(documents(spark, sf_dir)))
        .withColumn("best", strongest("runs"))
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            F.col("best.start").alias("start"),
            F.col("best.length").alias("length"),
            F.col("best.period").alias("period"),
            F.expr("1000 * best.length div best.period").alias("exponent_milli"),
            F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
            F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        )
    )
