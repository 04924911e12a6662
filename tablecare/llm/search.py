"""The best documents for each of a set of queries, by weighted words, without scoring all of them.

Queries are taken in slices of at most ``SLICE`` bytes of text, or one query, so what a task knows of
them is bounded; each slice reads all documents twice.

1. One pass counts documents, words and, for the slice's terms, the documents that hold them: one
   row of sums a task, and a count a term.
2. The second pass holds a block of documents at a time: for each term their occurrences and a bitmap
   of the documents that have it. A query's bitmaps, put side by side, are each document's mask of
   matched terms, and documents with equal masks form a group. The most a group can score follows
   from its mask, its shortest document and each term's highest count in the block.
3. Groups are scored in descending order of that bound, some at a time, until the bound of the next
   is below the ``top``-th best score that the task knows; then no document left can enter. A bound
   equal to that score is still scored, since equal scores go by doc_id.
4. Each task sends at most ``top`` rows a query, and the best of these are the result.

Scores are integers: a term's weight w is floor(1000 ln((2N+2) / (2df+1))), N documents having words
and df the term; a document of n words, L being those of all documents, has m = 10 + 90nN div L, and
a term that occurs tf times in it adds w ((10^9 tf) div (1000 tf + 8m)).

Defined cases: null text is the empty text and is never found; a query without terms that occur has
no rows; each row of queries is one query, equal ids or not; rows of documents that repeat are each
ranked; of equal scores the smaller doc_id comes first, a null one last; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablecare.llm.common import documents, staged, text_of

TOP = 10
#: Bytes of queries that tasks hold at a time.
SLICE = 1 << 22
#: Cells of a block's table of terms by documents, and documents in a block.
CELLS, BLOCK = 1 << 22, 4_096
#: Groups that are scored before the bound is looked at again; doubled each time.
FIRST = 32
#: White space for every ASCII byte that no term has, small letters for capitals.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def _counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, dict[int, int]]:
    """N, L, and the documents that hold each term of ``vocabulary`` (term, number)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Numbers from 0 are terms; -1 counts documents with words, -2 their words.
        held: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                words = terms(text.as_py())
                if words:
                    held[-1] += 1
                    held[-2] += len(words)
                    held.update(k for k in map(vocabulary.get, set(words)) if k is not None)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], ["term", "n"]
        )

    found = docs.mapInArrow(rows, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    count = {r["term"]: r["n"] for r in found.collect()}
    return count.pop(-1, 0), count.pop(-2, 0), count


class Ranking:
    """The best documents for some queries, of blocks that come one after the other.

    ``queries`` are arrays of term numbers, ``weights`` belongs to the terms.
    """

    def __init__(self, queries: list[np.ndarray], weights: np.ndarray, top: int):
        self.queries, self.weights, self.top = queries, weights, top
        self.best: list[list[tuple[int, bool, int]]] = [[] for _ in queries]
        self.scored = self.seen = 0

    def add(self, ids: list[int | None], m: np.ndarray, counts: np.ndarray) -> None:
        """A block: doc_ids, their m, and a table of how often each term (row) occurs in each document."""
        most = counts.max(axis=1)
        bitmaps = counts > 0
        for number, query in enumerate(self.queries):
            query = query[most[query] > 0]
            if not len(query):
                continue
            masks = np.packbits(bitmaps[query], axis=0, bitorder="little")
            groups, member = self._groups(masks)
            order = np.argsort(member, kind="stable")
            begin = np.searchsorted(member[order], np.arange(len(groups) + 1))
            shortest = np.minimum.reduceat(m[order], begin[:-1])
            has = np.unpackbits(groups, axis=1, count=len(query), bitorder="little").astype(np.int64)
            high, weight = most[query].astype(np.int64), self.weights[query]
            bound = (has * (weight * _part(high, shortest[:, None]))).sum(axis=1)
            queue = np.argsort(-bound, kind="stable")
            at, some = 0, FIRST
            self.seen += len(m)
            while at < len(queue):
                least = self._least(number)
                chosen = queue[at : at + some]
                chosen = chosen[bound[chosen] >= least]
                if not len(chosen):
                    break
                docs = np.concatenate([order[begin[g] : begin[g + 1]] for g in chosen.tolist()])
                self._score(number, query, docs, ids, m, counts)
                at, some = at + some, 2 * some

    @staticmethod
    def _groups(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct masks (a row each), and which one each document has."""
        rows = np.ascontiguousarray(masks.T)
        width = rows.shape[1]
        if width <= 8:
            wide = np.zeros((len(rows), 8), np.uint8)
            wide[:, :width] = rows
            groups, member = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)
            return groups.view(np.uint8).reshape(-1, 8), member
        groups, member = np.unique(rows.view(np.dtype((np.void, width))).ravel(), return_inverse=True)
        return groups.view(np.uint8).reshape(-1, width), member

    def _least(self, number: int) -> int:
        best = self.best[number]
        return max(1, -best[-1][0]) if len(best) == self.top else 1

    def _score(self, number: int, query: np.ndarray, docs: np.ndarray, ids: list, m: np.ndarray, counts: np.ndarray):
        tf = counts[np.ix_(query, docs)].astype(np.int64)
        score = (self.weights[query][:, None] * _part(tf, m[docs])).sum(axis=0)
        self.scored += len(docs)
        good = np.flatnonzero(score >= self._least(number))
        if len(good) > 8 * self.top:
            # Equal scores all stay; the sort below decides by doc_id.
            edge = np.partition(score[good], len(good) - self.top)[len(good) - self.top]
            good = good[score[good] >= edge]
        found = [(-s, ids[d] is None, ids[d] or 0) for s, d in zip(score[good].tolist(), docs[good].tolist())]
        self.best[number] = sorted(self.best[number] + found)[: self.top]


def _part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 8m); 0 without occurrences."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _blocks(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int], n_docs: int, n_words: int):
    """Blocks of documents with words: doc_ids, m, and counts by term and document."""
    height = max(1, len(vocabulary))
    size = max(1, min(BLOCK, CELLS // height))
    ids: list[int | None] = []
    m: list[int] = []
    cells: list[np.ndarray] = []

    def block():
        counts = np.zeros((height, len(ids)), np.int32)
        owner = np.repeat(np.arange(len(ids)), [len(c) for c in cells])
        np.add.at(counts.reshape(-1), np.concatenate(cells) * len(ids) + owner, 1)
        return ids, np.array(m, np.int64), counts

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            words = terms(text.as_py())
            if not words:
                continue
            ids.append(doc_id.as_py())
            m.append(10 + 90 * len(words) * n_docs // n_words)
            cells.append(np.array([k for k in map(vocabulary.get, words) if k is not None], np.int64))
            if len(ids) == size:
                yield block()
                ids, m, cells = [], [], []
    if ids:
        yield block()


def _slices(queries: DataFrame, limit: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """(number, distinct terms) of queries (number, text), not more than ``limit`` bytes of text or one query at a time."""
    held, size = [], 0
    for row in queries.toLocalIterator():
        if held and size + len(row["text"]) > limit:
            yield held
            held, size = [], 0
        held.append((row["number"], sorted(set(terms(bytes(row["text"]))))))
        size += len(row["text"])
    if held:
        yield held


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, limit: int = SLICE) -> DataFrame:
    """Per row of ``queries`` (item_id, text): its ``top`` best of ``docs`` (doc_id, text), as item_id, rank, doc_id, score."""
    if top < 1:
        raise ValueError("top is at least 1")
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    # Staged, so that the numbers stay the same when the rows are read again.
    asked = staged(
        queries.select("item_id", text_of().cast("binary").alias("text"), F.monotonically_increasing_id().alias("number")),
        "queries",
    )
    found = spark.createDataFrame([], "number long, doc_id long, score long")
    for some in _slices(asked.select("number", "text"), limit):
        # Staged, so that the driver holds one slice at a time.
        found = found.unionByName(staged(_ranked(texts, some, top), "ranked"))
    first = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (
        found.withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= top)
        .join(asked.select("number", "item_id"), "number")
        .select("item_id", "rank", "doc_id", "score")
    )


def _ranked(texts: DataFrame, queries: list[tuple[int, list[bytes]]], top: int) -> DataFrame:
    """(number, doc_id, score): the best rows that each task finds."""
    vocabulary: dict[bytes, int] = {}
    for _, words in queries:
        for w in words:
            vocabulary.setdefault(w, len(vocabulary))
    n_docs, n_words, holders = _counts(texts, vocabulary)
    weights = np.zeros(max(1, len(vocabulary)), np.int64)
    for k in range(len(vocabulary)):
        weights[k] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders.get(k, 0) + 1)))
    wanted = [np.array([vocabulary[w] for w in words], np.int64) for _, words in queries]
    numbers = [number for number, _ in queries]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking = Ranking(wanted, weights, top)
        for block in _blocks(batches, vocabulary, n_docs, n_words):
            ranking.add(*block)
        out = [
            (numbers[q], None if none else doc_id, -score)
            for q, best in enumerate(ranking.best)
            for score, none, doc_id in best
        ]
        columns = zip(*out) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["number", "doc_id", "score"])

    return texts.mapInArrow(rows, "number long, doc_id long, score long")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS big_n, sum(len(w)) AS big_l FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark)),
p AS (
  SELECT doc_id, any_value(n) AS n, t, count(*) AS tf
  FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) SEMI JOIN q USING (t) GROUP BY doc_id, t),
v AS (SELECT t, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY t, big_n),
r AS (
  SELECT item_id, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM q JOIN p USING (t) JOIN v USING (t), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 10
"""
