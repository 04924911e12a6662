"""Jaccard join of word n-grams as a join in a metric space.

1 - Jaccard is a metric, and two documents link within the radius ``EPSILON`` = 15/100. Pivots
part documents into regions; the triangle inequality says how far from a region's border a
document may lie and still link into it, and those documents are replicated. Alone this fails
for a whole corpus, since nearly all its distances are exactly 1 and no pivot separates anything
there. So the far field is split first, exactly: linked sets share a signature (see
``shingles``), and the components of that relation are blocks no link leaves.

Steps, all exact:

1. Documents with the same set are one class; the set's digest tells it.
2. Shingles that are frequent inside batches are counted; the ``FREQUENT`` commonest, a bounded
   array, are left out of signatures.
3. Equal signatures are brought together by one shuffle. Each batch sends one row of a signature,
   whatever the number of its documents that have it. The smallest class of a signature is its
   hub; edges to hubs give blocks.
4. A block of more than ``CELL`` classes gets a pivot, the class with most copies, and rings of
   width EPSILON around it. Linked classes lie in one ring or in neighbours. Classes in the first
   ring link to the pivot, so nothing there need be compared with one another. Rings are dealt
   out into cells of ``CELL`` classes, or more of small ones, for every class goes to as many
   tasks as its cell meets others; a cell meets the cells of its own and the next ring, so a
   task gets two cells at most.
5. Inside a task, regions of pivots are joined recursively, and compared outright when small or
   when pivots no longer separate them.
6. Links come back as edges to the smallest class of a task's component; components of all
   edges give the smallest doc_id.

Defined cases: null or empty text, or text without words, has no shingles, and is its own
component; rows with the same doc_id are each returned, with the smallest doc_id of their own
component; a null doc_id counts only if a component has no other; other columns are ignored. Where
one row of a component is kept, it is that with the smallest doc_id, null last, and of rows with
that id the one whose text has the smallest hash; of rows alike in both, one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablecare.llm.common import documents, free_name, staged, text_of
from tablecare.llm.components import components
from tablecare.llm.shingles import SHARE, set_digest, shingle_set, signatures

#: Classes compared without cells. A task compares two cells; a cell of larger blocks holds up to
#: ``CELLS`` times as many classes while their elements have ``CELL_BYTES`` bytes at most.
CELL, CELLS, CELL_BYTES = 128, 8, 1 << 22
#: Shingles left out of signatures at most, and how many documents of a batch make one a candidate.
FREQUENT, COMMON = 200_000, 8
#: Documents of a batch whose arrays a worker holds at a time.
BATCH = 1024
#: In a task: classes compared outright, pivots of a larger region, and the share of it that a
#: region may keep for pivots to be of use.
LEAF, PIVOTS, USEFUL = 48, 6, 0.75


def ring_of(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distance of sets of ``a`` and ``b`` elements in whole EPSILONs, rounded down."""
    union = a + b - shared
    return (union - shared) * 100 // ((100 - SHARE) * union)


class Region:
    """Sets, as numbers of elements in one array, that can be compared with one of them at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values, ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.ids, self.starts = ids, np.cumsum(self.sizes) - self.sizes
        self.flags = np.zeros(len(values), bool)

    def own(self, i: int) -> np.ndarray:
        return self.ids[self.starts[i] : self.starts[i] + self.sizes[i]]

    def shared(self, i: int, members: np.ndarray) -> np.ndarray:
        """How many elements the members share with set ``i``."""
        flags = self.flags
        flags[self.own(i)] = True
        if len(members) == len(self.sizes):
            found = np.add.reduceat(flags[self.ids], self.starts, dtype=np.int64)
        else:
            sizes = self.sizes[members]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1]) + np.repeat(self.starts[members] - ends + sizes, sizes)
            found = np.add.reduceat(flags[self.ids[at]], ends - sizes, dtype=np.int64)
        flags[self.own(i)] = False
        return found


def region_links(region: Region, members: np.ndarray, parent: np.ndarray) -> None:
    """Join the linked among ``members`` in ``parent``, a forest with the smallest as the root."""

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    if len(members) > LEAF:
        pivots = members[np.linspace(0, len(members) - 1, PIVOTS).astype(int)]
        distance = []
        for p in pivots.tolist():
            shared = region.shared(p, members)
            union = region.sizes[members] + region.sizes[p] - shared
            distance.append((union - shared) / union)
        distance = np.array(distance)
        # The window: twice the radius, and a little for rounding.
        inside = distance <= distance.min(0) + 2 * (100 - SHARE) / 100 + 1e-9
        if inside.sum(1).max() <= USEFUL * len(members):
            for k in range(len(pivots)):
                region_links(region, members[inside[k]], parent)
            return
    for k, i in enumerate(members.tolist()):
        others = members[k + 1 :]
        near = (region.sizes[others] * 100 >= SHARE * region.sizes[i]) & (
            region.sizes[i] * 100 >= SHARE * region.sizes[others]
        )
        others = others[near]
        if not len(others):
            continue
        shared = region.shared(i, others)
        linked = others[100 * shared >= SHARE * (region.sizes[others] + region.sizes[i] - shared)]
        for j in linked.tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)


def links_of(keys: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(a, b): edges to the smallest key of each one's component in a region."""
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    region = Region([sets[i] for i in order])
    parent = np.arange(len(order))
    region_links(region, np.arange(len(order)), parent)
    out = []
    for i in range(len(order)):
        r = i
        while parent[r] != r:
            r = int(parent[r])
        if r != i:
            out.append((keys[order[i]], keys[order[r]]))
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``BATCH`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def describe(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged: one row per document (doc_id, mark, n, digest, key); shingles common in a batch (shingle, n)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            sizes, digests, seen = [], [], {}
            for text in batch.column("text"):
                found = shingle_set(text.as_py())
                digest = set_digest(found)
                sizes.append(len(found))
                digests.append(digest)
                seen[digest] = found
            columns = [
                batch.column("doc_id"),
                batch.column("mark"),
                pa.array(sizes, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(map(_key, digests), pa.int64()),
                pa.nulls(batch.num_rows, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)
            every = np.sort(np.concatenate([np.empty(0, np.uint64), *seen.values()]))
            first = np.flatnonzero(np.diff(every, prepend=every[:1] - np.uint64(1)) != 0) if len(every) else every
            counts = np.diff(np.append(first, len(every))).astype(np.int64)
            common = counts >= COMMON
            if common.any():
                none = pa.nulls(int(common.sum()), pa.int64())
                columns = [
                    none,
                    none,
                    pa.array(counts[common]),
                    pa.nulls(len(none), pa.binary()),
                    none,
                    pa.array(every[first[common]].view(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "mark", "n", "digest", "key", "shingle"]
    both = staged(
        docs.mapInArrow(rows, "doc_id long, mark long, n long, digest binary, key long, shingle long"), "sets"
    )
    return both.where("shingle IS NULL").drop("shingle"), both.where("shingle IS NOT NULL").select("shingle", "n")


def candidate_edges(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(a, b) over keys of classes: b is a smaller class that shares a signature with a."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            found: dict[int, np.ndarray] = {}
            for text in batch.column("text"):
                own = shingle_set(text.as_py())
                key = _key(set_digest(own))
                if len(own) and key not in found:
                    found[key] = signatures(own, frequent)
            if not found:
                continue
            marks = np.concatenate(list(found.values()))
            keys = np.repeat(np.array(list(found), np.int64), [len(x) for x in found.values()])
            order = np.lexsort((keys, marks))
            marks, keys = marks[order], keys[order]
            first = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]]))
            hubs = np.repeat(keys[first], np.diff(np.append(first, len(marks))))
            # One row of a signature; the batch's other classes of it hang on to that one's.
            a, b = keys[keys != hubs], hubs[keys != hubs]
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
            for a, b, c in ((keys[first], marks[first].view(np.int64), None), (a[new], None, b[new])):
                none = pa.nulls(len(a), pa.int64())
                columns = [pa.array(a), none if b is None else pa.array(b), none if c is None else pa.array(c)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "mark", "hub"])

    both = docs.select("text").mapInArrow(rows, "key long, mark long, hub long")
    # Rows of both kinds come from one pass: an edge inside a batch travels under its own key.
    hub = F.expr("min(key) OVER (PARTITION BY coalesce(mark, key), mark IS NULL)")
    return staged(
        both.withColumn("hub", F.coalesce("hub", hub))
        .where("key <> hub")
        .select(F.col("key").alias("a"), F.col("hub").alias("b"))
        .distinct(),
        "candidates",
    )


def block_sets(docs: DataFrame, classes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Staged (block, key, copies, size, elements) of classes that may link."""
    active = classes.join(blocks.select(F.col("node").alias("key"), F.col("label").alias("block")), "key").select(
        "block", "key", "copies", "digest", F.col("row.doc_id").alias("row_id"), F.col("row.mark").alias("row_mark")
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            sets = [shingle_set(t.as_py()) for t in batch.column("text")]
            # Hashes of texts may be alike though the texts are not.
            mine = np.array([set_digest(s) == d.as_py() for s, d in zip(sets, batch.column("digest"))], bool)
            columns = [batch.column(c) for c in ("block", "key", "copies")]
            table = pa.RecordBatch.from_arrays(
                [*columns, pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())],
                ["block", "key", "copies", "elements"],
            )
            yield table.filter(pa.array(mine))

    return staged(
        docs.join(active, F.col("doc_id").eqNullSafe(F.col("row_id")) & (F.col("mark") == F.col("row_mark")))
        .select("block", "key", "copies", "digest", "text")
        .mapInArrow(rows, "block long, key long, copies long, elements binary")
        .groupBy("block", "key")
        .agg(F.max("copies").alias("copies"), F.max("elements").alias("elements")),
        "blocks",
    )


def cells(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cell a string, key, elements), and edges to pivots, from (block, key, copies, elements)."""
    count = sets.groupBy("block").agg(
        F.count("*").alias("classes"), F.max(F.struct("copies", "key")).alias("pivot")
    )
    large = staged(count.where(F.col("classes") > CELL), "large")
    small = sets.join(large.select("block"), "block", "left_anti").select(
        F.col("block").cast("string").alias("cell"), "key", "elements"
    )
    pivots = (
        large.select("block", "classes", F.col("pivot.key").alias("key"))
        .join(sets.select("block", "key", F.col("elements").alias("pivot_elements")), ["block", "key"])
        .withColumnRenamed("key", "pivot")
    )

    def rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ring, linked = [], []
            for own, pivot in zip(batch.column("elements"), batch.column("pivot_elements")):
                a, b = (np.frombuffer(x.as_py(), np.uint64) for x in (own, pivot))
                shared = np.intersect1d(a, b, assume_unique=True).size
                ring.append(int(ring_of(*(np.array(x, np.int64) for x in (shared, len(a), len(b))))))
                linked.append(100 * shared >= SHARE * (len(a) + len(b) - shared))
            kept = [batch.column(c) for c in ("block", "key", "elements", "classes", "pivot")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(ring, pa.int32()), pa.array(linked, pa.bool_())],
                ["block", "key", "elements", "classes", "pivot", "ring", "linked"],
            )

    ringed = staged(
        sets.join(pivots, "block").mapInArrow(
            rings, "block long, key long, elements binary, classes long, pivot long, ring int, linked boolean"
        ),
        "rings",
    )
    # All of the first ring links to the pivot, and those of the second that are exactly a radius away.
    to_pivot = ringed.where("linked AND key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b"))
    least = F.greatest(F.ceil(F.count("*") / (CELLS * CELL)), F.ceil(F.sum(F.length("elements")) / CELL_BYTES))
    parts = F.least(F.ceil(F.count("*") / CELL), least)
    sizes = ringed.groupBy("block", "ring").agg(parts.cast("int").alias("parts"))
    placed = ringed.join(sizes, ["block", "ring"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    # A cell meets the cells of its own ring that do not come before it, and all of the next ring.
    own, after = sizes.alias("s"), sizes.alias("t")
    pairs = staged(
        own.join(
            after,
            (F.col("s.block") == F.col("t.block")) & (F.col("t.ring") - F.col("s.ring")).isin(0, 1),
        )
        .select(
            F.col("s.block").alias("block"),
            F.col("s.ring").alias("r"),
            F.col("t.ring").alias("q"),
            F.explode(F.sequence(F.lit(0), F.col("s.parts") - 1)).alias("i"),
            F.col("t.parts").alias("parts"),
        )
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .where("(r < q OR i <= j) AND (r > 0 OR q > 0)")
        .select("block", "r", "i", "q", "j", F.concat_ws("/", "block", "r", "i", "q", "j").alias("cell")),
        "pairs",
    )
    ends = pairs.select("block", F.col("r").alias("ring"), F.col("i").alias("part"), "cell").unionByName(
        pairs.where("r <> q OR i <> j").select("block", F.col("q").alias("ring"), F.col("j").alias("part"), "cell")
    )
    met = placed.join(ends, ["block", "ring", "part"]).select("cell", "key", "elements")
    return small.unionByName(met), to_pivot


def cell_links(members: DataFrame) -> DataFrame:
    """(a, b) of linked classes, from (cell, key, elements): cells one after the other, in each task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, keys, sets = None, [], []
        kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in links_of(keys, sets)], kind)

        for batch in batches:
            for c, key, raw in zip(*(batch.column(x) for x in ("cell", "key", "elements"))):
                if c.as_py() != cell:
                    if len(keys) > 1:
                        yield closed()
                    cell, keys, sets = c.as_py(), [], []
                keys.append(key.as_py())
                sets.append(np.frombuffer(raw.as_py(), np.uint64))
        if len(keys) > 1:
            yield closed()

    return members.repartition("cell").sortWithinPartitions("cell").mapInArrow(rows, "a long, b long")


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, mark, n, digest), and of each set's digest the component_id and the row that stays."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("mark")
    )
    rows, common = describe(texts)
    top = common.groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(FREQUENT)
    frequent = np.sort(np.array([r["shingle"] for r in top.select("shingle").collect()], np.int64).view(np.uint64))
    classes = rows.where("n > 0").groupBy("digest", "key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark")).alias("row"),
        F.count("*").alias("copies"),
    )
    blocks = components(candidate_edges(texts, frequent))
    members, to_pivot = cells(block_sets(texts, classes, blocks))
    edges = cell_links(members).unionByName(to_pivot)
    found = components(edges)
    # The first row of a component, from those of its classes.
    labelled = classes.join(found.withColumnRenamed("node", "key"), "key", "left")
    least = labelled.where("label IS NOT NULL").groupBy("label").agg(F.min("row").alias("least"))
    named = labelled.join(least, "label", "left").select("digest", F.coalesce("least", "row").alias("stays"))
    return rows, named.select("digest", F.col("stays.doc_id").alias("component_id"), "stays")


def similar_components(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id."""
    rows, named = _labelled(docs)
    return (
        rows.where("n > 0")
        .join(named, "digest")
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        .unionByName(
            rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        )
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``, with all columns; every row without shingles."""
    kept, mark, own, rank = (free_name(docs, x) for x in ("kept", "mark", "own_mark", "rank"))
    rows, named = _labelled(docs)
    first = named.select("stays.doc_id", "stays.mark").distinct().withColumn("single", F.lit(True))
    bare = rows.where("n = 0").select("doc_id", "mark").distinct().withColumn("single", F.lit(False))
    stays = first.unionByName(bare).select(F.struct("doc_id", "single").alias(kept), F.col("mark").alias(mark))
    nth = F.row_number().over(Window.partitionBy("doc_id", own).orderBy(own))
    return (
        docs.withColumn(own, F.xxhash64(text_of()))
        .join(
            stays,
            F.col("doc_id").cast("long").eqNullSafe(F.col(kept)["doc_id"]) & (F.col(own) == F.col(mark)),
        )
        .withColumn(rank, nth)
        .where((F.col(rank) == 1) | ~F.col(kept)["single"])
        .select([F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS g
  FROM t, unnest(range(1, greatest(2, len(w) - 2))) AS u(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY 1, 2),
link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * k >= 85 * (x.n + y.n - k)),
pair AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM pair UNION SELECT r.a, pair.b FROM reach r JOIN pair ON r.b = pair.a)
SELECT t.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(t.doc_id, min(reach.b)) AS component_id
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = t.doc_id GROUP BY 1
"""
