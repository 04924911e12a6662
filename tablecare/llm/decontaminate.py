"""Benchmark decontamination by winnowing, in DataFrame operations alone.

Words are hashed, ``GRAM`` of them at a time; of every ``SPAN`` grams in a row (one window of
``WINDOW`` words) the smallest hash is the fingerprint. Equal windows have equal fingerprints,
so each shared window is found by joining fingerprints, whatever surrounds it. A document sends
one row for each run of windows with the same fingerprint, not one for each word, and only rows
that hit a benchmark fingerprint go on: they are extended to the windows of the run, which are
compared word for word. Items of fewer than ``WINDOW`` words are a single window; its hash is
its fingerprint, and documents are hashed at those lengths too, if there are any.

Benchmark tables are broadcast up to ``BROADCAST_ROWS`` rows, counted first; larger ones are
joined by shuffles. A run then travels with its own words only, so what a text sends grows with
its length, and the documents' sizes are counted apart, so no key is common to all. Windows that occur in the same set of items form a class, told by aggregate
hashes; documents carry classes, and the items of each distinct set of classes are listed once.
So neither a passage that many documents share nor one that many items share multiplies rows.

Defined cases: null text has no words, and no hits; items without words never occur; a null
item_id is left out of the list of items, but its windows hit; rows that repeat are each
returned; equal item_ids count once; empty tables and other columns are fine.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablecare.llm.common import documents, free_name, staged, text_of

WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
#: Benchmark windows, and fingerprints, that may be broadcast: about 40 and 6 MB.
BROADCAST_ROWS = 200_000
NOT_IN_WORDS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"


def words(text: Column) -> Column:
    """The words of a text whose A-Z have been lower-cased; other capitals stay."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )
    return F.regexp_extract_all(low, F.lit(f"[^{NOT_IN_WORDS}]+"), F.lit(0))


def _hashed(df: DataFrame) -> DataFrame:
    """``df`` (words) with n and hash, the hash of each word."""
    return df.withColumns({"n": F.size("words"), "hash": F.transform("words", lambda w: F.xxhash64(w))})


def _windows(df: DataFrame) -> DataFrame:
    """``df`` (hash, n) with ``least``: the fingerprint of the window that begins at each word."""
    grams = F.transform(
        F.sequence(F.lit(0), F.col("n") - GRAM), lambda i: F.xxhash64(*(F.get("hash", i + k) for k in range(GRAM)))
    )
    least = F.transform(
        F.sequence(F.lit(0), F.col("n") - WINDOW), lambda i: F.least(*(F.get("gram", i + k) for k in range(SPAN)))
    )
    none = F.array().cast("array<long>")
    full = F.col("n") >= WINDOW
    return df.withColumn("gram", F.when(full, grams).otherwise(none)).withColumn(
        "least", F.when(full, least).otherwise(none)
    )


def _whole(length) -> Column:
    """The hash of all the words of a short window."""
    return F.xxhash64(F.slice("hash", 1, length))


def benchmark_windows(items: DataFrame) -> DataFrame:
    """Distinct windows of ``items`` (item_id, text): window, size, print, item_id."""
    own = _windows(_hashed(items.select(F.col("item_id").cast("string").alias("item_id"), words(text_of()).alias("words"))))
    # Outer, since an inner explode lets the optimizer copy the whole expression into a filter.
    long = own.select("item_id", "words", F.posexplode_outer("least").alias("at", "print")).where("at IS NOT NULL").select(
        F.array_join(F.slice("words", F.col("at") + 1, WINDOW), " ").alias("window"),
        F.lit(WINDOW).alias("size"),
        "print",
        "item_id",
    )
    short = own.where((F.col("n") > 0) & (F.col("n") < WINDOW)).select(
        F.array_join("words", " ").alias("window"), F.col("n").alias("size"), _whole(F.col("n")).alias("print"), "item_id"
    )
    return long.unionByName(short).distinct()


def hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Per distinct (doc_id, text): doc_id, mark, n_words, copies, starts (at, size), classes.

    ``windows`` are staged benchmark windows with their class.
    """
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    none = F.lit(0).cast("long")

    def run(at, stop, size, value) -> Column:
        return F.struct(
            F.lit(at).cast("int").alias("at"),
            F.lit(stop).cast("int").alias("stop"),
            F.lit(size).cast("int").alias("size"),
            value.alias("print"),
        )

    runs = []
    if WINDOW in sizes:
        first = F.filter(
            F.sequence(F.lit(0), F.size("least") - 1),
            lambda i: (i == 0) | (F.get("least", i) != F.get("least", i - 1)),
        )
        first = F.when(F.size("least") > 0, first).otherwise(F.array().cast("array<int>"))
        runs.append(
            F.transform(
                "first",
                lambda at, k: run(
                    at, F.coalesce(F.get("first", k + 1), F.size("least")) - 1, WINDOW, F.get("least", at)
                ),
            )
        )
    def each(size: int) -> Column:
        """Every word begins a run of one short window."""
        return F.transform(
            F.slice(F.sequence(F.lit(0), F.greatest(F.col("n") - size, F.lit(0))), 1, F.greatest(F.col("n") - size + 1, F.lit(0))),
            lambda at: run(at, at, size, F.xxhash64(F.slice("hash", at + 1, size))),
        )

    runs += [each(size) for size in sizes if size < WINDOW]

    own = _hashed(docs.select("doc_id", F.xxhash64(text_of()).alias("mark"), words(text_of()).alias("words")))
    sized = own.select("doc_id", "mark", "n")
    if WINDOW in sizes:
        own = _windows(own).withColumn("first", first)
    classes = windows.select("window", "size", "class").distinct()
    prints = windows.select("print", "size")
    # There are no more prints than windows, so what holds for these holds for both.
    if classes.count() > BROADCAST_ROWS:
        return _hits_by_shuffles(own.withColumn("runs", F.concat(*runs)), sized, prints.distinct(), classes)
    head = F.array(run(-1, -1, 0, none))
    prints = prints.unionByName(
        windows.sparkSession.range(1).select(none.alias("print"), F.lit(0).alias("size"))
    ).distinct()
    found = (
        own.withColumn("runs", F.concat(head, *runs))
        .select("doc_id", "mark", "n", "words", F.inline_outer("runs"))
        .join(F.broadcast(prints), ["print", "size"])
        .withColumn("part", _own_words())
    )
    is_head = F.col("at") < 0
    return (
        _spread(found, "doc_id", "mark", "n")
        .join(F.broadcast(classes), ["window", "size"], "left")
        .where(is_head | F.col("class").isNotNull())
        .groupBy("doc_id", "mark")
        .agg(
            F.max("n").alias("n_words"),
            F.count_if(is_head).alias("copies"),
            F.array_sort(F.collect_set(F.when(~is_head, F.struct("at", "size")))).alias("starts"),
            F.array_sort(F.collect_set(F.when(~is_head, F.col("class")))).alias("classes"),
        )
    )


def _own_words() -> Column:
    """The words that the windows of a run cover."""
    return F.slice("words", F.greatest(F.col("at"), F.lit(0)) + 1, F.col("stop") - F.col("at") + F.col("size"))


def _spread(found: DataFrame, *key: str) -> DataFrame:
    """Runs (at, stop, size, part) taken apart into their windows (at, size, window)."""
    return found.select(
        *key, "size", F.explode(F.sequence("at", "stop")).alias("at"), F.col("at").alias("base"), "part"
    ).withColumn("window", F.array_join(F.slice("part", F.col("at") - F.col("base") + 1, F.col("size")), " "))


def carried_runs(own: DataFrame) -> DataFrame:
    """Rows of runs with their own words, from documents with ``runs`` and ``words``."""
    # Outer, for the reason given in ``benchmark_windows``.
    runs = own.select("doc_id", "mark", "words", F.inline_outer("runs")).where("at IS NOT NULL")
    return runs.withColumn("part", _own_words()).drop("words")


def _hits_by_shuffles(own: DataFrame, sized: DataFrame, prints: DataFrame, classes: DataFrame) -> DataFrame:
    key = ["doc_id", "mark"]
    found = _spread(carried_runs(own).join(prints, ["print", "size"]), *key).join(classes, ["window", "size"])
    hit = found.groupBy(F.col("doc_id").alias("hit_id"), F.col("mark").alias("hit_mark")).agg(
        F.array_sort(F.collect_set(F.struct("at", "size"))).alias("starts"),
        F.array_sort(F.collect_set("class")).alias("classes"),
    )
    texts = sized.groupBy(*key).agg(F.max("n").alias("n_words"), F.count("*").alias("copies"))
    empty = {x: F.coalesce(x, F.array().cast(hit.schema[x].dataType)) for x in ("starts", "classes")}
    return (
        texts.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("mark") == F.col("hit_mark")), "left")
        .withColumns(empty)
        .select(*key, "n_words", "copies", "starts", "classes")
    )


def classed(windows: DataFrame) -> DataFrame:
    """``windows`` with ``class``: alike for windows that occur in the same items."""
    sets = windows.groupBy("window", "size").agg(
        F.struct(
            F.count("item_id").alias("n"),
            F.bit_xor(F.xxhash64("item_id")).alias("a"),
            F.bit_xor(F.xxhash64("item_id", F.lit("second"))).alias("b"),
        ).alias("class")
    )
    return windows.join(sets, ["window", "size"])


def mark_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, mark."""
    windows = staged(classed(benchmark_windows(items)), "windows")
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["at"] + s["size"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["at"] + s["size"] - F.greatest(s["at"], acc["end"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    rows = staged(
        hits(docs, windows).select(
            "doc_id",
            "mark",
            "copies",
            F.col("n_words").cast("long").alias("n_words"),
            covered.alias("n_hit"),
            F.when(F.size("classes") > 0, F.col("classes")).alias("classes"),
        ),
        "hits",
    )
    # The items of each distinct set of classes, listed once.
    one = windows.groupBy("class").agg(F.min(F.struct("window", "size")).alias("w"))
    members = one.select("class", "w.window", "w.size").join(windows.drop("class", "print"), ["window", "size"])
    lists = (
        rows.where(F.col("classes").isNotNull())
        .select("classes")
        .distinct()
        .select("classes", F.explode("classes").alias("class"))
        .join(members.select("class", "item_id"), "class")
        .groupBy("classes")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        .select(
            "classes",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        )
    )
    # Documents without a hit have no list, and need not meet any.
    none = {"n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    listed = rows.join(lists, "classes").drop("classes")
    clean = rows.where(F.col("classes").isNull()).drop("classes").withColumns(none)
    return (
        listed.unionByName(clean)
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            "n_items",
            "items_sha256",
            (F.col("n_hit") > 0).alias("contaminated"),
            "mark",
            F.explode(F.sequence(F.lit(1).cast("long"), "copies")),
        )
        .drop("col")
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a benchmark window, with all their columns."""
    mark, hit_mark, hit_id = (free_name(docs, x) for x in ("mark", "hit_mark", "hit_id"))
    hit = (
        mark_contaminated(docs, items)
        .where("contaminated")
        .select(F.col("doc_id").alias(hit_id), F.col("mark").alias(hit_mark))
        .distinct()
    )
    return (
        docs.withColumn(mark, F.xxhash64(text_of()))
        .join(hit, (F.col(mark) == F.col(hit_mark)) & F.col("doc_id").eqNullSafe(F.col(hit_id)), "left_anti")
        .drop(mark)
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return mark_contaminated(documents(spark, sf_dir), items).drop("mark")


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
SQL = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT item_id, array_to_string(w[p:p + 9], ' ') AS g, least(len(w), 10) AS size
  FROM i, unnest(range(1, greatest(2, len(w) - 8))) AS t(p) WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (
  SELECT doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') AS g
  FROM d, (SELECT DISTINCT size FROM iw) s, unnest(range(1, len(w) - size + 2)) AS t(p)),
hit AS (SELECT doc_id, p, size, g FROM dw SEMI JOIN iw USING (g, size)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM hit, unnest(range(p, p + size)) AS t(q) GROUP BY 1),
items AS (
  SELECT doc_id, list_sort(list(DISTINCT item_id)) AS ids FROM hit JOIN iw USING (g, size) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
