"""Records of CSV files with line breaks inside quotes, from any number of pieces of a file.

Spark cuts files into blocks and those into lines. Whether a line begins inside a quoted cell
depends on all quotes before it, but only on whether their number is odd. So:

1. One pass numbers the lines of each block and says for either case, the block beginning outside or
   inside quotes, which record of the block a line belongs to. Lines are staged with that, since
   another run might cut the files in other places.
2. Each block adds one row: whether its quotes are odd, and how many records begin in it in either
   case. Summed up along a file these rows tell which case it is, and where the record began that
   a block begins in the middle of.
3. A line that is a whole record, as most are, goes on as it is. Only the lines of records that have
   several are brought together, however many blocks they lie in.

Counting holds as long as quotes stand where cells begin and end, or are doubled. Files where one
does not (``5" pipe``) are found out in the first pass and left to the reader of whole files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablecare.sources.staging import LINE, PLACE, stage

#: Rows of blocks that are broadcast to the lines; more are joined by a shuffle.
BROADCAST_BLOCKS = 100_000

_LINE_KIND = (
    f"{PLACE[0]} string, {PLACE[1]} long, value string, open boolean, odd boolean, out_ok boolean, in_ok boolean, "
    f"{LINE} long, out_record long, in_record long"
)


def _well_placed(sep: str) -> tuple[Column, Column]:
    """Whether all quotes of a line stand at borders of cells, if it begins outside, or inside, quotes."""
    s = re.escape(sep)
    end = rf"(?={s}|\r?$)"
    bare = F.replace("value", F.lit('""'), F.lit(""))

    def rest_is_sound(text: Column) -> Column:
        left = F.regexp_replace(text, rf'(^|{s})"[^"]*"{end}', "$1")
        return ~F.contains(left, F.lit('"')) | left.rlike(rf'^([^"]*{s})?"[^"]*$')

    closed = F.regexp_replace(bare, rf'^[^"]*"{end}', "")
    inside = ~F.contains(bare, F.lit('"')) | ((closed != bare) & rest_is_sound(F.concat(F.lit(sep), closed)))
    return rest_is_sound(bare), inside


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their number in the block, whether an odd number of quotes comes before them there, and the
    number of records that have begun, if the block begins outside or inside quotes."""
    place, before, line, out_record, in_record = None, 0, 0, 0, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        file, block, odd = batch.column(0), batch.column(1), batch.column("odd").to_numpy(zero_copy_only=False)
        new = np.empty(n, bool)
        new[0] = place != (file[0].as_py(), block[0].as_py())
        changes = pc.or_(pc.not_equal(file.slice(1), file.slice(0, n - 1)), pc.not_equal(block.slice(1), block.slice(0, n - 1)))
        new[1:] = changes.to_numpy(zero_copy_only=False)
        if new[0]:
            before = line = out_record = in_record = 0
        at = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        first = at == 0

        def along(x: np.ndarray, carried: int) -> np.ndarray:
            """Sums of ``x`` from the block's first line up to and without each line."""
            upto = np.cumsum(x) - x
            return upto - upto[at] + np.where(first, carried, 0)

        quotes = along(odd.astype(np.int64), before)
        inside = quotes & 1
        number = along(np.ones(n, np.int64), line)
        outs, ins = along(1 - inside, out_record) + 1 - inside, along(inside, in_record) + inside
        place = (file[n - 1].as_py(), block[n - 1].as_py())
        before, line = int(quotes[-1] + odd[-1]), int(number[-1]) + 1
        out_record, in_record = int(outs[-1]), int(ins[-1])
        yield pa.RecordBatch.from_arrays(
            [file, block, batch.column("value"), pa.array(inside == 1), *(batch.column(x) for x in ("odd", "out_ok", "in_ok")),
             pa.array(number), pa.array(outs), pa.array(ins)],
            [*PLACE, "value", "open", "odd", "out_ok", "in_ok", LINE, "out_record", "in_record"],
        )


def decoded(value: Column, charset: str) -> Column:
    """Text of a line: the text reader hands bytes on as they are, whatever their charset."""
    return value if charset.upper() == "UTF-8" else F.decode(value.cast("binary"), charset)


def splittable(charset: str) -> bool:
    """Whether a line break is one byte, and no other character holds it."""
    return charset.upper() in ("UTF-8", "US-ASCII", "ISO-8859-1")


def numbered_lines(spark: SparkSession, path: str | list[str], sep: str, charset: str) -> DataFrame:
    """The lines of all files, staged: see ``_numbered``."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    out_ok, in_ok = _well_placed(sep)
    lines = (
        spark.read.option("encoding", charset)
        .option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias(PLACE[0]),
            F.col("_metadata.file_block_start").alias(PLACE[1]),
            decoded(F.col("value"), charset).alias("value"),
            (quotes % 2 == 1).alias("odd"),
            F.when(quotes == 0, True).otherwise(out_ok).alias("out_ok"),
            F.when(quotes == 0, True).otherwise(in_ok).alias("in_ok"),
        )
    )
    return stage(lines.mapInArrow(_numbered, _LINE_KIND), "csv-lines")


def block_rows(lines: DataFrame) -> DataFrame:
    """One row of each block, staged: ``inside``, the record it begins in the middle of, where the file's header is, and
    how many of its lines have a quote out of place."""
    file, block = PLACE
    filled = F.length(F.trim(F.regexp_replace("value", r"\r$", ""))) > 0
    sums = lines.groupBy(file, block).agg(
        F.count_if("odd").alias("odd"),
        F.count_if(F.when(F.col("open"), ~F.col("in_ok")).otherwise(~F.col("out_ok"))).alias("out_bad"),
        F.count_if(F.when(F.col("open"), ~F.col("out_ok")).otherwise(~F.col("in_ok"))).alias("in_bad"),
        F.max("out_record").alias("out_records"),
        F.max("in_record").alias("in_records"),
        F.min(F.when(filled, F.col(LINE))).alias("first"),
    )
    before = Window.partitionBy(file).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1
    begun = F.when(F.col("records") > 0, F.struct(F.col(block).alias("block"), F.col("records").alias("record")))
    header = F.when(F.col("first").isNotNull(), F.struct(F.col(block).alias("block"), F.col("first").alias("line")))
    return stage(
        sums.withColumn("inside", inside)
        .withColumn("records", F.when(F.col("inside"), F.col("in_records")).otherwise(F.col("out_records")))
        .select(
            file,
            block,
            "inside",
            F.when(F.col("inside"), F.col("in_bad")).otherwise(F.col("out_bad")).alias("bad"),
            F.last(begun, ignorenulls=True).over(before).alias("before"),
            F.min(header).over(Window.partitionBy(file)).alias("header"),
        ),
        "csv-blocks",
    )


def misplaced(blocks: DataFrame) -> list[str]:
    """The files in which a quote stands where no cell begins or ends."""
    found = blocks.groupBy(PLACE[0]).agg(F.sum("bad").alias("bad")).where("bad > 0").select(PLACE[0])
    return sorted(r[0] for r in found.collect())


def records(lines: DataFrame, blocks: DataFrame, without: list[str]) -> DataFrame:
    """(value, file, block, line) of every record but headers and empty lines; its place is its first line's."""
    file, block = PLACE
    few = blocks.count() <= BROADCAST_BLOCKS
    known = blocks.drop("bad").where(~F.col(file).isin(without)) if without else blocks.drop("bad")
    placed = lines.join(F.broadcast(known) if few else known, [file, block]).withColumns(
        {
            "begins": F.col("open") == F.col("inside"),
            "record": F.when(F.col("inside"), F.col("in_record")).otherwise(F.col("out_record")),
        }
    )
    place = [file, block, LINE]
    single = F.col("begins") & ~F.col("odd")
    own = F.struct(F.col(block).alias("block"), F.col("record"))
    several = (
        placed.where(~single)
        .withColumn("owner", F.when(F.col("record") > 0, own).otherwise(F.col("before")))
        .groupBy(file, "owner")
        .agg(
            F.array_sort(F.collect_list(F.struct(F.col(block).alias("block"), F.col(LINE).alias("line"), "value"))).alias("parts"),
            F.first("header").alias("header"),
        )
        .select(
            F.array_join(F.col("parts.value"), "\n").alias("value"),
            file,
            F.get("parts", F.lit(0))["block"].alias(block),
            F.get("parts", F.lit(0))["line"].alias(LINE),
            "header",
        )
    )
    is_header = (F.col(block) == F.col("header.block")) & (F.col(LINE) == F.col("header.line"))
    return (
        placed.where(single)
        .select("value", *place, "header")
        .unionByName(several)
        .where(~is_header)
        .select(F.regexp_replace("value", r"\r$", "").alias("value"), *place)
        .where(F.col("value") != "")
    )
