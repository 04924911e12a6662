"""CSV in: lead lists as text, audit tables with types, delimiters of whole folders.

Before anything is parsed, one aggregate over the lines tells each file's header line and whether
its quotes close on every line. Files are then read in groups of the same header and kind, and
the groups are put together by column name, so neither the order of columns nor their number
need be the same in all files:

* files whose quotes close on every line are read line by line, in as many pieces as Spark likes;
* files with line breaks inside quotes are read in pieces too, whose lines are put together to records
  once it is known which of them begin inside quotes (see ``quoted``); where a quote stands in the
  middle of a cell that can't be told, and such a file is read as a whole;
* files whose quotes never close in the end are read line by line, and the lines with an odd
  number of quotes are set apart, as are rows with more cells than the header.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablecare import fixed_values as fv
from tablecare.functions.columns import col
from tablecare.functions.parsing import is_number
from tablecare.sources import quoted
from tablecare.sources.staging import LINE, PLACE, stage, with_row_id

CORRUPT = "_malformed_text"
# Quoted stretches of a line; a doubled quote inside a cell ends one and starts the next.
QUOTED = '"[^"]*"'
ROW_LINES, WHOLE_FILES, OPEN_QUOTES = "lines", "files", "open"


@dataclass(frozen=True)
class LoadedCsv:
    placed: DataFrame  # the rows, with the file and the block that each comes from
    malformed: DataFrame  # one text column: rows that do not fit the header, as they stand
    meta: dict

    @property
    def df(self) -> DataFrame:
        return self.placed.drop(*PLACE, LINE)

    def with_row_id(self, name: str = "row_id") -> DataFrame:
        """The rows, staged, with an id that grows from file to file and line to line."""
        return with_row_id(self.placed, name)

    def counts(self) -> DataFrame:
        """One row: encoding, delimiter, rows and columns as loaded, rows set apart."""
        apart = self.malformed.groupBy().agg(F.count("*").alias("malformed_rows"))
        return self.df.groupBy().agg(F.count("*").alias("original_rows")).crossJoin(apart).select(
            F.lit(self.meta["encoding"]).alias("encoding"),
            F.lit(self.meta["delimiter"]).alias("delimiter"),
            "original_rows",
            F.lit(len(self.df.columns)).alias("original_cols"),
            "malformed_rows",
        )


def _charset(encoding: str) -> tuple[str, dict[int, str]]:
    """What Spark reads an encoding as, and the characters to put right afterwards.

    Windows-1252 is ISO-8859-1 but for 80 to 9F, which are printable there.
    """
    if encoding.lower().replace("_", "-") not in ("windows-1252", "cp1252"):
        return encoding, {}
    low = range(0x80, 0xA0)
    return "ISO-8859-1", {
        b: c for b in low if (c := bytes([b]).decode("cp1252", "ignore"))
    }


def _repaired(text: Column, wrong: dict[int, str]) -> Column:
    return F.translate(text, "".join(map(chr, wrong)), "".join(wrong.values())) if wrong else text


def _options(sep: str, encoding: str) -> dict:
    return {"sep": sep, "encoding": _charset(encoding)[0], "quote": '"', "escape": '"'}


def _literal(file: str) -> str:
    """A file's path as Spark's readers take it: not encoded, and without wildcards."""
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in unquote(file))


def survey(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """(file, header, kind) for every file with a line: its first line, and how its quotes close."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    text = quoted.decoded(F.col("value"), _charset(encoding)[0]).alias("value")
    return (
        spark.read.option("encoding", _charset(encoding)[0])
        .text(path)
        .select(F.col("_metadata.file_path").alias("file"), text, quotes.alias("quotes"), place.alias("place"))
        .where(F.length(F.trim("value")) > 0)
        .groupBy("file")
        .agg(
            F.min_by("value", "place").alias("header"),
            F.count_if(F.col("quotes") % 2 == 1).alias("odd"),
            F.sum("quotes").alias("quotes"),
        )
        .select(
            "file",
            "header",
            F.when(F.col("odd") == 0, ROW_LINES).when(F.col("quotes") % 2 == 0, WHOLE_FILES).otherwise(OPEN_QUOTES).alias("kind"),
        )
    )


def null_tokens(df: DataFrame, tokens=fv.NA_TOKENS) -> DataFrame:
    """NULL for every text cell that holds one of the usual spellings of "missing"."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)} - {*PLACE}
    return df.select(
        *[
            F.when(~col(n).isin(*tokens), col(n)).alias(n) if n in texts else col(n)
            for n in df.columns
        ]
    )


def tidy_header(df: DataFrame, cells: int) -> DataFrame:
    """Strip the names of the first ``cells`` columns and drop those without one (Spark calls
    column N of them _cN); the others stay."""
    names = [n.strip() for n in df.columns[:cells]]
    kept = [i for i, n in enumerate(names) if n not in ("", f"_c{i}")]
    others = df.columns[cells:]
    df = df.toDF(*[f"c{i}" for i in range(cells)], *others)
    return df.select(*[F.col(f"c{i}").alias(names[i]) for i in kept], *others)


def read_csv_text(
    spark: SparkSession,
    path: str | list[str],
    sep: str = fv.DEFAULT_DELIMITER,
    encoding: str = "UTF-8",
    multi_line: bool | None = None,
) -> LoadedCsv:
    """All cells as text. Blank lines are skipped, short rows padded with NULL, columns that a
    file has not got are NULL there, and rows that do not fit their header are set apart.

    ``multi_line`` reads every file as a whole (True) or line by line (False); by default the
    quotes decide how, and files are read in pieces wherever that gives the same rows.
    """
    kind = F.col("kind") if multi_line is None else F.lit(WHOLE_FILES if multi_line else ROW_LINES)
    groups = (
        survey(spark, path, encoding)
        .groupBy("header", kind.alias("kind"))
        .agg(F.array_sort(F.collect_list("file")).alias("files"))
        .collect()
    )
    if not groups:
        raise ValueError(f"no header line in {path}")
    groups.sort(key=lambda g: g["files"][0])
    read = []
    for g in groups:
        files = path if len(groups) == 1 else [_literal(f) for f in g["files"]]
        if g["kind"] == WHOLE_FILES and multi_line is None and quoted.splittable(_charset(encoding)[0]):
            read += _read_pieces(spark, files, g["files"], g["header"], sep, encoding)
        else:
            read.append(_read_group(spark, files, g["kind"], g["header"], sep, encoding))
    placed = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r[0] for r in read])
    malformed = reduce(DataFrame.unionByName, [r[1] for r in read])
    columns = [c for c in placed.columns if c not in (*PLACE, LINE)]
    return LoadedCsv(placed.select(*map(col, columns), *PLACE, LINE), malformed, {"encoding": encoding, "delimiter": sep})


def _read_group(
    spark: SparkSession, path: str | list[str], kind: str, header: str, sep: str, encoding: str
) -> tuple[DataFrame, DataFrame]:
    """Files of one header: their rows with their place, and what does not fit."""
    options, wrong = _options(sep, encoding), _charset(encoding)[1]
    options["multiLine"] = kind == WHOLE_FILES
    names = spark.read.options(**options).option("header", True).csv(path).columns
    place = [F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.file_block_start").alias(PLACE[1])]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    line = F.lit(None).cast("bigint").alias(LINE)
    if kind == OPEN_QUOTES:
        text = quoted.decoded(F.col("value"), options["encoding"]).alias("value")
        lines = spark.read.option("encoding", options["encoding"]).text(path).select(text, *place)
        lines = lines.where((F.length(F.trim("value")) > 0) & (F.col("value") != header))
        odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
        rows = lines.where(~odd).select(_parsed(schema, options).alias("cells"), *PLACE).select("cells.*", *PLACE, line)
        broken = lines.where(odd).select(F.col("value").alias(CORRUPT))
    else:
        # With column pruning the parser sees the wanted cells only and takes rows of any length
        # for sound, so a query of one column would count rows that a query of all sets apart.
        reader = spark.read.options(**options).options(
            header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, columnPruning=False
        )
        rows, broken = reader.schema(schema).csv(path).select("*", *place, line), None
    return _fitting(rows, broken, names, sep, wrong)


def _read_pieces(
    spark: SparkSession, path: str | list[str], files: list[str], header: str, sep: str, encoding: str
) -> list[tuple[DataFrame, DataFrame]]:
    """Files of one header with line breaks in cells, read in pieces; those with misplaced quotes as a whole."""
    options, wrong = _options(sep, encoding), _charset(encoding)[1]
    lines = quoted.numbered_lines(spark, path, sep, options["encoding"])
    blocks = quoted.block_rows(lines)
    whole = quoted.misplaced(blocks)
    out = []
    if whole:
        out.append(_read_group(spark, [_literal(f) for f in whole], WHOLE_FILES, header, sep, encoding))
    if len(whole) < len(files):
        reader = spark.read.options(**options, multiLine=True, header=True)
        names = reader.csv(_literal(next(f for f in files if f not in whole))).columns
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
        cells = _parsed(schema, options).alias("cells")
        rows = quoted.records(lines, blocks, whole).select(cells, *PLACE, LINE).select("cells.*", *PLACE, LINE)
        out.append(_fitting(rows, None, names, sep, wrong))
    return out


def _parsed(schema: T.StructType, options: dict) -> Column:
    """The cells of ``value``, a record; its text too, if it has not as many cells as the header."""
    parsing = {k: v for k, v in options.items() if k not in ("multiLine", "encoding")}
    return F.from_csv("value", _ddl(schema), {**parsing, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})


def _fitting(
    rows: DataFrame, broken: DataFrame | None, names: list[str], sep: str, wrong: dict[int, str]
) -> tuple[DataFrame, DataFrame]:
    """Rows that fit their header, with tidy names, and the text of those that don't."""
    # COALESCE keeps Spark from pushing "malformed text is not null" into the parser, where that
    # text is not set yet.
    too_long = F.coalesce(_cells(F.col(CORRUPT), sep), F.lit(0)) > len(names)
    # Spark refuses a scan that needs nothing but the malformed text, as a mere count would. The
    # second test is true for every row and makes each scan look at the first cell too.
    first = col(names[0])
    any_row = first.isNull() | (F.length(first) >= 0)
    df = tidy_header(rows.filter(~too_long & any_row).drop(CORRUPT), len(names))
    malformed = rows.filter(too_long & any_row).select(CORRUPT)
    if broken is not None:
        malformed = malformed.unionByName(broken)
    if wrong:
        texts = [c for c in df.columns if c not in (*PLACE, LINE)]
        fixed = [_repaired(col(c), wrong).alias(c.translate(wrong)) for c in texts]
        df = df.select(*fixed, *PLACE, LINE)
        malformed = malformed.select(_repaired(F.col(CORRUPT), wrong).alias(CORRUPT))
    return df, malformed


def _ddl(schema: T.StructType) -> str:
    return ", ".join("`" + f.name.replace("`", "``") + "` STRING" for f in schema.fields)


def _cells(line, sep: str):
    """Cells of a CSV line: delimiters outside quotes, plus one."""
    bare = F.regexp_replace(line, QUOTED, "")
    gone = F.length(F.replace(bare, F.lit(sep), F.lit("")))
    return F.length(bare) - gone + 1


def read_leads(
    spark: SparkSession,
    path: str | list[str],
    infer_schema: bool = False,
    multi_line: bool | None = None,
) -> LoadedCsv:
    """Lead lists: UTF-8, comma, header. Cells stay text (phone numbers keep their zeros)
    unless ``infer_schema`` is set. Rows that do not fit are in ``malformed``."""
    loaded = read_csv_text(spark, path, multi_line=multi_line)
    rows = null_tokens(loaded.placed)
    return LoadedCsv(typed(rows) if infer_schema else rows, loaded.malformed, loaded.meta)


def read_audit_csv(
    spark: SparkSession,
    path: str | list[str],
    sep: str | None = None,
    encoding: str = "UTF-8",
    multi_line: bool | None = None,
    staged: bool = True,
) -> LoadedCsv:
    """A table with inferred types. Without ``sep`` the files are asked for it first.

    ``encoding`` is windows-1252 or any charset Spark's CSV reader takes: US-ASCII,
    ISO-8859-1, UTF-8, UTF-16 (BE, LE), UTF-32. The text is written once as parquet
    (``staged``), since typing and auditing read the table several times.
    """
    if sep is None:
        sep = common_delimiter(spark, path, encoding)
    loaded = read_csv_text(spark, path, sep, encoding, multi_line)
    text = null_tokens(loaded.placed)
    return LoadedCsv(typed(stage(text, "csv") if staged else text), loaded.malformed, loaded.meta)


def typed(df: DataFrame) -> DataFrame:
    """Give every text column the narrowest of BIGINT, DOUBLE and BOOLEAN that all its values
    have; one aggregate decides. Dates stay text, and so do booleans with gaps."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in PLACE]
    if not names:
        return df
    words = (*fv.CSV_TRUE_WORDS, *fv.CSV_FALSE_WORDS)
    aggregates = [F.count("*").alias("rows")]
    for i, n in enumerate(names):
        c = col(n)
        aggregates += [
            F.count(c).alias(f"values{i}"),
            F.count(_bigint(c)).alias(f"whole{i}"),
            F.count_if(is_number(F.btrim(c))).alias(f"numbers{i}"),
            F.count_if(c.isin(*words)).alias(f"bools{i}"),
        ]
    row = df.agg(*aggregates).first()
    out = {}
    for i, n in enumerate(names):
        values, c = row[f"values{i}"], col(n)
        if not values:
            continue
        if row[f"whole{i}"] == values:
            out[n] = _bigint(c)
        elif row[f"numbers{i}"] == values:
            out[n] = F.btrim(c).try_cast("double")
        elif row[f"bools{i}"] == row["rows"]:
            out[n] = c.isin(*fv.CSV_TRUE_WORDS)
    return df.select(*[out[n].alias(n) if n in out else col(n) for n in df.columns])


def _bigint(c):
    return F.when(F.btrim(c).rlike(fv.INTEGER_PATTERN), F.btrim(c).try_cast("bigint"))


def infer_delimiters(
    spark: SparkSession, path: str | list[str], encoding: str = "UTF-8"
) -> DataFrame:
    """(file, delimiter, lines, agreeing_lines) for every file of a folder.

    Per file and candidate, lines are counted by how often the candidate occurs
    in them. The candidate whose commonest non-zero count covers the most lines
    wins, the larger count on a tie, then the earlier candidate; a file without
    any gets the default. Only counts are shuffled, combined in the map tasks.
    """
    lines = (
        spark.read.option("encoding", _charset(encoding)[0])
        .text(path)
        .select(F.col("_metadata.file_path").alias("file"), "value")
        .filter(F.length(F.trim("value")) > 0)
    )
    bare = F.regexp_replace("value", QUOTED, "")
    occurrences = [
        x
        for i, d in enumerate(fv.DELIMITERS)
        for x in (F.lit(i), F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit(""))))
    ]
    tally = (
        lines.select("file", F.stack(F.lit(len(fv.DELIMITERS)), *occurrences).alias("no", "times"))
        .groupBy("file", "no", "times")
        .agg(F.count("*").alias("n"))
    )
    first = F.col("no") == 0
    best = F.max(
        F.when(F.col("times") > 0, F.struct("n", "times", (-F.col("no")).alias("order")))
    )
    choices = F.array(*[F.lit(d) for d in fv.DELIMITERS])
    return (
        tally.groupBy("file")
        .agg(best.alias("best"), F.sum(F.when(first, F.col("n"))).alias("lines"))
        .select(
            "file",
            F.coalesce(F.get(choices, -F.col("best.order")), F.lit(fv.DEFAULT_DELIMITER)).alias(
                "delimiter"
            ),
            "lines",
            F.coalesce("best.n", F.lit(0)).alias("agreeing_lines"),
        )
    )


def common_delimiter(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> str:
    """The one delimiter of all files; files that disagree must be read one kind at a time."""
    found = infer_delimiters(spark, path, encoding).groupBy("delimiter").agg(F.count("*").alias("n"))
    kinds = {r["delimiter"]: r["n"] for r in found.collect()}
    if len(kinds) > 1:
        raise ValueError(f"files use different delimiters {kinds}: pass sep, one kind at a time")
    return next(iter(kinds), fv.DEFAULT_DELIMITER)
