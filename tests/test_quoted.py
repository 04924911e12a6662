"""CSV with line breaks inside quotes, read in pieces: the same rows as from whole files."""

import random
from pathlib import Path

import pytest

from catalog import files
from tablecare.sources.csv import read_csv_text


@pytest.fixture
def small_pieces(spark):
    """Files are cut every few bytes, while they are read in; staged tables are not."""

    def read(size, *args, **options):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            return read_csv_text(spark, *args, **options)
        finally:
            for name in ("maxPartitionBytes", "openCostInBytes"):
                spark.conf.unset(f"spark.sql.files.{name}")

    return read


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is None, str(x)) for x in r])


def cell(rng):
    text = "".join(rng.choices(['"', ",", "\n", "\n\n", "a", "bc", " ", "é"], weights=[2, 2, 2, 1, 9, 9, 3, 1], k=rng.randint(0, 12)))
    quoted = any(c in text for c in '",\n') or rng.random() < 0.3
    return '"' + text.replace('"', '""') + '"' if quoted else text.strip()


def content(seed, rows, end="\n"):
    rng = random.Random(seed)
    lines = ["id,note,more"]
    for i in range(rows):
        cells = [str(i), cell(rng), cell(rng)]
        if rng.random() < 0.05:
            cells = cells[:2]
        if rng.random() < 0.05:
            cells.append("extra")
        lines.append(",".join(cells))
        if rng.random() < 0.05:
            lines.append("")
    return end.join(lines) + (end if rng.random() < 0.5 else "")


@pytest.mark.parametrize("seed,size,end", [(1, 90, "\n"), (4, 90, "\r\n"), (5, 1 << 20, "\n")])
def test_pieces_give_the_rows_of_whole_files(spark, tmp_path, small_pieces, seed, size, end):
    (tmp_path / "a.csv").write_text(content(seed, 50, end), newline="")
    (tmp_path / "b.csv").write_text(content(seed + 100, 25, end), newline="")
    whole = read_csv_text(spark, str(tmp_path), multi_line=True)
    want, apart = rows_of(whole.df), rows_of(whole.malformed)
    loaded = small_pieces(size, str(tmp_path))
    assert loaded.df.columns == whole.df.columns == ["id", "note", "more"]
    assert rows_of(loaded.df) == want and len(want) > 50
    assert [r[0].replace("\r", "") for r in rows_of(loaded.malformed)] == [r[0].replace("\r", "") for r in apart]
    blocks = loaded.placed.select("__file", "__block").distinct().count()
    assert blocks > (12 if size < 100 else 1)


def test_a_cell_over_many_pieces_and_a_header_of_two_lines(spark, tmp_path, small_pieces):
    text = 'id,"the\nnote"\n1,"' + "line, \n" * 60 + '"\n2,x\n3,"""\n"""\n'
    (tmp_path / "a.csv").write_text(text)
    loaded = small_pieces(25, str(tmp_path))
    assert loaded.df.columns == ["id", "the\nnote"]
    assert rows_of(loaded.df) == [("1", "line, \n" * 60), ("2", "x"), ("3", '"\n"')]
    assert rows_of(loaded.df) == rows_of(read_csv_text(spark, str(tmp_path), multi_line=True).df)


def test_quotes_in_the_middle_of_cells_are_left_to_the_whole_reader(spark, tmp_path, small_pieces):
    (tmp_path / "a.csv").write_text('id,note\n1,5" pipe\n2,"two\nlines"\n3,6" pipe\n')
    (tmp_path / "b.csv").write_text('id,note\n4,"x ""y""\n"\n5,z\n')
    loaded = small_pieces(8, str(tmp_path))
    assert rows_of(loaded.df) == [("1", '5" pipe'), ("2", "two\nlines"), ("3", '6" pipe'), ("4", 'x "y"\n'), ("5", "z")]


def test_row_ids_follow_the_lines(spark, tmp_path, small_pieces):
    (tmp_path / "a.csv").write_text(content(11, 80))
    (tmp_path / "b.csv").write_text("id,note,more\n" + "".join(f"{100 + i},n,m\n" for i in range(30)))
    rows = read_csv_text(spark, str(tmp_path)).with_row_id("at").orderBy("at").collect()
    ids = [int(r["id"]) for r in rows]
    assert ids == sorted(ids) and len({r["at"] for r in rows}) == len(rows) and ids[-1] == 129


def test_other_separators_and_charsets(spark, tmp_path, small_pieces):
    (tmp_path / "a.csv").write_bytes('id|note\n1|"zwei\nZeilen – „x|y“"\n2|ä\n'.encode("cp1252"))
    loaded = small_pieces(8, str(tmp_path), sep="|", encoding="windows-1252")
    assert rows_of(loaded.df) == [("1", "zwei\nZeilen – „x|y“"), ("2", "ä")]


def test_few_and_many_blocks_are_joined_alike(spark, tmp_path, small_pieces, monkeypatch):
    from tablecare.sources import quoted

    (tmp_path / "a.csv").write_text(content(21, 50))
    want = rows_of(small_pieces(60, str(tmp_path)).df)
    monkeypatch.setattr(quoted, "BROADCAST_BLOCKS", 0)
    assert rows_of(small_pieces(60, str(tmp_path)).df) == want


def test_no_task_writes_all_documents_of_a_large_table(spark, tmp_path, monkeypatch):
    texts = [None, "", 'a "b"\nc, d', "plain"] + [f"line {i}\n\n{i}," * 20 for i in range(36)]
    rows = [(i, t, "en", None if t is None else len(t)) for i, t in enumerate(texts)]
    kind = "doc_id LONG, text STRING, lang STRING, n_chars LONG"
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "documents.parquet"))
    written = []
    write = files.sinks.write_table
    monkeypatch.setattr(files.sinks, "write_table", lambda df, path: (written.append(path), write(df, path)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        small = rows_of(files.csv_quoted_breaks_one_file(spark, str(tmp_path)))
        monkeypatch.setattr(files, "FILE_TEXT", 2_000)
        large = rows_of(files.csv_quoted_breaks_one_file(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    one, several = (len(list(Path(path.removeprefix("file:")).glob("part-*"))) for path in written)
    assert one == 1 and several > 3
    assert large == small and len(small) == 40
