"""CSV sources, sinks and staged tables; and the register of queries."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tablecare import infer_delimiters, read_audit_csv, read_leads, stage, with_row_id
from tablecare.sources import sinks
from tablecare.sources.csv import common_delimiter, read_csv_text
from tablecare.sources.staging import shared_folder


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_rows_of_every_length(spark, tmp_path):
    path = write(
        tmp_path / "in",
        a='id, name ,,v\n1,a,x,2\n2\n\n3,"q, ""r""",x,4,5\n4,b,x,6,\n5,"q, ""r""",x,7\n',
    )
    loaded = read_csv_text(spark, path)
    assert loaded.df.columns == ["id", "name", "v"]
    rows = sorted(tuple(r) for r in loaded.df.collect())
    assert rows == [("1", "a", "2"), ("2", None, None), ("5", 'q, "r"', "7")]
    # Asking for one column must not bring over-long rows back.
    assert sorted(r["id"] for r in loaded.df.select("id").collect()) == ["1", "2", "5"]
    assert sorted(r[0] for r in loaded.malformed.collect()) == ['3,"q, ""r""",x,4,5', "4,b,x,6,"]
    assert loaded.df.count() == 3 and loaded.malformed.count() == 2


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is None, str(x)) for x in r])


def test_quoted_line_breaks_are_found_out(spark, tmp_path):
    path = write(tmp_path / "in", a='id,note\n1,"two\nlines"\n2,one\n', b="id,note\n3,plain\n")
    loaded = read_csv_text(spark, path)
    assert rows_of(loaded.df) == [("1", "two\nlines"), ("2", "one"), ("3", "plain")]
    assert loaded.malformed.count() == 0
    by_line = read_csv_text(spark, path, multi_line=False)
    assert by_line.df.count() == 4
    assert rows_of(read_csv_text(spark, path, multi_line=True).df) == rows_of(loaded.df)


def test_files_with_other_headers(spark, tmp_path):
    path = write(
        tmp_path / "in", a="name,email\nAda,ada@x.org\n", b="email,name\nbob@x.org,Bob\n", c="phone, email\n1,c@x.org\n,,9\n"
    )
    loaded = read_csv_text(spark, path)
    assert loaded.df.columns == ["name", "email", "phone"]
    assert rows_of(loaded.df) == [("Ada", "ada@x.org", None), ("Bob", "bob@x.org", None), (None, "c@x.org", "1")]
    assert [r[0] for r in loaded.malformed.collect()] == [",,9"]


def test_quotes_that_never_close(spark, tmp_path):
    path = write(tmp_path / "in", a='id,note\n1,"open\n2,fine\n3,"q, ""x"""\n4,a,b,c\n5\n', b="id,note\n6,x\n")
    loaded = read_csv_text(spark, path)
    assert rows_of(loaded.df) == [("2", "fine"), ("3", 'q, "x"'), ("5", None), ("6", "x")]
    assert sorted(r[0] for r in loaded.malformed.collect()) == ['1,"open', "4,a,b,c"]
    assert loaded.counts().first()["malformed_rows"] == 2


def test_file_names_with_signs(spark, tmp_path):
    folder = tmp_path / "in put"
    path = write(folder, **{"a [1]%20": "x,y\n1,2\n", "b": "y,x\n4,3\n"})
    assert rows_of(read_csv_text(spark, path).df) == [("1", "2"), ("3", "4")]


def test_lead_cells_stay_text_and_na_words_vanish(spark, tmp_path):
    path = write(tmp_path / "in", a="phone,x,y\n0049123,NA,1\n0049124,n/a,nan\n0049125,keep,None\n1,2,3,4\n")
    loaded = read_leads(spark, path)
    df = loaded.df
    assert set(dict(df.dtypes).values()) == {"string"}
    assert sorted((r["phone"], r["x"], r["y"]) for r in df.collect()) == [
        ("0049123", None, "1"), ("0049124", None, None), ("0049125", "keep", None),
    ]
    assert loaded.counts().first()["malformed_rows"] == 1
    typed = read_leads(spark, path, infer_schema=True).df
    assert dict(typed.dtypes) == {"phone": "bigint", "x": "string", "y": "bigint"}


def test_audit_reader_types_and_meta(spark, tmp_path):
    path = write(tmp_path / "in", a="n|d|flag|gap|day\n1|1.5|True|True|2024-01-01\n2|3|false||2024-01-02\n")
    loaded = read_audit_csv(spark, path)
    assert dict(loaded.df.dtypes) == {
        "n": "bigint", "d": "double", "flag": "boolean", "gap": "string", "day": "string",
    }
    assert loaded.counts().first().asDict() == {
        "encoding": "UTF-8", "delimiter": "|", "original_rows": 2, "original_cols": 5, "malformed_rows": 0,
    }
    assert loaded.df.filter("flag").count() == 1


def test_other_encodings(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes("name,n\nJosé,1\nZoë,2\n".encode("latin-1"))
    df = read_audit_csv(spark, str(tmp_path / "in"), sep=",", encoding="ISO-8859-1").df
    assert sorted(r["name"] for r in df.collect()) == ["José", "Zoë"]
    (tmp_path / "win").mkdir()
    (tmp_path / "win" / "a.csv").write_bytes("näme,n\n“José”,1\n5 € – Ž,2\n".encode("cp1252"))
    df = read_audit_csv(spark, str(tmp_path / "win"), sep=",", encoding="Windows-1252").df
    assert sorted(r["näme"] for r in df.collect()) == ["5 € – Ž", "“José”"]


def test_delimiters_per_file(spark, tmp_path):
    path = write(
        tmp_path / "in", comma="a,b\n1,2\n3,4\n", semi='a;b;c\n"x,y";2;3\n4;5;6\n', tab="a\tb\n1\t2\n",
        pipe="a|b\n1|2,3\n4|5\n", none="a\n1\n2\n",
    )
    found = infer_delimiters(spark, path).withColumn("f", F.regexp_extract("file", r"(\w+)\.csv$", 1))
    assert {r["f"]: r["delimiter"] for r in found.collect()} == {
        "comma": ",", "semi": ";", "tab": "\t", "pipe": "|", "none": ",",
    }
    with pytest.raises(ValueError):
        common_delimiter(spark, path)


def test_a_file_without_a_header(spark, tmp_path):
    with pytest.raises(ValueError):
        read_csv_text(spark, write(tmp_path / "in", a=""))


def test_written_spaces_and_quotes_come_back(spark, tmp_path, table):
    df = table(a=["  x ", 'say "hi"', "c,d", None], b=["1", "2", "3", "4"])
    sinks.write_table(df, str(tmp_path / "out"))
    back = read_leads(spark, str(tmp_path / "out")).df
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    sinks.write_table(df, str(tmp_path / "pq"), "parquet")
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 4


def test_row_ids_are_fixed(spark):
    df = with_row_id(spark.range(1000).repartition(7).withColumn("r", F.rand()), "key")
    first, again = df.select("id", "key").collect(), df.repartition(3).select("id", "key").collect()
    assert sorted(first) == sorted(again) and len({r["key"] for r in first}) == 1000
    with pytest.raises(ValueError):
        with_row_id(df, "KEY")


def test_row_ids_follow_files_and_lines(spark, tmp_path):
    path = write(
        tmp_path / "in", a="id\n" + "\n".join(f"a{i}" for i in range(3)), b="id\n" + "\n".join(f"b{i:04d}" for i in range(3000))
    )
    for df in (read_leads(spark, path).with_row_id(), with_row_id(spark.read.option("header", True).csv(path))):
        assert df.columns == ["id", "row_id"]
        ids = [r["id"] for r in df.orderBy("row_id").collect()]
        assert ids == sorted(ids) and len(ids) == 3003
    mixed = read_leads(spark, write(tmp_path / "mixed", a="x,id\n,1\n,2\n", b="id\n" + "3\n" * 500, c="x,id\n,4\n"))
    ids = [r["id"] for r in mixed.with_row_id().orderBy("row_id").collect()]
    assert ids == ["1", "2", *["3"] * 500, "4"]


def test_staged_tables_lie_in_the_shared_folder(spark):
    staged = stage(spark.range(5))
    assert all(shared_folder(spark) in f for f in staged.inputFiles())


def test_the_register():
    import __spark_entry__ as entry
    from catalog import ORACLES, QUERIES

    assert set(QUERIES) == set(ORACLES) and len(QUERIES) > 100
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ["clean_lead_list", "lead_dedupe", "suggestions", "coerce_table"])
def test_queries_agree_with_sql(spark, name):
    import glob
    import os

    import check

    sf_dir = "/root/testdata/sf0.001"
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        view = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM read_parquet('{path}')")
    verdict, _ = check.compare(spark, con, sf_dir, name)
    assert verdict.startswith("ok"), verdict
