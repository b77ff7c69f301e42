import csv
import io
import json
import random

import pytest

from tablecheck.operators.profile import Profile
from tablecheck.operators.clean import clean
from tablecheck.sources import export, records, storage, tables


@pytest.fixture
def write(tmp_path):
    def f(content, name="t.csv"):
        path = tmp_path / name
        path.write_bytes(content if isinstance(content, bytes) else content.encode("utf-8"))
        return str(path)

    return f


@pytest.mark.parametrize("sep", tables.SEPARATORS)
def test_separators(spark, write, sep):
    lines = ["id,nome,valor", '1,"a,b",2.5', '2,"c;d|e",3']
    text = "\n".join(line.replace(",", sep) for line in lines)
    r = tables.read_csv(spark, write(text))
    assert r.meta == {"encoding": "UTF-8", "separator": sep}
    assert r.df.columns == ["id", "nome", "valor"] and r.df.count() == 2


def test_separator_falls_back_to_comma(spark, write):
    r = tables.read_csv(spark, write("only\nx\ny\n"))
    assert r.meta["separator"] == "," and r.df.columns == ["only"]


@pytest.mark.parametrize("encoding, found", [("utf-8", "UTF-8"), ("latin-1", "ISO-8859-1"), ("utf-8-sig", "UTF-8"), ("utf-16", "UTF-16LE")])
def test_encodings(spark, write, encoding, found):
    r = tables.read_csv(spark, write("ação,n\nJoão,1\n".encode(encoding)))
    assert r.meta["encoding"] == found
    assert r.df.columns == ["ação", "n"] and r.df.first()[0] == "João"


def test_one_bad_byte_at_the_end_counts(spark, write):
    r = tables.read_csv(spark, write(b"a,b\n" + b"x,1\n" * 5000 + "é,2\n".encode("latin-1")))
    assert r.meta["encoding"] == "ISO-8859-1" and r.df.where("a = 'é'").count() == 1


@pytest.mark.parametrize(
    "cells, kind",
    [
        (["1", "-2", "+3"], "bigint"),
        (["1", "", "3"], "double"),
        (["1", "2.5", "1e3"], "double"),
        (["inf", "-Infinity", "1"], "double"),
        (["1", " ", "3"], "string"),
        (["True", "false", "TRUE"], "boolean"),
        (["True", "", "False"], "string"),
        (["2024-01-01", "2024-01-02", "2024-01-03"], "string"),
        (["NA", "null", "None"], "double"),
        (["1,5", "2", "3"], "string"),
        (["1d", "2f", "3"], "string"),
    ],
)
def test_types(spark, write, cells, kind):
    r = tables.read_csv(spark, write("k;v\n" + "".join(f"x;{c}\n" for c in cells)))
    assert dict(r.df.dtypes)["v"] == kind


def test_null_spellings(spark, write):
    r = tables.read_csv(spark, write("k,v\n" + "".join(f"x,{v}\n" for v in ["NA", "n/a", "null", "None", "none", "Null", "-", " NA", "#N/A"])))
    assert [x.v for x in r.df.where("v is not null").collect()] == ["none", "Null", "-", " NA"]


@pytest.mark.parametrize(
    "content, part",
    [("", "empty"), ("a,b\n", "no rows"), ("a,b\n1,2\n3,4,5\n", "more than 2"), ("\n\n", "empty"), ("a,b\n1,2\n3,4,,99\n", "more than 2"), ("a,b\n1,2\n3,4,\n", "more than 2"),
     ('a,b\n1,2\n3,"x,y",\n', "more than 2")],
)
def test_load_guards(spark, write, content, part):
    r = tables.read_csv(spark, write(content))
    assert r.df is None and part in r.error


def test_short_rows_are_padded(spark, write):
    r = tables.read_csv(spark, write("a,b\n1,2\n3\n"))
    assert r.error is None and [tuple(x) for x in r.df.collect()] == [(1, 2.0), (3, None)]


def test_quoted_separators_are_no_surplus(spark, write):
    r = tables.read_csv(spark, write('a,b,c\n1,"x,y,z",3\n2,"p,q,r"\n'))
    assert r.error is None and [tuple(x) for x in r.df.collect()] == [(1, "x,y,z", 3.0), (2, "p,q,r", None)]


def test_wide_header(spark, write):
    names = [f"a_rather_long_name_{i}" for i in range(1200)]
    r = tables.read_csv(spark, write(",".join(names) + "\n" + ",".join(["1"] * 1200) + "\n"))
    assert r.error is None and r.df.columns == names and set(r.df.first()) == {1}


def test_windows_characters(spark, write):
    r = tables.read_csv(spark, write("preço,n\n“5 €”,1\n".encode("windows-1252")))
    assert r.meta["encoding"] == "windows-1252" and r.df.columns == ["preço", "n"] and r.df.first()[0] == "“5 €”"


def test_utf16_lines(spark, write):
    r = tables.read_csv(spark, write("a;b\r\n1;é\r\n2;ü\r\n".encode("utf-16")))
    assert r.error is None and [tuple(x) for x in r.df.collect()] == [(1, "é"), (2, "ü")]


def test_scratch_folder(spark, monkeypatch):
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, *_):
            return self.value

    class Session:
        def __init__(self, folder, master, context_dir=None):
            self.conf = Conf(folder)
            scala = type("S", (), {"getCheckpointDir": lambda _: type("O", (), {"isDefined": lambda _: bool(context_dir), "get": lambda _: context_dir})()})
            self.sparkContext = type("C", (), {"master": master, "applicationId": "test-app", "_jsc": type("J", (), {"sc": lambda _: scala()})()})()

    assert storage.scratch_path(Session("file:///x/", "yarn"), "a").startswith("file:///x/tablecheck-a-")
    assert storage.scratch_folder(Session(None, "yarn", "hdfs://c/d")) == "hdfs://c/d"
    assert storage.scratch_folder(Session(None, "local[4]")) == storage.scratch_folder(Session(None, "local[4]"))
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(RuntimeError):
            storage.scratch_folder(Session(None, master))


def test_repeated_and_clashing_headers(spark, write):
    r = tables.read_csv(spark, write("Name,name,Name,\n1,2,3,4\n"))
    assert r.df.columns == ["Name", "name.1", "Name.2", "Unnamed: 3"]
    assert Profile(r.df).column_profile().count() == 4
    assert clean(r.df).df.columns == ["name", "name_1", "name_2", "unnamed_3"]


def test_line_breaks_in_quotes(spark, write):
    r = tables.read_csv(spark, write('a,b\n1,"x\ny"\n'), multi_line=True)
    assert r.df.first().b == "x\ny"


@pytest.mark.parametrize("size", [7, 64, 1000])
def test_records_over_splits(spark, tmp_path, size):
    rng = random.Random(size)
    cell = lambda: rng.choice(["", "a", "x,y", 'say ""hi""', "one\ntwo", "\n", "long " * 30 + "\n\n" + "é" * 40, "1\r\n2"])
    rows = [(str(i), cell(), cell()) for i in range(200)]
    folder = tmp_path / "many"
    folder.mkdir()
    for part in range(3):
        body = "".join(f'{a},"{b}","{c}"\n' for a, b, c in rows[part::3])
        (folder / f"{part}.csv").write_bytes(("id,b,\"the\nc\"\n" + body).encode())
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size * 10))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = records.quoted_records(spark, str(folder)).where("not first")
        assert got.rdd.getNumPartitions() > 3
        found = sorted(next(csv.reader(io.StringIO(r["record"], newline=""))) for r in got.collect())
        r = tables.read_csv(spark, str(folder), multi_line=True, separator=",")
        assert r.error is None and r.df.count() == 200
        assert {tuple(x)[1] for x in r.df.select("id", "b").collect()} <= {b.replace('""', '"') or None for _, b, _c in rows}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])
        spark.conf.set("spark.sql.files.openCostInBytes", kept[1])
    assert found == sorted([a, b.replace('""', '"'), c.replace('""', '"')] for a, b, c in rows)


def test_several_tables(spark, write, tmp_path):
    got = tables.read_tables(spark, {"one_t": write("a,b\n1,2\n", "1.csv"), "bad_t": write("", "2.csv"), "gone_t": str(tmp_path / "x.csv")})
    assert [r.error is None for r in got.values()] == [True, False, False]
    assert spark.table("one_t").count() == 1


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_other_formats(spark, tmp_path, fmt):
    path = str(tmp_path / f"t.{fmt}")
    spark.createDataFrame([(1.0,), (None if fmt == "json" else float("nan"),)], "v double").write.format(fmt).save(path)
    r = tables.read_table(spark, path)
    assert r.error is None and r.df.where("v is null").count() == 1


def test_csv_round_trip_keeps_blanks_and_quotes(spark, tmp_path):
    rows = [(1, ' pad "q" '), (2, "a,b"), (3, None), (4, "\\")]
    export.write_csv(spark.createDataFrame(rows, "k int, c string"), str(tmp_path / "o"))
    assert sorted(tuple(x) for x in tables.read_csv(spark, str(tmp_path / "o")).df.collect()) == rows


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(v, None if v == 3 else "x") for v in [*range(1, 20), 1000]], "v int, c string")
    p, r = Profile(df), clean(df)
    assert export.export_tables(r.df, p, str(tmp_path / "e")) == ["data", "missing", "outliers"]
    assert spark.read.parquet(str(tmp_path / "e/outliers")).first().column == "v"
    tidy = Profile(spark.range(5))
    assert export.export_tables(spark.range(5).toDF("id"), tidy, str(tmp_path / "f"), "csv") == ["data"]
    export.write_report(export.report_frame(p, "t", 88.5, "good", r.report), str(tmp_path / "r"))
    part = next((tmp_path / "r").glob("*.json"))
    report = json.loads(part.read_text())
    assert report["quality_score"] == 88.5 and report["summary"]["rows"] == 20
    assert report["treatment_report"]["rows_after"] == 20 and report["generated_at"]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_export_is_read_whole_or_not_at_all(spark, tmp_path, fmt, monkeypatch):
    df = spark.createDataFrame([(v, None if v == 3 else 'x\n"y"') for v in [*range(1, 20), 1000]], "v int, c string")
    p, r = Profile(df), clean(df)
    path = str(tmp_path / "e")
    export.export_tables(r.df, p, path, fmt)
    got = export.read_exported(spark, path)
    assert {n: t.count() for n, t in got.items()} == {"data": 20, "missing": 1, "outliers": 1}
    (spark.range(3).selectExpr("int(id) v", "'z' c").write.mode("append").format(fmt).options(header=True).save(path + "/data"))
    with pytest.raises(ValueError, match="holds 23 rows, the manifest says 20"):
        export.read_exported(spark, path)

    def fails(*_):
        raise OSError("disk full")

    monkeypatch.setattr(Profile, "outlier_table", lambda self: fails())
    with pytest.raises(OSError):
        export.export_tables(r.df, Profile(df), str(tmp_path / "f"), fmt)
    # a failure while the tables are written, after the first of them
    (r.df.write.format(fmt)).save(str(tmp_path / "g/data"))
    for broken in ("f", "g"):
        with pytest.raises(FileNotFoundError):
            export.read_exported(spark, str(tmp_path / broken))


def test_persisted_read(spark, write):
    r = tables.read_table(spark, write("a,b\n1,2\n"), persist=True)
    assert r.df.is_cached and r.df.count() == 1
    r.df.unpersist()


def test_separator_by_all_lines_follows_the_rule_for_samples(spark, tmp_path):
    from tablecheck.sources.tables import SEPARATORS, detect_separator, separator_figures, sniff_separator

    files = [
        ['a;b', '"x;y";1', '"p""q;";2', "", '";open', 'u"v;w"'],
        ["a|b,c", "1|2,3", "4|5,6,7", "|,"],
        ["one", "two"],
        ['"a,b"\t"c"', "1\t2,3", '""\t""'],
        ["\ufeffa;b", "ä;é"],
    ]
    for i, lines in enumerate(files):
        path = tmp_path / f"{i}.csv"
        path.write_text("\r\n".join(lines) + "\n", encoding="utf-8", newline="")
        assert detect_separator(spark, str(path)) == sniff_separator(lines)
        for sep in SEPARATORS:
            counts = [len(next(csv.reader([x.lstrip("\ufeff")], delimiter=sep))) for x in lines if x.strip()]
            usual = max(sorted(set(counts), reverse=True), key=counts.count)
            assert separator_figures(spark, str(path))[sep] == (len(counts), usual, counts.count(usual))
    (tmp_path / "empty.csv").write_text("\n\n")
    assert detect_separator(spark, str(tmp_path / "empty.csv")) == ","
