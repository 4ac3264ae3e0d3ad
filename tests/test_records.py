"""Splittable reading of delimited files against Python's csv module and Spark's whole-file reader."""

import csv
import io
import random

import pytest

from vellum.operators import contract
from vellum.sources import delimited as D
from vellum.sources import records as R

CELLS = ["", "x", "a,b", 'say "hi"', "two\nlines", "\n", '"', "três", "  pad ", "l1\r\nl2", ",", '""', "z" * 40]


@pytest.fixture(params=[40, 97, 1 << 20])
def splits(request, spark):
    """Files are cut into splits of this many bytes."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def write(path, rows, end="\n", sep=",", quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    csv.writer(out, lineterminator=end, delimiter=sep, quoting=quoting).writerows(rows)
    path.write_bytes(out.getvalue().encode())


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_equal_the_csv_module(spark, tmp_path, splits, end):
    rng = random.Random(splits)
    want = []
    for f in range(3):
        rows = [("id", "t", "u")] + [(f"{f}-{i}", rng.choice(CELLS), rng.choice(CELLS)) for i in range(60)]
        write(tmp_path / f"{f}.csv", rows, end, quoting=csv.QUOTE_ALL if f == 1 else csv.QUOTE_MINIMAL)
        want += rows[1:]
    kept = D.read_numbered(spark, str(tmp_path)).orderBy("row")
    assert kept.columns == ["row", "id", "t", "u"]
    got = rows_of(kept)
    assert [r[0] for r in got] == list(range(1, 181)) and [tuple(x or "" for x in r[1:]) for r in got] == want
    plain = rows_of(D.read_delimited(spark, str(tmp_path)))
    assert sorted(tuple(x or "" for x in r) for r in plain) == sorted(want)
    whole = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path))
    if end == "\n":
        assert sorted(tuple(x or "" for x in r) for r in rows_of(whole)) == sorted(want)
    if splits < 100:
        assert R.numbered_lines(spark, D._data_files(spark, [str(tmp_path)])).rdd.getNumPartitions() > 20


def test_empty_text_is_not_null(spark, tmp_path):
    from vellum.sinks.csv_export import export_csv
    df = spark.createDataFrame([("1", ""), ("2", None), ("3", "a\nb"), ("4", " ")], "k string, v string")
    path = export_csv(df, str(tmp_path / "out"))
    assert sorted(rows_of(D.read_delimited(spark, path))) == [("1", ""), ("2", None), ("3", "a\nb"), ("4", " ")]


def test_unpaired_quotes_go_to_the_whole_file_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,5" disk\n2,x\n')
    (tmp_path / "b.csv").write_text('id,t\n3,"a\nb"\n')
    ways = {lay.way: [f.rsplit("/", 1)[-1] for f in own] for lay, own in D.file_layouts(spark, D._data_files(spark, [str(tmp_path)])).items()}
    assert ways == {"whole": ["a.csv"], "records": ["b.csv"]}
    assert sorted(rows_of(D.read_delimited(spark, str(tmp_path)))) == [("1", '5" disk'), ("2", "x"), ("3", "a\nb")]
    with pytest.raises(ValueError, match="a.csv"):
        D.read_numbered(spark, str(tmp_path))


def test_heads_and_odd_files(spark, tmp_path, splits):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfid;t\n1;x\n")
    (tmp_path / "b.csv").write_text("\n\nid;t\n\n2;y\n\n")
    (tmp_path / "c.csv").write_text("\n")
    (tmp_path / "d.csv").write_text('id;"t"\n3;"p\n\nq"\n')
    (tmp_path / "e.csv").write_text("t;id\nz;4\n")
    want = [("1", "x"), ("2", "y"), ("3", "p\n\nq"), ("4", "z")]
    assert sorted(rows_of(D.read_delimited(spark, str(tmp_path)).select("id", "t"))) == want
    assert [(r.row, r.id) for r in D.read_numbered(spark, str(tmp_path)).orderBy("row").collect()] == [(i, str(i)) for i in (1, 2, 3, 4)]
    given = D.read_delimited(spark, str(tmp_path), schema=D._all_text(("id", "t")))
    assert sorted(rows_of(given)) == want  # files whose header names the columns are read by name
    sep = D.file_layouts(spark, [str(tmp_path / "a.csv")])
    assert [lay.sep for lay in sep] == [";"]


def test_separator_counts_the_first_bytes_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n" + "1,2\n" * 250 + "x;y;z\n" * 4000)
    assert D.sniff_separator(spark, str(tmp_path)) == ","
    (tmp_path / "b.csv").write_text("é" * 600 + ";;")
    assert D.sniff_separator(spark, str(tmp_path / "b.csv")) == ","


def test_violations_by_row_number(spark, tmp_path):
    (tmp_path / "u.csv").write_text('id,name\n1,"a\nb"\nx,c\n\n3,d\ny y,e\n')
    fields = {"schema": {"fields": [{"name": "id", "type": "int", "required": True}, {"name": "name", "type": "str"}]}}
    got = contract.violations(D.read_numbered(spark, str(tmp_path)), fields, "row").orderBy("row").collect()
    assert [(r.row, r.field, r.value) for r in got] == [(2, "id", "x"), (4, "id", "y y")]


def test_packing_setting_comes_back(spark):
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    with pytest.raises(RuntimeError), R.one_split_per_task(spark):
        raise RuntimeError
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before


def test_documents_are_written_and_read_by_many_tasks(spark, tmp_path, splits, monkeypatch):
    from vellum.plans import registry

    rows = [(i, f'{i}: "x",\n\n{CELLS[i % len(CELLS)]}' + " ||| ;" * 20 * (i % 2), "en", "web", i) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(
        str(tmp_path / "documents.parquet"))
    wrote, export = [], registry.export_csv
    monkeypatch.setattr(registry, "export_csv", lambda *a, **k: wrote.append(export(*a, **k)) or wrote[-1])
    monkeypatch.setattr(registry, "_t", lambda s, sf, name: s.read.parquet(f"{sf}/{name}.parquet").repartition(5))
    got = rows_of(registry.q_read_delimited_text(spark, str(tmp_path)))
    assert sorted(got) == sorted(tuple(map(str, r)) for r in rows)
    assert len(D._data_files(spark, wrote)) > 1


@pytest.mark.parametrize("bits", [0, 3])
def test_one_split_is_dealt_over_tasks(spark, tmp_path, monkeypatch, bits):
    from pyspark.sql import functions as F

    rng = random.Random(bits)
    rows = [("id", "t", "u")] + [(str(i), rng.choice(CELLS), rng.choice(CELLS)) for i in range(80)]
    write(tmp_path / "a.csv", rows)
    tasks, kept = [], R.materialize

    def seen(df, name, **how):
        out = kept(df.withColumn("task", F.spark_partition_id()), name, **how)
        tasks.append(out[0].select("task").distinct().count())
        return out

    monkeypatch.setattr(R, "BLOCK_BITS", bits)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    monkeypatch.setattr(R, "materialize", seen)
    try:
        found = R.records(spark, [str(tmp_path / "a.csv")])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert tasks[0] > 1
    got = [next(csv.reader(io.StringIO(r.record))) for r in found.orderBy("number").collect()]
    assert [tuple(x) for x in got] == rows
