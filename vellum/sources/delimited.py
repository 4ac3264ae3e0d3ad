"""Delimited-file scan with separator detection (A1, A2).

Every column is read as STRING (explicit schema from the header), so no
``inferSchema`` pass runs over the data; typing happens later, by contract.
"""

from __future__ import annotations

import csv
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators.materialize import materialize
from vellum.sources.records import numbered, probe, records, scanned_file

# Candidate separators in tie-break order, the fallback and the
# number of leading bytes inspected.
SEPARATORS = [",", ";", "\t", "|"]
DEFAULT_SEP = ","
SNIFF_BYTES = 1024

#: doubled quotes; an empty field is null, a quoted empty one is not (the null text is one that no file holds)
READ_OPTIONS = {"escape": '"', "nullValue": "\u0000", "emptyValue": ""}


def separator_of(head: Column) -> Column:
    """Most frequent candidate in ``head``; ties -> earlier candidate; none -> ','."""
    counts = [F.struct((F.length(head) - F.length(F.replace(head, F.lit(s), F.lit("")))).alias("n"),
                       F.lit(-i).alias("r"), F.lit(s).alias("s"))
              for i, s in enumerate(SEPARATORS)]
    best = F.array_max(F.array(*counts))
    return F.when(F.coalesce(best["n"], F.lit(0)) > 0, best["s"]).otherwise(F.lit(DEFAULT_SEP))


def byte_head(text: Column, n: int = SNIFF_BYTES) -> Column:
    """The first ``n`` UTF-8 bytes of a text, as text (a cut character is lost,
    which never touches the ASCII separators)."""
    return F.substring(F.encode(text, "UTF-8"), 1, n).cast("string")


def detect_separator(df: DataFrame, text_col: str, key: str | list[str],
                     sniff_bytes: int | None = SNIFF_BYTES) -> DataFrame:
    """A2 over a column of file texts: (key..., separator) per row.

    The separator is defined by the first ``sniff_bytes`` bytes of each text
    (as a file sniffer sees it); ``None`` counts over the whole text.
    """
    keys = [key] if isinstance(key, str) else list(key)
    head = F.col(text_col) if sniff_bytes is None else byte_head(F.col(text_col), sniff_bytes)
    return df.select(*keys, separator_of(head).alias("separator"))


def _data_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Every data file under files, folders or glob paths, by name (names that start with '_' or '.' are none)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files, todo = [], []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        todo += [(fs, st) for st in fs.globStatus(p) or []]
    while todo:
        fs, st = todo.pop()
        if st.getPath().getName().startswith(("_", ".")):
            continue
        if st.isDirectory():
            todo += [(fs, c) for c in fs.listStatus(st.getPath())]
        elif st.getLen() > 0:
            files.append(st.getPath().toString())
    return sorted(files)


def _separator(head: bytes) -> str:
    text = head[:SNIFF_BYTES].decode("utf-8", errors="ignore")
    counts = {s: text.count(s) for s in SEPARATORS}
    best = max(SEPARATORS, key=lambda s: (counts[s], -SEPARATORS.index(s)))
    return best if counts[best] > 0 else DEFAULT_SEP


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The separator of the first file under ``path``."""
    files = _data_files(spark, [path])
    return _separator(probe(spark, files[:1], SNIFF_BYTES, 0).first()["head"].encode()) if files else DEFAULT_SEP


class Layout(NamedTuple):
    """What files must share to be read together."""

    sep: str
    header: tuple[str, ...]
    way: str  # 'lines': Spark's line-wise reader; 'records': records over splits; 'whole': Spark's whole-file reader


def file_layouts(spark: SparkSession, files: list[str], sep: str = "auto", header_row: int = 0) -> dict[Layout, list[str]]:
    """Files by layout, found by tasks in one pass over them; only names and headers come to the driver."""
    groups: dict[Layout, list[str]] = {}
    for r in probe(spark, files, SNIFF_BYTES, header_row).orderBy("file").collect():
        used = _separator(r.head.encode()) if sep == "auto" else sep
        way = "whole" if r.broken and not header_row else "records" if r.spans or header_row else "lines"
        if way == "records" and r.header.count('"') % 2:
            first = records(spark, [r.file], header_row).filter("number = 0").first()  # a header over several lines
            header = first["record"]
        else:
            header = re.split("\r", r.header)[0] if way == "lines" else r.header.rstrip("\r")
        names = tuple(next(csv.reader([header], delimiter=used), []))
        groups.setdefault(Layout(used, names, way), []).append(r.file)
    return groups


def _all_text(names: tuple[str, ...]) -> T.StructType:
    """A column per header name, named as Spark's reader does: empty ones by place, repeated ones with their place."""
    named = [n or f"_c{i}" for i, n in enumerate(names)]
    low = [n.lower() for n in named]
    return T.StructType([T.StructField(n + str(i) if low.count(n.lower()) > 1 else n, T.StringType()) for i, n in enumerate(named)])


def read_layout(spark: SparkSession, files: list[str], layout: Layout, header_row: int = 0, schema: T.StructType | None = None,
                file_col: str | None = None) -> DataFrame:
    """Files of one layout (``file_layouts``), with their paths in ``file_col`` if that is given."""
    schema = schema or _all_text(layout.header)
    if layout.way == "records":
        parsed = F.from_csv("record", schema.simpleString(), {"sep": layout.sep, **READ_OPTIONS})
        found = records(spark, files, header_row).filter("number > 0").select(F.col("file").alias(file_col or "file"), parsed.alias("r"))
        return found.select(*[file_col] * bool(file_col), "r.*")
    reader = spark.read.option("header", True).option("sep", layout.sep).option("mode", "PERMISSIVE").options(**READ_OPTIONS)
    rows = reader.option("multiLine", layout.way == "whole").schema(schema).csv(files)
    return rows.withColumn(file_col, scanned_file()) if file_col else rows


def read_delimited(spark: SparkSession, paths: str | list[str], sep: str = "auto", header_row: int = 0,
                   schema: T.StructType | None = None) -> DataFrame:
    """A1: header on, all columns STRING.

    Every file has its own separator (with ``sep='auto'``) and header: files of
    one layout are read together, and layouts are brought together by column
    name (a column that a file lacks is null there).  Empty files hold no rows.
    An empty field is null, a quoted empty field is ''.  With ``schema`` a file
    whose header holds all of its names is read by name, any other by position.

    Large files are read by many tasks: line by line where no record holds a
    newline, else as ``records`` of splits.  Files whose quotes don't pair go to
    Spark's whole-file reader.  ``header_row=N`` skips the N lines before the
    header in each file (those files are read as ``records``).
    """
    files = _data_files(spark, [paths] if isinstance(paths, str) else list(paths))
    if not files:
        if schema is None:
            raise ValueError(f"no data under {paths}")
        return spark.createDataFrame([], schema)
    out = None
    for layout, own in file_layouts(spark, files, sep, header_row).items():
        if not layout.header:
            continue  # empty lines only
        by_name = schema is not None and len(set(layout.header)) == len(layout.header) and set(schema.names) <= set(layout.header)
        if by_name:
            types = {f.name: f for f in schema.fields}
            wide = T.StructType([types.get(n, T.StructField(n, T.StringType())) for n in layout.header])
            part = read_layout(spark, own, layout, header_row, wide).select(*(F.col(f"`{n}`") for n in schema.names))
        else:
            part = read_layout(spark, own, layout, header_row, schema)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return spark.createDataFrame([], schema or T.StructType([])) if out is None else out


def read_numbered(spark: SparkSession, paths: str | list[str], sep: str = "auto", header_row: int = 0,
                  row_col: str = "row") -> DataFrame:
    """A1 with row numbers: ``read_delimited`` and the number of each data record, from 1, over all files by name.

    For uploads without a key: validation (E6) takes the number as the row's key.
    Every file is read as ``records``, so its quotes must pair.
    """
    files = _data_files(spark, [paths] if isinstance(paths, str) else list(paths))
    if not files:
        raise ValueError(f"no data under {paths}")
    layouts = file_layouts(spark, files, sep, header_row)
    broken = [f for layout, own in layouts.items() if layout.way == "whole" for f in own]
    if broken:
        raise ValueError(f"quotes don't pair in {broken[0]}" + f" and {len(broken) - 1} more" * (len(broken) > 1))
    found, _, _ = materialize(numbered(records(spark, files, header_row)).filter("number > 0"), "file-records")
    out = None
    for layout, own in layouts.items():
        if not layout.header:
            continue
        schema = _all_text(layout.header)
        parsed = F.from_csv("record", schema.simpleString(), {"sep": layout.sep, **READ_OPTIONS})
        mine = found if len(layouts) == 1 else found.join(spark.createDataFrame([(f,) for f in own], "file string"), "file", "left_semi")
        part = mine.select(F.col("row").alias(row_col), parsed.alias("r")).select(row_col, "r.*")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return spark.createDataFrame([], f"{row_col} long") if out is None else out


def profile_file(spark: SparkSession, paths: str | list[str], sep: str = "auto", header_row: int = 0) -> DataFrame:
    """C5 for files: read (A1, separators sniffed unless given) and profile in
    one aggregation pass; the row carries the separator that was used, or where
    files differ all that were, most preferred first, with a space between."""
    from vellum.operators.profile import profile

    files = _data_files(spark, [paths] if isinstance(paths, str) else list(paths))
    used = {lay.sep for lay in file_layouts(spark, files, sep, header_row) if lay.header} if files else set()
    shown = " ".join(sorted(used, key=lambda x: (SEPARATORS + [x]).index(x))) or (DEFAULT_SEP if sep == "auto" else sep)
    return profile(read_delimited(spark, paths, sep=sep, header_row=header_row), fmt="csv", separator=shown)
