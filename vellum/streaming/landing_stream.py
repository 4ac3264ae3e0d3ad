"""Continuous landing: every delimited file that arrives in an inbox folder
is checked against the contract and landed, or rejected, as a whole file.

The batch job (``sinks.landing.land``) gates one upload; here the file
source delivers the paths of new files in micro-batches (``binaryFile`` with
its content pruned, so nothing is read twice) and ``foreachBatch`` gates each
file separately.  A file's header decides first: a missing required column, a
column that the contract doesn't have, or no data line rejects the file by
name (a file of zero bytes is never delivered by Spark's file source).  The others are read by header name, whatever their columns' order,
staged once in the shared folder, and their problems counted in one
aggregation by file.  Each clean file gets a folder of its own, in the layout of
the batch job, and a manifest row with that folder as its key and the size
listed there, so that ``list_landed`` and ``attach_metadata`` join both jobs'
uploads; rejected files get a report row and their lines are kept as dead letters.

A file's folder is named by the id of the query (kept in its checkpoint), of the
batch, the file and its time of arrival, the other outputs by query and batch.
All are overwritten on replay, so a retried batch (after an executor or driver
loss) writes the same files again instead of duplicating them, and another
checkpoint on the same root overwrites nothing.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.functions.keys import landing_key
from vellum.functions.predicates import blank
from vellum.operators.contract import _bad_cells, contract_fields
from vellum.operators.materialize import materialize
from vellum.sinks.csv_export import TEXT_OPTIONS
from vellum.sources.delimited import file_layouts, read_layout
from vellum.sources.listing import list_landed
from vellum.sources.records import scanned_file


def _problems_per_file(batch: DataFrame, contract: dict) -> DataFrame:
    req = [f["name"] for f in contract_fields(contract) if f.get("required") and f["name"] in batch.columns]
    aggs = [F.count(F.lit(1)).alias("rows"), F.sum(_bad_cells(batch, contract)).alias("bad_cells")]
    aggs += [F.max(F.when(blank(F.col(f"`{n}`")), 1).otherwise(0)).alias(f"b{i}") for i, n in enumerate(req)]
    per = batch.groupBy("__file").agg(*aggs)
    blanks = sum((F.col(f"b{i}") for i in range(len(req))), F.lit(0))
    return per.select("__file", "rows", (F.coalesce(F.col("bad_cells"), F.lit(0)) + blanks).alias("problems"))


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark keeps in the checkpoint's ``metadata`` file."""
    return json.loads(spark.read.text(checkpoint.rstrip("/") + "/metadata", wholetext=True).first()["value"])["id"]


def _header_problems(header: tuple[str, ...], contract: dict) -> list[str]:
    names = [f["name"] for f in contract_fields(contract)]
    missing = [f["name"] for f in contract_fields(contract) if f.get("required") and f["name"] not in header]
    out = [f"missing column {n}" for n in missing] + [f"extra column {n}" for n in header if n not in names]
    return out + [f"repeated column {n}" for n in dict.fromkeys(header) if header.count(n) > 1]


def land_stream(spark: SparkSession, inbox: str, contract: dict, root: str, checkpoint: str,
                meta: dict, sep: str = ",", trigger: dict | None = None,
                max_files_per_trigger: int = 1000) -> StreamingQuery:
    """Start the landing stream.  ``meta`` holds subject and sub_subject.

    ``trigger`` is passed to ``writeStream.trigger`` (default: process what
    is available now, then stop).  ``max_files_per_trigger`` bounds a
    micro-batch and with it the list of paths whose headers the driver looks at;
    files beyond it come in the next micro-batch.
    """
    fields = contract_fields(contract)
    names = [f["name"] for f in fields]
    src = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
           .option("maxFilesPerTrigger", int(max_files_per_trigger)).load(inbox).select("path", "modificationTime"))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        query = _query_id(spark, checkpoint)
        own = f"run={query}/batch={batch_id}"
        arrived = {r.path: r.modificationTime for r in batch.collect()}  # one row per file: at most max_files_per_trigger
        verdicts, staged = [], None
        layouts = file_layouts(spark, sorted(arrived), sep) if arrived else {}
        for layout, files in layouts.items():
            reasons = _header_problems(layout.header, contract)
            if reasons:
                verdicts += [(f, 0, len(reasons), "; ".join(reasons)) for f in files]
                continue
            rows = read_layout(spark, files, layout, file_col="__file")
            rows = rows.select("__file", *[F.col(f"`{n}`") if n in layout.header else F.lit(None).cast("string").alias(n) for n in names])
            # every file is listed, so that one without a data line is rejected, too
            rows = rows.withColumn("__row", F.lit(True)).unionByName(
                spark.createDataFrame([(f,) for f in files], "__file string"), allowMissingColumns=True)
            staged = rows if staged is None else staged.unionByName(rows)
        known = spark.createDataFrame(verdicts, "file string, rows long, problems long, reason string")
        if staged is not None:
            staged, _, _ = materialize(staged, "landing-batch")
            found = _problems_per_file(staged.filter("__row"), contract)
            listed = staged.select("__file").distinct().join(found, "__file", "left").select(
                F.col("__file").alias("file"), F.coalesce("rows", F.lit(0)).alias("rows"),
                F.coalesce("problems", F.lit(1)).alias("problems"),
                F.when(F.col("rows").isNull(), "no data line").when(F.col("problems") > 0, "bad cells").alias("reason"))
            known = known.unionByName(listed)
        verdict, _, _ = materialize(known, "landing-verdict")
        clean = [r.file for r in verdict.filter("problems = 0").select("file").collect()]  # of the same bounded list
        if clean:
            # a folder per file, named by what a replay of the batch finds again: the query, the file and its time of arrival
            uploads = []
            for f in clean:
                at = arrived[f].replace(microsecond=0)
                base = re.sub(r"[^A-Za-z0-9_.-]", "_", f.rsplit("/", 1)[-1].rsplit(".", 1)[0])
                tag = hashlib.md5(f"{query}/{batch_id}/{f}".encode()).hexdigest()[:16]
                uploads.append((f, f.rsplit("/", 1)[-1], at, at.strftime("%Y-%m-%d"), f"{base}_{at.strftime('%Y%m%d_%H%M%S')}_{tag}"))
            named = spark.createDataFrame(uploads, "__file string, name string, at timestamp_ntz, landed_day string, upload string")
            layout = ["subject", "sub_subject", "landed_day", "upload"]
            subjects = {"subject": F.lit(meta["subject"]), "sub_subject": F.lit(meta["sub_subject"])}
            (staged.filter("__row").join(named.select("__file", "landed_day", "upload"), "__file").drop("__file", "__row").withColumns(subjects)
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).options(**TEXT_OPTIONS)
             .partitionBy(*layout).csv(f"{root}/data"))
            key = F.concat(F.lit(f"data/subject={meta['subject']}/sub_subject={meta['sub_subject']}/landed_day="), "landed_day", F.lit("/upload="), "upload")
            keys = [f"data/subject={meta['subject']}/sub_subject={meta['sub_subject']}/landed_day={u[3]}/upload={u[4]}" for u in uploads]
            sizes = list_landed(spark, root, keys).select("file_key", "file_size_bytes")
            rows = verdict.select(F.col("file").alias("__file"), "rows")
            (named.join(rows, "__file").withColumn("file_key", key).join(sizes, "file_key").select(
                "file_key", landing_key(F.col("name"), F.lit(meta["subject"]), F.lit(meta["sub_subject"]), F.col("at")).alias("object_key"),
                "file_size_bytes", F.col("name").alias("original_filename"), F.col("at").alias("upload_date"),
                F.lit(contract.get("description", "N/A")).alias("schema_used"),
                F.lit(meta["subject"]).alias("subject"), F.lit(meta["sub_subject"]).alias("sub_subject"),
                F.col("rows").cast("string").alias("row_count_text"), F.lit(str(len(fields))).alias("column_count_text"),
                F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss").alias("upload_timestamp"))
             .write.mode("overwrite").parquet(f"{root}/manifest/upload={query}-{batch_id}"))
        rejected = verdict.filter("problems > 0")
        rejected.write.mode("overwrite").parquet(f"{root}/rejected/{own}")
        # dead letters: the lines of rejected files as they came, with their source file
        dead = [r.file for r in rejected.select("file").collect()]  # of the same bounded list
        if dead:
            (spark.read.text(dead).select(scanned_file().alias("source_file"), F.col("value").alias("line"))
             .write.mode("overwrite").parquet(f"{root}/dead_letters/{own}"))

    w = src.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()
