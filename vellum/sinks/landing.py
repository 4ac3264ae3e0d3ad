"""Gated landing job.

The input is read once: it is written to a hidden staging folder while an
``Observation`` counts rows and problems on the same pass; only a clean
upload is moved into the data layout and gets a manifest row.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vellum.sinks.csv_export import TEXT_OPTIONS

from vellum.functions.keys import landing_key, ntz_literal
from vellum.operators.contract import contract_fields, problem_metrics


@dataclass
class LandResult:
    ok: bool
    message: str
    problems: int
    rows: int = 0
    columns: int = 0
    data_path: str | None = None
    object_key: str | None = None


def land(df: DataFrame, contract: dict, root: str, meta: dict, landed_at: _dt.datetime,
         manifest_path: str | None = None) -> LandResult:
    """Write ``df`` under ``root`` when it passes ``contract``; one pass.

    ``meta`` holds ``subject``, ``sub_subject`` and ``original_filename``.
    The data is written once to a hidden staging folder next to its target
    while the problem counts are observed on the same pass; a clean upload is
    then renamed into ``root/data/subject=/sub_subject=/landed_day=/upload=<name>_<time>/``
    and gets one manifest row under ``root/manifest``, whose ``file_key`` is
    that folder below ``root`` and whose ``file_size_bytes`` is its size.
    With any problem nothing appears under ``data`` or ``manifest`` and the
    staging folder goes.  Each upload owns its folders, so re-running it
    replaces its own output: the old folder is set aside until the new one is
    in place, and comes back if that fails.
    """
    spark = df.sparkSession
    if not contract_fields(contract):
        return LandResult(False, "1 problem(s); nothing written", 1)
    day = landed_at.strftime("%Y-%m-%d")
    base_name = meta["original_filename"].rsplit(".", 1)[0]
    upload = f"{base_name}_{landed_at.strftime('%Y%m%d_%H%M%S')}"
    root = root.rstrip("/")
    data_root = root + "/data"
    target = (f"{data_root}/subject={meta['subject']}/sub_subject={meta['sub_subject']}"
              f"/landed_day={day}/upload={upload}")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # '_' keeps the staging folder invisible to readers of root/data
    staging = f"{root}/_staging/{upload}-{uuid.uuid4().hex[:12]}"
    cols, total = problem_metrics(df, contract)
    obs = Observation("landing")
    df.observe(obs, *cols).write.mode("overwrite").option("header", True).options(**TEXT_OPTIONS).csv(staging)
    seen = obs.get
    problems = total(seen)
    if problems:
        fs.delete(path(staging), True)
        return LandResult(False, f"{problems} problem(s); nothing written", problems)
    tgt, old = path(target), path(staging + "-replaced")
    fs.mkdirs(tgt.getParent())
    replaced = fs.exists(tgt)
    if replaced and not fs.rename(tgt, old):
        raise IOError(f"could not set {target} aside")
    if not fs.rename(path(staging), tgt):
        if replaced:
            fs.rename(old, tgt)
        raise IOError(f"could not move {staging} to {target}")
    if replaced:
        fs.delete(old, True)
    size = int(fs.getContentSummary(tgt).getLength())
    rows = int(seen["rows"])
    ts = ntz_literal(landed_at)
    manifest_row = spark.range(1).select(
        F.lit(target[len(root) + 1:]).alias("file_key"),
        landing_key(F.lit(meta["original_filename"]), F.lit(meta["subject"]),
                    F.lit(meta["sub_subject"]), ts).alias("object_key"),
        F.lit(size).cast("long").alias("file_size_bytes"),
        F.lit(meta["original_filename"]).alias("original_filename"),
        ts.alias("upload_date"),
        F.lit(contract.get("description", "N/A")).alias("schema_used"),
        F.lit(meta["subject"]).alias("subject"),
        F.lit(meta["sub_subject"]).alias("sub_subject"),
        F.lit(str(rows)).alias("row_count_text"),
        F.lit(str(len(df.columns))).alias("column_count_text"),
        F.lit(landed_at.isoformat()).alias("upload_timestamp"))
    key = manifest_row.first()["object_key"]
    # one folder per data folder: no two uploads of other subjects, names or seconds share it
    owner = hashlib.md5(target[len(root):].encode()).hexdigest()
    manifest_row.write.mode("overwrite").parquet(f"{manifest_path or root + '/manifest'}/upload={owner}")
    return LandResult(True, f"landed {rows} rows", 0, rows, len(df.columns), target, key)
