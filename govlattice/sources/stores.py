"""Stored tables: audit log, checkpoints, manifests, reports, rule files, status files.

Everything is append-only or a dated snapshot; readers pick what they need by
filter, so partition pruning and predicate push-down apply. Appends that carry
the name of their batch count once: rows are written to a folder of their own
and become part of the table by a small commit file, made in one step. What a
failed write leaves is never read, and a batch that is written again changes
nothing.
"""

from __future__ import annotations

import json
import uuid
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT_SCHEMA = (
    "chain_id STRING, seq BIGINT, event_id STRING, event_type STRING, actor STRING, "
    "timestamp STRING, payload_json STRING, prev_hash STRING, hash STRING"
)
STATUS_SCHEMA = (
    "module STRING, status STRING, tests_passed INT, tests_total INT, updated_at STRING"
)


# -- appends that count once -------------------------------------------------------------


def _folder(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def append_once(rows: DataFrame, path: str, batch: str | None = None) -> bool:
    """Add rows to the table at ``path`` unless ``batch`` is already part of it; whether they were added.

    Without a batch name every call adds. Of two writers of one batch at a time
    the first to commit counts.
    """
    spark = rows.sparkSession
    name = quote(batch if batch is not None else uuid.uuid4().hex, safe="")
    fs, commit = _folder(spark, f"{path}/commits/{name}")
    if fs.exists(commit):
        return False
    part = uuid.uuid4().hex
    rows.write.parquet(f"{path}/rows/{part}")
    try:
        out = fs.create(commit, False)  # fails if it is there by now
    except Exception:
        if fs.exists(commit):
            return False
        raise
    out.write(bytearray(part, "ascii"))
    out.close()
    return True


def read_committed(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of committed batches; None when there is none yet."""
    fs, commits = _folder(spark, f"{path}/commits")
    if not fs.exists(commits):
        return None
    # One short line for each append. A commit whose writer died before the name was in it is empty, and no part.
    parts = [r["value"] for r in spark.read.text(f"{path}/commits").distinct().collect() if r["value"]]
    if not parts:
        return None
    return spark.read.option("mergeSchema", "true").parquet(*[f"{path}/rows/{p}" for p in sorted(parts)])


# -- audit log ------------------------------------------------------------------------


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Audit rows from JSON lines in write order of each chain (column ``seq``).

    Lines that do not parse become rows without values; verification counts
    them as broken instead of the read failing.
    """
    return spark.read.schema(AUDIT_SCHEMA + ", _broken STRING").json(
        path, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken"
    )


def stream_audit_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(AUDIT_SCHEMA).json(path)


def append_audit_log(sealed: DataFrame, path: str) -> None:
    columns = [c.split()[0] for c in AUDIT_SCHEMA.split(", ")]
    sealed.select(*[F.col(c).cast("string") if c == "chain_id" else c for c in columns]).write.mode(
        "append"
    ).json(path)


# -- checkpoints -----------------------------------------------------------------------


def append_checkpoints(checkpoints: DataFrame, path: str, batch: str | None = None) -> bool:
    """Store the checkpoints of one run (see :func:`append_once`)."""
    return append_once(checkpoints, path, batch)


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame | None:
    return read_committed(spark, path)


def covered_ranges(checkpoints: DataFrame, chain: str) -> DataFrame:
    """How far each chain is covered, for the next run of the checkpoint job."""
    return checkpoints.groupBy(chain).agg(F.max("range_end").alias("range_end"))


# -- manifests ---------------------------------------------------------------------------


def manifest_of(corpus: DataFrame, name: str = "source", text: str = "text") -> DataFrame:
    """File name and content hash of a corpus."""
    extra = [c for c in ("article", "tema") if c in corpus.columns]
    return corpus.select(
        F.col(name).alias("filename"), F.sha2(F.col(text), 256).alias("content_hash"), *extra
    )


def save_manifest(manifest: DataFrame, path: str, taken_at: str) -> None:
    """Store a snapshot under its date; earlier snapshots stay."""
    manifest.write.mode("overwrite").parquet(f"{path}/taken_at={taken_at}")


def load_manifest(spark: SparkSession, path: str, taken_at: str | None = None) -> DataFrame | None:
    """A snapshot, the newest by default; None when there is none yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    # Text, so that a date-like snapshot name is not read as a date.
    snapshots = spark.read.parquet(path).withColumn("taken_at", F.col("taken_at").cast("string"))
    if taken_at is None:
        taken_at = snapshots.agg(F.max("taken_at")).collect()[0][0]
    return snapshots.filter(F.col("taken_at") == taken_at).drop("taken_at")


def diff_manifests(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files added, removed, modified or unchanged between two snapshots."""
    o = old.select("filename", F.col("content_hash").alias("_old"))
    n = new.select("filename", F.col("content_hash").alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(F.col("_old") != F.col("_new"), "modified")
        .otherwise("unchanged")
    )
    return o.join(n, "filename", "full_outer").select("filename", change.alias("change"))


def summarize_diff(diff: DataFrame) -> DataFrame:
    return diff.agg(
        *[
            F.count_if(F.col("change") == c).alias(c)
            for c in ("added", "removed", "modified", "unchanged")
        ]
    )


# -- reports -------------------------------------------------------------------------------


def append_reports(reports: DataFrame, path: str, report_id: Column, batch: str | None = None) -> bool:
    """Store reports under their ids (see :func:`append_once`)."""
    return append_once(reports.withColumn("report_id", report_id), path, batch)


def read_reports(spark: SparkSession, path: str) -> DataFrame | None:
    return read_committed(spark, path)


def report_summaries(reports: DataFrame) -> DataFrame:
    """Id, project, time and risk of stored reports."""
    return reports.select("report_id", "project_name", "generated_at", "risk_level")


# -- small files ----------------------------------------------------------------------------


def load_rules(path: str):
    """A rule file (JSON, or YAML where a YAML reader is installed); empty file = no rules."""
    text = Path(path).read_text(encoding="utf-8")
    if not text.strip():
        return []
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as exc:
        raise ValueError("reading YAML rules needs a YAML package; use JSON instead") from exc
    return yaml.safe_load(text) or []


def load_statuses(spark: SparkSession, path: str, modules: list[str]) -> DataFrame:
    """One row per module with its status file; missing or broken files give nulls."""
    listed = spark.createDataFrame([(m,) for m in modules], "module STRING")
    files = spark.read.schema(STATUS_SCHEMA.replace("module STRING, ", "")).json(
        path, multiLine=True, mode="PERMISSIVE"
    )
    named = files.withColumn(
        "module", F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1)
    )
    return listed.join(named, "module", "left")
