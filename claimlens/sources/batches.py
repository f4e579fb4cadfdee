"""Batches and reports as tables of a folder: rows first, a marker last, readers that see marked rows only.

A write is an attempt with a name of its own. It writes its rows, then its batch rows; the
folder of the batch rows is complete when Spark's job commit leaves its ``_SUCCESS`` file
there, and that file alone makes the attempt count. What a lost attempt wrote is never read,
so a job that dies between the tables is run again as it is. Batches that are there already are
left out of a later attempt, so a batch is stored once. One writer at a time is assumed.

    root/claims/attempt=<name>/    accepted claims, never rewritten
    root/batches/attempt=<name>/   one row a batch: the marker
    root/reports/attempt=<name>/   evaluations, beside the claims
    root/evaluations/attempt=<name>/  one row a batch evaluated: the marker of reports
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ingest


def _attempts(spark: SparkSession, root: str, marker: str) -> list[str]:
    """Names of the attempts whose marker is complete."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{marker}")
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    found = (status.getPath() for status in fs.listStatus(base))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(p.getName() for p in found if fs.exists(path(p, "_SUCCESS")))


def read(spark: SparkSession, root: str, table: str, marker: str, schema) -> DataFrame:
    """The rows of a table whose attempts are marked; no rows where there are none."""
    paths = [f"{root}/{table}/{a}" for a in _attempts(spark, root, marker)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def write(spark: SparkSession, root: str, rows: DataFrame, table: str, marks: DataFrame, marker: str) -> str:
    """Write rows, then their marks; gives the attempt's name."""
    attempt = f"attempt={uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/{table}/{attempt}")
    marks.write.parquet(f"{root}/{marker}/{attempt}")
    return attempt


BATCH = "batch_id string, file_count long, refused long, status string, started_at timestamp, completed_at timestamp"


def batches(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "batches", "batches", BATCH)


def claims(spark: SparkSession, root: str, schema) -> DataFrame:
    return read(spark, root, "claims", "batches", schema)


def ingested(spark: SparkSession, root: str, entries: DataFrame, now: str | None = None) -> str | None:
    """Store the accepted entries of each new batch and one row a batch; None where no batch is new.

    entries: as ``ingest.split_duplicates`` gives them, with batch_id. A batch all of whose
    entries are refused is stored as failed, at once complete, without claims.
    """
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    entries = entries.withColumn("batch_id", F.col("batch_id").cast("string"))
    new = ingest.new_only(entries, batches(spark, root), ["batch_id"])
    marks = ingest.batch_rows(new).withColumns({"started_at": at, "completed_at": F.when(F.col("status") == "failed", at)})
    if new.isEmpty():
        return None
    accepted = new.where("kind is null").withColumn("status", F.lit("translated")).withColumn("processed_at", at)
    return write(spark, root, accepted, "claims", marks.select(*(c.split()[0] for c in BATCH.split(", "))), "batches")


REPORT = "claim_key long, batch_id string, status string, overall_risk string, weighted_score int, matched_rules int, undecided_rules int, summary string, results string, error_message string, processed_at timestamp"
EVALUATION = "batch_id string, n_evaluated long, n_not_assessed long, processed_at timestamp"


def evaluated(spark: SparkSession, root: str, reports: DataFrame, now: str | None = None) -> str:
    """Store the reports of claims beside them; a claim without a report is not assessed. The claims stay as they are.

    reports: claim_key, batch_id, and a report's columns as ``rules.report`` gives them, with
    ``error_message`` where there is none.
    """
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    failed = F.col("error_message").isNotNull()
    rows = reports if "error_message" in reports.columns else reports.withColumn("error_message", F.lit(None).cast("string"))
    keep = lambda c: F.when(~failed, F.col(c)).alias(c)
    rows = rows.select(
        "claim_key", F.col("batch_id").cast("string").alias("batch_id"), F.when(failed, "not_assessed").otherwise("evaluated").alias("status"), keep("overall_risk"), keep("weighted_score"), keep("matched_rules"), keep("undecided_rules"), keep("summary"),
        F.when(~failed, F.to_json("results")).alias("results"), "error_message", at.alias("processed_at"),
    )
    attempt = f"attempt={uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/reports/{attempt}")
    # counted from what is stored, so that rules are not evaluated twice
    stored = spark.read.schema(REPORT).parquet(f"{root}/reports/{attempt}")
    marks = stored.groupBy("batch_id").agg(F.count_if(F.col("status") == "evaluated").alias("n_evaluated"), F.count_if(F.col("status") != "evaluated").alias("n_not_assessed"), F.max("processed_at").alias("processed_at"))
    marks.write.parquet(f"{root}/evaluations/{attempt}")
    return attempt


def reports(spark: SparkSession, root: str) -> DataFrame:
    """The latest stored report of each claim."""
    rows = read(spark, root, "reports", "evaluations", REPORT)
    rank = F.row_number().over(Window.partitionBy("claim_key").orderBy(F.desc("processed_at"), F.desc("status")))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a local one where that is unset and the master is local."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
