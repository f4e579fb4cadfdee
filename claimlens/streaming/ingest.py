"""Incremental ingest as a stream of files: each file once, judged against a ledger, recorded last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import new_only

LEDGER = "source string, filename string, sha256 string"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).option("pathGlobFilter", "*.parquet").parquet(path)


def ingest(spark: SparkSession, source: str, folder: str, ledger_path: str, checkpoint: str, take: Callable[[DataFrame], None], pattern: str = "*.{x12,edi,txt}") -> StreamingQuery:
    """Hand files not yet in the ledger to ``take`` and record them after it succeeded. One run takes what is there, then ends.

    A name with new bytes is a new file; the same bytes under the same name are not taken
    again, even by a stream with a new checkpoint.
    """
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger_path)
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(folder)

    def batch(rows: DataFrame, _: int) -> None:
        named = rows.select(F.lit(source).alias("source"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("sha256"), F.decode("content", "ISO-8859-1").alias("text"))
        fresh = new_only(named.dropDuplicates(["filename", "sha256"]), ledger(spark, ledger_path), ["source", "filename", "sha256"])
        fresh = fresh.persist()
        take(fresh)
        fresh.select("source", "filename", "sha256").write.mode("append").parquet(ledger_path)
        fresh.unpersist()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def evaluation_requests(requests: DataFrame) -> DataFrame:
    """requests(batch_id, ts): one evaluation of a batch within 60 seconds."""
    return requests.withWatermark("ts", "60 seconds").dropDuplicatesWithinWatermark(["batch_id"])
