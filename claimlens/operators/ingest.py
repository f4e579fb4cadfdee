"""Submissions against what was submitted before: file and claim duplicates, ledgers, batches."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

LIMIT = 15_000
#: Parts of a claim that change when it is sent again.
ENVELOPE = ("interchange", "functional_group", "submitter", "receiver")


def previous_files(submitted: DataFrame, batches: DataFrame) -> DataFrame:
    """sha256 and batch_id of files in batches that didn't fail."""
    return submitted.join(batches.where("status <> 'failed'").select("batch_id"), "batch_id").groupBy("sha256").agg(F.min("batch_id").alias("previous_batch"))


def previous_claims(stored: DataFrame, batches: DataFrame) -> DataFrame:
    """The earliest stored copy of each fingerprint in a batch that didn't fail."""
    live = stored.join(batches.where("status <> 'failed'").select("batch_id"), "batch_id")
    return live.groupBy("fingerprint").agg(F.min_by("filename", F.struct("inserted_at", "id")).alias("previous_filename"), F.min_by("batch_id", F.struct("inserted_at", "id")).alias("previous_claim_batch"))


def split_duplicates(entries: DataFrame, files: DataFrame, claims: DataFrame) -> DataFrame:
    """entries(entry_pos, sha256, fingerprint) with ``kind``: NULL accepted, else file, claim or submission.

    Tiers in that order; a claim refused for its file or an earlier copy is not seen by
    later entries. A refused file is reported on its first entry only (``reported``).
    """
    rows = entries.join(files, "sha256", "left").join(claims, "fingerprint", "left")
    early = F.when(F.col("previous_batch").isNotNull(), "file").when(F.col("previous_claim_batch").isNotNull(), "claim")
    rows = rows.withColumn("early", early)
    seen = F.row_number().over(Window.partitionBy("fingerprint", F.col("early").isNull()).orderBy("entry_pos"))
    rows = rows.withColumn("kind", F.when(F.col("early").isNotNull(), F.col("early")).when(seen > 1, "submission"))
    in_file = F.row_number().over(Window.partitionBy("sha256", F.coalesce("kind", F.lit(""))).orderBy("entry_pos"))
    return rows.withColumn("reported", F.when(F.col("kind") == "file", in_file == 1).otherwise(F.col("kind").isNotNull())).drop("early")


def batch_rows(entries: DataFrame) -> DataFrame:
    """One row per batch of split entries: accepted claims, refusals, and its status."""
    out = entries.groupBy("batch_id").agg(F.count_if(F.col("kind").isNull()).alias("file_count"), F.count_if(F.col("reported")).alias("refused"))
    return out.withColumn("status", F.when(F.col("file_count") == 0, "failed").otherwise("pending"))


def ledger_upsert(ledger: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The ledger with incoming rows merged: the last by ``order`` of each key stays."""
    rows = ledger.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order)))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_new")


def new_only(incoming: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose keys the ledger doesn't have."""
    return incoming.join(ledger.select(*keys).distinct(), keys, "left_anti")


def oversize(claims: DataFrame, limit: int = LIMIT) -> DataFrame:
    """batch_id, n, status: batches over the limit fail and nothing of them is evaluated."""
    return claims.groupBy("batch_id").agg(F.count("*").alias("n")).withColumn("status", F.when(F.col("n") > limit, "failed").otherwise("processing"))


def within_days(rows: DataFrame, key: str, same: list[str], day: str, days: int) -> DataFrame:
    """Pairs of rows (first, second, apart) that agree in ``same`` and lie at most so many days apart, each pair once, by day then key.

    Days are cut into buckets of that length; a row meets the rows of its own bucket and of the
    next one, so the join is by equality and no bucket is compared with all others.
    """
    own = rows.where(F.col(day).isNotNull()).select(F.col(key).alias("first"), F.col(day).alias("_from"), *same, F.floor(F.unix_date(day) / max(1, days)).alias("_bucket"))
    other = own.select(F.col("first").alias("second"), F.col("_from").alias("_to"), *same, F.explode(F.array(F.col("_bucket"), F.col("_bucket") - 1)).alias("_bucket"))
    apart = F.datediff("_to", "_from")
    pairs = own.join(other, [*same, "_bucket"]).withColumn("apart", apart)
    return pairs.where(F.col("apart").between(0, days) & ((F.col("apart") > 0) | (F.col("first") < F.col("second")))).select("first", "second", *same, "apart")


def other_amounts(rows: DataFrame, key: str, same: list[str], amount: str) -> DataFrame:
    """Groups that agree in ``same`` but not in the amount: how many rows and amounts, and the first row."""
    groups = rows.groupBy(*same).agg(F.count("*").alias("n_rows"), F.count_distinct(amount).alias("n_amounts"), F.min(key).alias("first"))
    return groups.where("n_amounts > 1")


def _by_name(column: Column, kind: DataType) -> Column:
    """The same value with the fields of all structs in the order of their names."""
    if isinstance(kind, StructType):
        return F.struct(*(_by_name(column[f.name], f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType | ArrayType):
        return F.transform(column, lambda x: _by_name(x, kind.elementType))
    return column


def with_fingerprint(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Claims with ``fingerprint``: SHA-256 of a claim as JSON, but for its keys here and its envelope, whatever the order of fields."""
    fields = [f for f in sorted(claims.schema, key=lambda f: f.name) if f.name not in {*keys, *ENVELOPE}]
    whole = F.struct(*(_by_name(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields))
    return claims.withColumn("fingerprint", F.sha2(F.to_json(whole), 256))


def _islands(events: DataFrame, keys: list[str], ts: str, order: str, seconds: int) -> DataFrame:
    """Events with a column ``_island``: a new one begins where nothing of the key came in the seconds before."""
    own = Window.partitionBy(*keys).orderBy(ts, order)
    gap = F.col(ts) - F.lag(ts).over(own) > F.make_dt_interval(secs=F.lit(seconds))
    return events.withColumn("_new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("_island", F.sum("_new").over(own)).drop("_new")


def _folded(events: DataFrame, keys: list[str], ts: str, order: str, seconds: int, verdict: Callable[[], Callable[[int], bool]]) -> DataFrame:
    """Keys, ts, order and ``allowed`` of every event, judged one after the other within its key.

    After a pause of so many seconds nothing that came before counts, so a key's events are cut
    into islands at its pauses; islands are dealt to tasks and sorted there by Spark. A task
    streams its rows: it holds one batch and what ``verdict`` keeps of the island at hand.
    """
    rows = _islands(events.select(*keys, F.col(ts).alias("_ts"), F.col(order).alias("_order")), keys, "_ts", "_order", seconds)
    first = F.coalesce(F.col("_island") != F.lag("_island").over(Window.partitionBy(*keys).orderBy("_ts", "_order")), F.lit(True))
    rows = rows.withColumns({"_first": first, "_at": F.unix_micros(F.col("_ts").cast("timestamp"))})
    spread = rows.repartition(*keys, "_island").sortWithinPartitions(*keys, "_island", "_ts", "_order")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = None
        for batch in batches:
            out = []
            for begins, at in zip(batch.column("_first").to_pylist(), batch.column("_at").to_pylist(), strict=True):
                if begins or judge is None:
                    judge = verdict()
                out.append(judge(at))
            kept = [n for n in batch.schema.names if n not in ("_first", "_at", "_island")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(out, pa.bool_())], names=[*kept, "allowed"])

    schema = StructType([f for f in spread.schema if f.name not in ("_first", "_at", "_island")]).add("allowed", "boolean")
    return spread.mapInArrow(task, schema).withColumnsRenamed({"_ts": ts, "_order": order})


def at_most_once(events: DataFrame, keys: list[str], ts: str, order: str, seconds: int = 60) -> DataFrame:
    """Events that are accepted: of each key none within so many seconds of the last one accepted.

    Null keys are one key; events without a time are never accepted.
    """
    span = seconds * 1_000_000

    def verdict() -> Callable[[int], bool]:
        last = None

        def judge(at: int) -> bool:
            nonlocal last
            if last is not None and at - last <= span:
                return False
            last = at
            return True

        return judge

    return _folded(events.where(F.col(ts).isNotNull()), keys, ts, order, seconds, verdict).where("allowed").drop("allowed")


def rate_limited(events: DataFrame, keys: list[str], ts: str, order: str, most: int = 1000, seconds: int = 60) -> DataFrame:
    """Every event with ``allowed``: whether fewer than ``most`` events of its key were allowed in the seconds up to it. Refused ones don't count.

    Null keys are one key; events without a time are left out.
    """
    span = seconds * 1_000_000

    def verdict() -> Callable[[int], bool]:
        recent: deque[int] = deque()  # of those allowed, at most ``most`` count

        def judge(at: int) -> bool:
            while recent and recent[0] <= at - span:
                recent.popleft()
            if len(recent) >= most:
                return False
            recent.append(at)
            return True

        return judge

    return _folded(events.where(F.col(ts).isNotNull()), keys, ts, order, seconds, verdict)
