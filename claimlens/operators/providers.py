"""Provider registry: keyed upsert, dropped marks, and the as-of check of every provider number of a claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_DATES = "No service date found on claim — cannot validate provider NPI"
FULL_FILE_PREFIX = "npidata_pfile_20050523-"


def last_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """old with new merged in by key: every column (or the given ones) is replaced, NULLs included. new has one row a key."""
    columns = columns or [c for c in old.columns if c != key]
    a, b = old.alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    out = [F.coalesce(f"b.{key}", f"a.{key}").alias(key)]
    for c in (c for c in old.columns if c != key):
        mine = F.col(f"a.{c}")
        if c in columns and c in new.columns:
            out.append(F.when(F.col("b._new"), F.col(f"b.{c}")).otherwise(mine).alias(c))
        else:
            out.append((F.when(F.col(f"a.{key}").isNull(), F.col(f"b.{c}")).otherwise(mine) if c in new.columns else mine).alias(c))
    return joined.select(*out)


def mark_dropped(registry: DataFrame, file: DataFrame, file_name: str, today: str) -> DataFrame:
    """After a full file, rows that it lacks and that aren't marked yet are dropped from today on."""
    if not file_name.startswith(FULL_FILE_PREFIX):
        return registry
    there = file.select("npi").distinct().withColumn("_there", F.lit(True))
    joined = registry.join(there, "npi", "left")
    gone = F.col("_there").isNull() & F.col("dropped_on").isNull()
    return joined.withColumn("dropped_on", F.when(gone, F.lit(today).cast("date")).otherwise(F.col("dropped_on"))).drop("_there")


def problem(npi: Column, day: Column) -> Column:
    """Why a provider number isn't valid on a day, over a row joined with the registry (``known`` NULL: not in it)."""
    said = lambda text, since: F.concat(F.lit("Provider NPI "), npi, F.lit(text), since.cast("string"), F.lit(", service rendered on "), day.cast("string"))
    enumerated, off, on, dropped = (F.col(c) for c in ("enumeration_date", "deactivation_date", "reactivation_date", "dropped_on"))
    back = F.coalesce((on > off) & (day >= on), F.lit(False))
    return (
        F.when(F.col("known").isNull(), F.concat(F.lit("NPI "), npi, F.lit(" not found in NPPES registry")))
        .when(day < enumerated, said(" was not issued until ", enumerated))
        .when((day > off) & ~back, said(" was deactivated on ", off))
        .when(day >= dropped, said(" has not been in the NPPES file since ", dropped))
    )


def lookup(claim_npis: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry rows beside claim_npis(npi, ...). The registry is first cut to the numbers in use; the join strategy is left to Spark."""
    used = registry.join(claim_npis.select("npi").distinct(), "npi", "left_semi").withColumn("known", F.lit(True))
    return claim_npis.join(used, "npi", "left")


def findings(claims: DataFrame, npis: DataFrame, days: DataFrame, registry: DataFrame) -> DataFrame:
    """claim_key and the first finding: the first failing number, then its earliest failing day.

    npis: claim_key, npi_pos, npi. days: claim_key, day. A claim without a readable day is
    found even if it has no number.
    """
    pairs = npis.where("npi is not null").join(days.where("day is not null").distinct(), "claim_key")
    judged = lookup(pairs, registry).withColumn("reason", problem(F.col("npi"), F.col("day"))).where("reason is not null")
    first = judged.groupBy("claim_key").agg(F.min_by("reason", F.struct("npi_pos", "day")).alias("reason"))
    dated = days.where("day is not null").select("claim_key").distinct().withColumn("dated", F.lit(True))
    rows = claims.select("claim_key").join(dated, "claim_key", "left").join(first, "claim_key", "left")
    return rows.select("claim_key", F.when(F.col("dated").isNull(), F.lit(NO_DATES)).otherwise(F.col("reason")).alias("reason"))
