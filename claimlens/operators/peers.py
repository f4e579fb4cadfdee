"""Providers beside their peers: features of each, and where each stands within its group, exactly or by sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The highest levels of office visits, and the features.
HIGH_VISITS = ("99205", "99215")
FEATURES = ("patients", "services_per_patient", "paid_per_service", "monthly_jump", "high_visit_share", "codes", "top_code_share", "tenure_days")


def features(services: DataFrame, providers: DataFrame) -> DataFrame:
    """providers with FEATURES as doubles, for those who have services.

    services: provider, claim_key, patient, code, month (a running number), cents. providers: provider, tenure_days
    and what else is to be kept. Nulls are no patient, code or month of their own. Shares are of all
    services. The monthly jump is the largest rise in claims from one month to the next, where a month without
    claims has none; it is unknown with claims in one month only. Every count is first made per provider and
    patient, code or month, so that a provider with a great many services is no one task's work.
    """
    patients = services.where("patient is not null").groupBy("provider", "patient").agg(F.lit(1)).groupBy("provider").agg(F.count("*").alias("patients"))
    by_code = services.groupBy("provider", "code").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    codes = by_code.groupBy("provider").agg(
        F.sum("n").alias("services"), F.sum("cents").alias("cents"), F.count("code").alias("codes"),
        F.max(F.when(F.col("code").isNotNull(), F.col("n"))).alias("top"), F.sum(F.when(F.col("code").isin(*HIGH_VISITS), F.col("n")).otherwise(0)).alias("high"))
    claims = services.where("month is not null and claim_key is not null").groupBy("provider", "month", "claim_key").agg(F.lit(1)).groupBy("provider", "month").agg(F.count("*").alias("n"))
    order = Window.partitionBy("provider").orderBy("month")  # a row a month
    before = F.when(F.lag("month").over(order) == F.col("month") - 1, F.lag("n").over(order)).when(F.lag("month").over(order).isNotNull(), 0)
    jumps = claims.select("provider", (F.col("n") - before).alias("rise")).groupBy("provider").agg(F.max("rise").alias("monthly_jump"))
    rows = providers.join(codes, "provider").join(patients, "provider", "left").join(jumps, "provider", "left")
    number = lambda c: F.col(c).cast("double")
    made = {
        "patients": F.coalesce(number("patients"), F.lit(0.0)), "services_per_patient": number("services") / number("patients"), "paid_per_service": number("cents") / number("services") / 100,
        "monthly_jump": number("monthly_jump"), "high_visit_share": number("high") / number("services"), "codes": number("codes"), "top_code_share": number("top") / number("services"), "tenure_days": number("tenure_days"),
    }
    return rows.select(*(c for c in providers.columns if c != "tenure_days"), *(made[c].alias(c) for c in FEATURES))


def tall(rows: DataFrame, group: list[str], names: tuple[str, ...] = FEATURES) -> DataFrame:
    """One row per provider and feature that has a value: provider, the group's columns, feature, value."""
    parts = F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names))
    return rows.select("provider", *group, F.explode(parts).alias("f")).select("provider", *group, "f.feature", "f.value").where("value is not null")


def _keyed(values: DataFrame, group: list[str]) -> DataFrame:
    """With the peer group as one key; nulls are equal within it."""
    return values.withColumn("_key", F.struct(*group, "feature"))


def percentiles(values: DataFrame, group: list[str], parts: int = 128) -> DataFrame:
    """values (see ``tall``) with peers, percentile and peer_median of their group and feature, all exact.

    The percentile is the share of the other peers with a smaller value (0 without others). No group
    is ordered in one task: equal values are counted first, quantile sketches cut each group into about as many
    ranges as ``parts``, and each range is ordered on its own, above the counts of the ranges below it.
    """
    keyed = _keyed(values, group)
    counted = keyed.groupBy("_key", "value").agg(F.count("*").alias("_n"))
    cuts = F.percentile_approx("value", [k / parts for k in range(1, parts)], 100 * parts)
    groups = counted.groupBy("_key").agg(cuts.alias("_cuts"), F.sum("_n").alias("peers"))
    placed = counted.join(groups, "_key").select("_key", "value", "_n", "peers", F.size(F.filter("_cuts", lambda c: c < F.col("value"))).alias("_part"))
    totals = placed.groupBy("_key", "_part").agg(F.sum("_n").alias("_in"))
    up_to_last = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    lower = F.sum("_in").over(up_to_last(Window.partitionBy("_key").orderBy("_part")))  # a row a range
    totals = totals.select("_key", "_part", F.coalesce(lower, F.lit(0)).alias("_lower"))
    inside = F.sum("_n").over(up_to_last(Window.partitionBy("_key", "_part").orderBy("value")))
    ranked = placed.join(totals, ["_key", "_part"]).withColumn("_below", F.col("_lower") + F.coalesce(inside, F.lit(0)))
    reaches = lambda place: F.min(F.when(F.col("_below") + F.col("_n") >= place, F.col("value")))
    middle = ranked.groupBy("_key").agg(reaches(F.floor((F.col("peers") + 1) / 2)).alias("_a"), reaches(F.floor(F.col("peers") / 2) + 1).alias("_b"))
    told = ranked.join(middle, "_key").select(
        "_key", "value", "peers", F.when(F.col("peers") > 1, F.col("_below") / (F.col("peers") - 1)).otherwise(0.0).alias("percentile"),
        (F.col("_a") + (F.col("_b") - F.col("_a")) * 0.5).alias("peer_median"))
    return keyed.join(told, ["_key", "value"]).select(*values.columns, "peers", "percentile", "peer_median")


def sketched(values: DataFrame, group: list[str], cuts: int = 100, accuracy: int = 10_000) -> DataFrame:
    """values with an approximate percentile, from one mergeable quantile sketch per group and feature.

    It is off by at most 1 / cuts + 1 / accuracy, and by 1 / (peers - 1) for counting the provider itself.
    """
    keyed = _keyed(values, group)
    sketch = F.percentile_approx("value", [k / cuts for k in range(1, cuts)], accuracy)
    bounds = keyed.groupBy("_key").agg(sketch.alias("_cuts"))
    share = F.size(F.filter("_cuts", lambda c: c < F.col("value"))) / cuts
    return keyed.join(bounds, "_key").select(*values.columns, share.alias("percentile"))
