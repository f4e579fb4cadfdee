"""Decision policy over rule results and model scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Thresholds, queues and reason codes.
LOW, HIGH, SIU = 0.35, 0.80, 0.93


def band(score: Column) -> Column:
    return F.when(score >= SIU, "ML:risk_ge_siu").when(score >= HIGH, "ML:risk_ge_high").when(score >= LOW, "ML:risk_ge_low").otherwise("ML:risk_lt_0_35")


def decide(rows: DataFrame, review: bool = True) -> DataFrame:
    """status, queue and reason_codes from rejected, concern (booleans), dsl_reasons (array), ml_status, risk_score."""
    score = F.coalesce("risk_score", F.lit(0.0))
    bad = F.coalesce(F.col("ml_status"), F.lit("error")) != "ok"
    concern, none = F.col("concern"), F.array().cast("array<string>")
    dsl = F.col("dsl_reasons")
    with_band = F.concat(dsl, F.array(band(score)))
    status = F.when(F.col("rejected"), "REJECT").when(bad, F.when(concern, "REQUIRE_REVIEW").otherwise("APPROVE"))
    queue = F.when(F.col("rejected"), "denied").when(bad, F.when(concern, "policy_default").otherwise("none"))
    reasons = F.when(F.col("rejected"), F.concat(dsl, F.array(F.lit("DSL:reject")))).when(bad, F.concat(F.when(concern, dsl).otherwise(none), F.array(F.lit("ML:error_fallback"))))
    if not review:
        status, queue, reasons = status.when(~concern, "APPROVE"), queue.when(~concern, "none"), reasons.when(~concern, none)
    status = status.when(score >= LOW, "REQUIRE_REVIEW").when(concern, "REQUIRE_REVIEW").otherwise("APPROVE")
    queue = queue.when(score >= SIU, "siu_escalation").when(score >= HIGH, "fraud_priority").when((score >= LOW) | concern, "manual_review").otherwise("none")
    reasons = reasons.when(score >= LOW, with_band).when(concern, dsl).otherwise(F.array(band(score)))
    return rows.withColumns({"status": status, "queue": queue, "reason_codes": reasons})


def from_results(rows: DataFrame) -> DataFrame:
    """rejected, concern and dsl_reasons of a report's columns ``results`` and, where it has them, ``actions``."""
    hit = F.filter("results", lambda r: r["matched"])
    actions = F.col("actions") if "actions" in rows.columns else F.flatten(F.transform(hit, lambda r: r["actions"]))
    tags = F.transform(actions, lambda a: a["tag"])
    return rows.withColumns({"rejected": F.array_contains(tags, "REJECT"), "concern": F.exists(tags, lambda t: t != "APPROVE"), "dsl_reasons": F.transform(hit, lambda r: F.concat(F.lit("DSL:"), r["rule_name"]))})


def normalised_scores(responses: DataFrame) -> DataFrame:
    """Model responses (claim_id, body as JSON text) to status, risk_score and model_id; what isn't version 1.0 is an error."""
    get = lambda path: F.get_json_object("body", f"$.{path}")
    score = F.coalesce(get("risk_score").try_cast("double"), get("ml_probability").try_cast("double"))
    ok = (get("contract_version") == "1.0") & score.isNotNull()
    return responses.select("claim_id", F.when(ok, F.coalesce(get("status"), F.lit("ok"))).otherwise("error").alias("ml_status"), F.when(ok, score).alias("risk_score"), F.coalesce(get("model_id"), F.lit("unknown")).alias("model_id"))


#: Sections that name a person, sections of providers, and what names a provider in them.
PERSON = ("subscriber", "patient", "member", "insured", "guarantor")
PROVIDER = ("provider", "billing_provider", "rendering_provider", "referring_provider", "attending_provider")
NAMING = ("name", "address", "city", "state", "zip", "phone")
#: Fixed value: the score of a claim without one.
NO_SCORE = 0.42


def scorer_view(claims: DataFrame) -> DataFrame:
    """What a scorer may see: no section of a person; providers without their names and addresses."""
    kept = []
    for field in claims.schema:
        if field.name in PERSON:
            continue
        column = F.col(f"`{field.name}`")
        if field.name in PROVIDER and isinstance(field.dataType, StructType):
            column = F.struct(*(column[c].alias(c) for c in field.dataType.names if c not in NAMING))
        kept.append(column.alias(field.name))
    return claims.select(*kept)


def with_scores(claims: DataFrame, scores: DataFrame) -> DataFrame:
    """Each claim with its score (claim_key, risk_score; one row a claim), or the score that stands for none."""
    return claims.join(scores.select("claim_key", F.col("risk_score").alias("_score")), "claim_key", "left").withColumn("score", F.coalesce("_score", F.lit(NO_SCORE))).drop("_score")


def unbundled(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """claim_key, one, other: pairs of procedures (one, other) that stand together on a claim, each once.

    Lines first lose all procedures that no pair names, by a join on the procedure; what is left
    is joined by claim, so no claim's lines are all paired.
    """
    said = lines.select("claim_key", "procedure_code").where(F.col("procedure_code").isNotNull()).distinct()
    first = said.join(pairs.select(F.col("one").alias("procedure_code"), "other").distinct(), "procedure_code").select("claim_key", F.col("procedure_code").alias("one"), "other")
    return first.join(said.select("claim_key", F.col("procedure_code").alias("other")), ["claim_key", "other"]).select("claim_key", "one", "other")


def age_mismatches(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """Lines whose patient's ``age`` lies outside ``low`` to ``high`` of their procedure's edit; without age or edit none. A null bound is open."""
    joined = lines.join(edits, "procedure_code")
    return joined.where((F.col("age") < F.col("low")) | (F.col("age") > F.col("high")))
