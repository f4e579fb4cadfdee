"""File-level sources: kinds of files, link lists, rule texts, registry files, the field contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .json_claims import contract_paths

REGISTRY_HEADERS = {
    "npi": "NPI", "entity_code": "Entity Type Code", "organisation": "Provider Organization Name (Legal Business Name)", "last_name": "Provider Last Name (Legal Name)",
    "first_name": "Provider First Name", "credential": "Provider Credential Text", "state": "Provider Business Practice Location Address State Name", "enumeration_date": "Provider Enumeration Date",
    "last_update_date": "Last Update Date", "deactivation_date": "NPI Deactivation Date", "reactivation_date": "NPI Reactivation Date", "taxonomy": "Healthcare Provider Taxonomy Code_1",
}
#: Earlier names of fields and places in raw files, with the contract's field that holds the same.
RENAMED = {
    "2300.CLM.claim_amount": "financial.claim_amount",
    "2300.CLM.facility_type": "claim_details.facility_type_code",
    "CLM.claim_amount": "financial.claim_amount",
    "claim.total_charge_amount": "claim_totals.total_charges",
    "2300.HI.diagnosis_code": "diagnosis_codes.*.code",
    "2400.SV1.place_of_service": "service_lines.*.place_of_service",
    "2400.SV1.procedure_code": "service_lines.*.procedure_code",
    "2400.SV1.line_charge": "service_lines.*.charge_amount",
    "2400.DTP.service_date": "service_lines.*.date_of_service",
    "claim.subscriber.date_of_birth": "subscriber.date_of_birth",
    "claim.rendering_provider.npi": "rendering_provider.npi",
    "service_lines.*.line_amount": "service_lines.*.charge_amount",
    "service_lines.*.service_line_number": "service_lines.*.line_number",
    "claim_totals.total_submitted": "claim_totals.total_charges",
    "payer.payer_name": "payer.name",
    "subscriber.subscriber_id": "subscriber.member_id",
    "subscriber.relationship": "subscriber.relationship_code",
    "billing_provider.address.postal_code": "billing_provider.address.zip",
}


def registry_csv(spark: SparkSession, path: str) -> DataFrame:
    """Registry columns found by header name; missing headers are an error that names them, sorted."""
    rows = spark.read.csv(path, header=True, escape='"')
    names = {c.lstrip("\ufeff"): c for c in rows.columns}
    if lost := sorted(set(REGISTRY_HEADERS.values()) - names.keys()):
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return rows.select(*(F.col(f"`{names[h]}`").alias(k) for k, h in REGISTRY_HEADERS.items())).where(F.length("npi") == 10)


def listing(spark: SparkSession, path: str, pattern: str = "*.{x12,edi,txt}") -> DataFrame:
    """Names and contents of a folder's files of the allowed kinds; folders below are left out."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(path).orderBy("path")


def file_kind(name: Column) -> Column:
    """json, x12 or ignored, by the lower-cased extension."""
    extension = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    return F.when(extension == "json", "json").when(extension.isin("x12", "edi"), "x12").otherwise("ignored")


def hrefs(pages: DataFrame, html: str, *keys: str) -> DataFrame:
    """The keys and every link of each page, as it stands in its href."""
    return pages.select(*keys, F.explode(F.regexp_extract_all(html, F.lit(r"""(?i)\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))).alias("link"))


def latest_monthly_file(links: DataFrame, *keys: str) -> DataFrame:
    """The newest monthly file over a column ``link``, for each of the keys: by year, then month, its V2 form before the other."""
    months = "January February March April May June July August September October November December".split()
    pattern = r"NPPES_Data_Dissemination_([A-Z][a-z]+)_(\d{4})(_V2)?\.zip"
    month = F.array_position(F.array(*map(F.lit, months)), F.regexp_extract("link", pattern, 1))
    order = F.struct(F.regexp_extract("link", pattern, 2).alias("y"), month.alias("m"), F.regexp_extract("link", pattern, 3).alias("v"))
    return links.where(F.col("link").rlike(pattern) & (month > 0)).groupBy(*keys).agg(F.max_by("link", order).alias("link"))


def active_rules(rules: DataFrame) -> DataFrame:
    return rules.where(F.col("active") & (F.trim("rule_text") != "")).orderBy("name")


def notices(rows: DataFrame, key: str, item: str, shown: int = 3) -> DataFrame:
    """key, notice: a key's first distinct items, and how many more there are. Only what is shown is gathered."""
    items = rows.select(key, item).where(F.col(item).isNotNull()).distinct()
    counts = items.groupBy(key).agg(F.count("*").alias("_n"))
    ranked = items.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(item))).where(F.col("_at") <= shown)
    first = ranked.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_first"))
    more = F.col("_n") - shown
    said = F.concat(F.array_join("_first", " | "), F.when(more > 0, F.concat(F.lit(" (and "), more.cast("string"), F.lit(" more)"))).otherwise(""))
    return counts.join(first.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key"))).select(key, said.alias("notice"))


def contract_issues(references: DataFrame) -> DataFrame:
    """References (path, ...) that the contract doesn't know, with the field that replaced them (``none``: no such field).

    A reference may name a field, or a section or list that holds fields; a list's index is any number or ``*``.
    """
    spark = references.sparkSession
    fields = contract_paths()
    known = {".".join(path.split(".")[:k]) for path in fields for k in range(1, path.count(".") + 2)}
    table = spark.createDataFrame([(x,) for x in sorted(known)], "plain string")
    hints = spark.createDataFrame(sorted(RENAMED.items()), "plain string, hint string")
    # indexes stand below a list; a raw file's loop begins with a number
    plain = references.withColumn("plain", F.regexp_replace("path", r"\.\d+(?=\.|$)", ".*"))
    lost = plain.join(F.broadcast(table), "plain", "left_anti")
    return lost.join(F.broadcast(hints), "plain", "left").drop("plain").withColumn("hint", F.coalesce("hint", F.lit("none")))


def golden_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """claim_key, rule, side: what was expected and is missing, or is extra."""
    e, a = expected.distinct().withColumn("e", F.lit(1)), actual.distinct().withColumn("a", F.lit(1))
    both = e.join(a, ["claim_key", "rule"], "full_outer").where("e is null or a is null")
    return both.select("claim_key", "rule", F.when(F.col("a").isNull(), "missing").otherwise("extra").alias("side"))
