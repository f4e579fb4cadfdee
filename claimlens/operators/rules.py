"""The rule library: conditions over claims and what follows from them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import predicates as p

ACTION = "array<struct<tag:string,message:string,score:int>>"


@dataclass(frozen=True)
class Rule:
    name: str
    description: str
    condition: Callable[[Claim], p.Pred]
    actions: tuple[tuple[str, str, int | None], ...]


class Claim:
    """Fields and collections of a claim row, by path."""

    def __init__(self, row: Callable[[str], Column] = F.col, as_of: str | None = None, limits: dict[str, float] | None = None, sections: frozenset[str] = frozenset(), facts: p.Facts | None = None):
        """as_of: the day that counts as today (default: the session's own); limits: other amounts for rules, by name.

        sections: which of ``procedure_codes`` and ``procedure_code`` the table of claims has.
        facts: notes what is read, to be made once below the rules (``compiled``).
        """
        self.row, self.limits, self.sections, self.facts, self.day = row, limits or {}, sections, facts, as_of
        self.as_of = F.current_date() if as_of is None else F.lit(as_of).cast("date")

    @cached_property
    def lines(self) -> p.Items:
        return self.items("service_lines")

    @cached_property
    def codes(self) -> p.Items:
        return self.items("diagnosis_codes")

    def noting(self) -> Claim:
        """The same claim, with facts of its own."""
        return Claim(self.row, self.day, self.limits, self.sections, p.Facts())

    def items(self, path: str) -> p.Items:
        value = self.row(path)
        return p.Items(path, self.facts.collection(path, value) if self.facts else value, self.facts)

    def __call__(self, path: str) -> p.Field:
        head, *rest = path.split(".")
        value = self.row(head)
        for part in rest:
            value = value[part]
        return p.Field(path, value, parsed=(lambda kind: self.facts.field(path, value, kind)) if self.facts else None)

    def limit(self, rule: str, own: float) -> float:
        return self.limits.get(rule, own)

    @property
    def amount(self) -> p.Field:
        return self("financial.claim_amount")

    def has_procedure(self, code: str) -> p.Pred:
        """Whether a procedure is on the claim: in its procedure codes, its lines, or as the claim's own."""
        places = [p.codes_of(self.items("procedure_codes"), "code")] if "procedure_codes" in self.sections else []
        places.append(p.codes_of(self.lines, "procedure_code"))
        if "procedure_code" in self.sections:
            places.append(F.when(self.row("procedure_code").isNotNull(), F.array(self.row("procedure_code"))))
        return p.has_any(code, "no procedure_codes, service_lines or procedure_code on the claim", *places)

    def has_diagnosis(self, code: str) -> p.Pred:
        return p.has_code(self.codes, "code", code, "diagnosis_codes missing or empty")

    def any_line(self, body: Callable[[Callable[[str], p.Field]], p.Pred]) -> p.Pred:
        return p.exists(self.lines, lambda x: body(lambda name: self.lines.field(x, name)))

    def every_line(self, body: Callable[[Callable[[str], p.Field]], p.Pred]) -> p.Pred:
        return p.for_all(self.lines, lambda x: body(lambda name: self.lines.field(x, name)))


def _reject(text: str) -> tuple:
    return (("REJECT", text, None),)


def _review(text: str) -> tuple:
    return (("REQUIRE_REVIEW", text, None),)


def _fraud(text: str) -> tuple:
    return (("FLAG_FRAUD", text, None),)


def _any(*parts: p.Pred) -> p.Pred:
    out = parts[0]
    for x in parts[1:]:
        out = out | x
    return out


#: Names, thresholds, codes and texts of the rules, in the order of the catalogue.
RULES: dict[str, Rule] = {
    "R1": Rule("ImpossibleDates", "Rejects claims where any service line is dated before 1900 (future dates are FutureServiceDate)", lambda c: c.any_line(lambda f: p.date_before(f("date_of_service"), "1900-01-01")), _reject("Impossible service date detected")),
    "R2": Rule("MissingRequiredFields", "Ensures all mandatory fields are present in the claim payload", lambda c: _any(*(p.is_null(c(x)) for x in ("claim_id", "provider.npi", "patient.date_of_birth", "financial.claim_amount"))), _reject("Missing required claim field")),
    "R3": Rule("InvalidProviderNPI", "Validates that the billing provider NPI passes Luhn-10 checksum", lambda c: ~p.is_null(c("provider.npi")) & ~p.npi_valid(c("provider.npi")), _reject("Provider NPI fails Luhn-10 validation")),
    "R4": Rule("FutureServiceDate", "Rejects claims where any service line's date of service has not yet occurred", lambda c: c.any_line(lambda f: p.future_date(f("date_of_service"), c.as_of)), _reject("Service date is in the future")),
    "R5": Rule("InvalidNPIFormat", "Rejects claims where the billing provider NPI is not exactly 10 digits", lambda c: ~p.is_null(c("provider.npi")) & ~p.npi_format(c("provider.npi")), _reject("Provider NPI is not a valid 10-digit number")),
    "R6": Rule("MissingDiagnosisCodes", "Rejects claims that contain no diagnosis codes", lambda c: p.count(c.codes, lambda a, b: a == b, 0), _reject("No diagnosis codes present on claim")),
    "R7": Rule("ExcessiveTotalCharges", "Flags claims with total charges exceeding $750,000 as potential fraud", lambda c: p.greater(c("claim_totals.total_charges"), c.limit("ExcessiveTotalCharges", 750000)), _fraud("Total charges exceed $750K threshold")),
    "R8": Rule("PatientAgeOutOfRange", "Rejects claims where the patient age is negative or exceeds 130 years", lambda c: ~p.is_null(c("patient.date_of_birth")) & ~p.age_between(c("patient.date_of_birth"), 0, 130, c.as_of), _reject("Patient age is out of valid range (0-130)")),
    "R9": Rule("InvalidServiceLine", "Service line with a negative charge or no positive units", lambda c: c.any_line(lambda f: p.less(f("charge_amount"), 0) | (~p.is_null(f("units")) & p.at_most(f("units"), 0))), _review("Service line charge or units are invalid")),
    "R10": Rule("ServiceEndBeforeStart", "Service line ends before it starts", lambda c: c.any_line(lambda f: ~p.is_null(f("date_of_service_end")) & p.date_before(f("date_of_service_end"), f("date_of_service"))), _reject("Service line end date is before its start date")),
    "R11": Rule("StatementEndBeforeStart", "Statement period ends before it starts (837I)", lambda c: ~p.is_null(c("claim_details.statement_to_date")) & p.date_before(c("claim_details.statement_to_date"), c("claim_details.statement_from_date")), _reject("Statement end date is before the start date")),
    "R12": Rule("ClaimTotalMismatch", "Claim total does not equal the sum of its line charges", lambda c: p.greater(c.amount, c("claim_totals.service_line_total")) | p.less(c.amount, c("claim_totals.service_line_total")), _reject("Claim total does not equal the sum of its service line charges")),
    "R13": Rule("WeekendOfficeVisit", "Office visit on weekend with elevated amount", lambda c: p.greater(c.amount, 500) & p.is_null(c("claim_details.facility_type_code")) & c.any_line(lambda f: p.weekend(f("date_of_service")) & p.equal_text(f("place_of_service"), "11")), _review("Weekend office visit requires verification")),
    "R14": Rule("HighValueClaim", "Claims exceeding $50,000 require manual review before payment", lambda c: p.greater(c.amount, 50000), _review("Claim exceeds high-value threshold — manual approval required")),
    "R15": Rule("UnauthorizedProcedure", "High-value claim submitted without a valid authorization number", lambda c: p.is_null(c("authorization.authorization_number")) & p.greater(c.amount, 5000), _reject("High-value claim lacks required authorization")),
    "R16": Rule("NewProviderLargeSubmission", "Large claim from a provider credentialed less than 90 days ago", lambda c: p.less(c("provider.tenure_days"), 90) & p.greater(c.amount, 10000), _review("Large submission from newly credentialed provider")),
    "R17": Rule("SuspiciouslyLowCharge", "Charge below $5 may indicate billing manipulation or data error", lambda c: p.less(c.amount, c.limit("SuspiciouslyLowCharge", 5)), _fraud("Suspiciously low charge — possible billing manipulation")),
    "R18": Rule("HighComplexityERVisit", "High-complexity ER visit (99285) with elevated charges requires clinical review", lambda c: p.greater(c.amount, 10000) & c.any_line(lambda f: ~p.is_null(f("procedure_code")) & p.equal_text(f("procedure_code"), "99285")), _review("High-complexity ER — clinical validation required")),
    "R19": Rule("MissingProviderTaxonomy", "Flag claims missing provider taxonomy code for specialty verification", lambda c: p.is_null(c("billing_provider.taxonomy")) & p.greater(c.amount, 1000), _review("Provider taxonomy code missing — cannot validate specialty")),
    "R20": Rule("MissingTaxonomyNewProvider", "New provider with missing taxonomy on high-value claim is high risk", lambda c: p.is_null(c("billing_provider.taxonomy")) & p.less(c("provider.tenure_days"), 90) & p.greater(c.amount, 5000), _fraud("New provider with no taxonomy code submitting high-value claim")),
    "R22": Rule("er_claim_no_emergency_dx", "ER claim over $5,000 lacks an emergency diagnosis", lambda c: p.equal_text(c("claim_details.place_of_service"), "23") & p.greater(c.amount, 5000) & ~p.exists(c.codes, lambda x: _any(*(p.starts_with(c.codes.field(x, "code"), s) for s in ("S06", "I21", "R55", "J96")))), (("REQUIRE_REVIEW", "ER claim over $5,000 without an emergency diagnosis", None), ("RISK_SCORE", "", 70))),
    "R23": Rule("em_code_stacking", "99214 and 99215 billed on the same claim", lambda c: c.any_line(lambda f: p.equal_text(f("procedure_code"), "99215")) & c.any_line(lambda f: p.equal_text(f("procedure_code"), "99214")), (("FLAG_FRAUD", "Multiple high-level E&M codes on one claim", None), ("REQUIRE_REVIEW", "Possible upcoding", None))),
    "R24": Rule("pt_many_sessions", "Physical therapy claim with more than 6 service lines", lambda c: c.any_line(lambda f: p.in_list(f("procedure_code"), ["97110", "97140", "97530"])) & p.count(c.lines, lambda a, b: a > b, 6) & p.greater(c.amount, 3000), _review("Physical therapy visits exceed typical session count")),
    "R25": Rule("anesthesia_without_surgery", "Anesthesia billed without a surgical procedure", lambda c: c.any_line(lambda f: p.matches(f("procedure_code"), "^0[01][0-9]{3}$")) & ~c.any_line(lambda f: p.matches(f("procedure_code"), "^[1-6][0-9]{4}$")), _reject("Anesthesia code billed without a surgical procedure")),
    "R26": Rule("dme_invalid_location", "DME billed from inpatient hospital or emergency room", lambda c: c.any_line(lambda f: p.in_list(f("procedure_code"), ["E0601", "K0823", "A4253"]) & p.in_list(f("place_of_service"), ["21", "23"])), _reject("DME codes billed from an inpatient or ER setting")),
    "R27": Rule("nonpositive_line_charge", "A service line has a zero or negative charge", lambda c: ~c.every_line(lambda f: p.greater(f("charge_amount"), 0)), _reject("Service lines contain zero or negative charges")),
    "R28": Rule("adult_preventive_for_minor", "Adult preventive visit code billed for a minor", lambda c: c.has_procedure("99385") & p.age_between(c("patient.date_of_birth"), 0, 17, c.as_of), _fraud("Adult preventive service billed for a minor")),
    "R29": Rule("costly_routine_exam", "Routine-exam principal diagnosis on a claim over $1,000", lambda c: p.starts_with(c.codes.at(0, "code"), "Z00") & p.greater(c.amount, 1000), _review("Routine exam billed above $1,000")),
    "R30": Rule("dental_missing_tooth", "Crown or root canal billed without a tooth number", lambda c: c.any_line(lambda f: p.matches(f("procedure_code"), "^D(27|33)") & p.is_null(f("tooth_info.tooth_number"))), _review("Tooth number required for crowns and root canals")),
    "R31": Rule("cardiac_procedure_non_cardiology", "Echo or cardiac catheterization billed outside cardiology", lambda c: c.any_line(lambda f: p.in_list(f("procedure_code"), ["93306", "93458", "92928"])) & ~p.starts_with(c("billing_provider.taxonomy"), "207RC"), _review("Cardiac procedure billed by a non-cardiology provider")),
}
DEFAULT_RULES = [k for k in RULES if int(k[1:]) <= 20]


def compiled(claims: DataFrame, rules: list[Rule], claim: Claim | None = None, keep: list[str] | None = None, reasons: bool = False) -> DataFrame:
    """Rules in two levels: what they read of a claim, parsed once each, and the rules over that.

    keep: columns of claims (default: all). ``_truths`` and, if asked for, ``_reasons`` follow, arrays in the order of the rules.
    """
    claim = (claim or Claim()).noting()
    preds = [r.condition(claim) for r in rules]
    columns = [F.array(*(x.truth for x in preds)).cast("array<boolean>").alias("_truths")]
    if reasons:
        columns.append(F.array(*(x.reasons for x in preds)).cast("array<array<string>>").alias("_reasons"))
    return claims.withColumns(claim.facts.columns()).select(*(claims.columns if keep is None else keep), *columns)


def _table(rules: list[Rule]) -> Column:
    """What is fixed about the rules, as one literal array. Arrays are taken apart by functions that read each once: what a lambda names may be made again for each item."""
    rows = [{"name": r.name, "description": r.description, "actions": [{"tag": t, "message": m, "score": s} for t, m, s in r.actions]} for r in rules]
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<name:string,description:string,actions:{ACTION}>>")


def truths(claims: DataFrame, rules: list[Rule], claim: Claim | None = None) -> DataFrame:
    """One row per claim and rule: claim_key, rule_name, matched, undecided. Reasons and messages are not made."""
    # outer: a plain explode would first filter claims by the size of this array, and so judge the rules twice
    rows = F.zip_with("_truths", _table(rules), lambda t, r: F.struct(r["name"].alias("rule_name"), F.coalesce(t, F.lit(False)).alias("matched"), t.isNull().alias("undecided")))
    return compiled(claims, rules, claim, ["claim_key"]).select("claim_key", F.explode_outer(rows).alias("r")).where("r is not null").select("claim_key", "r.*")


def matched(claims: DataFrame, rules: list[Rule], claim: Claim | None = None) -> DataFrame:
    """claim_key and the names of the rules that match it, sorted."""
    names = F.zip_with("_truths", _table(rules), lambda t, r: F.when(t, r["name"]))
    return compiled(claims, rules, claim, ["claim_key"]).select("claim_key", F.array_sort(F.array_compact(names)).alias("rules"))


def evaluate(claims: DataFrame, rules: list[Rule], claim: Claim | None = None) -> DataFrame:
    """All rules over all claims, in narrow projections: facts, truths and reasons once each, then results, actions and counters.

    Actions and counters come from truths, so that where results aren't read neither they nor reasons are made.
    """
    held = compiled(claims, rules, claim, reasons=True)

    def result(one: Column) -> Column:
        truth, reasons, rule = one["_truths"], one["_reasons"], one["_rules"]
        missing = F.concat(F.lit("Rule did not match: missing or unusable data ("), F.array_join(reasons, "; "), F.lit(")"))
        details = F.when(truth, F.concat(F.lit("Rule matched: "), rule["description"])).when(truth.isNull(), missing).otherwise("Rule did not match")
        return F.struct(
            rule["name"].alias("rule_name"), F.coalesce(truth, F.lit(False)).alias("matched"), truth.isNull().alias("undecided"),
            details.alias("details"), reasons.alias("reasons"), F.when(truth, rule["actions"]).otherwise(F.array().cast(ACTION)).alias("actions"),
        )

    results = F.transform(F.arrays_zip("_truths", "_reasons", _table(rules).alias("_rules")), result)
    actions = F.flatten(F.zip_with("_truths", _table(rules), lambda t, r: F.when(t, r["actions"]).otherwise(F.array().cast(ACTION))))
    return summed(held.select(*claims.columns, results.alias("results"), actions.alias("actions"), *_counters(rules)))


#: What an action adds to the weighted score.
WEIGHTS = {"REJECT": 3, "FLAG_FRAUD": 2, "REQUIRE_REVIEW": 1}


def _counters(rules: list[Rule]) -> list[Column]:
    """What a report counts, from the rules' truths."""

    def each(value: Callable[[Rule], int]) -> Column:
        fixed = F.expr(f"cast(array({', '.join(str(value(r)) for r in rules)}) as array<int>)")
        return F.zip_with("_truths", fixed, lambda t, n: F.when(t, n).otherwise(0))

    def risk(rule: Rule) -> int:
        return max((2 if t in ("REJECT", "FLAG_FRAUD") else 1 if t == "REQUIRE_REVIEW" or (t == "RISK_SCORE" and s is not None and s >= 70) else 0 for t, _, s in rule.actions), default=0)

    level = F.array_max(each(risk))
    return [
        F.size("_truths").alias("total_rules"), F.size(F.filter("_truths", lambda t: t)).alias("matched_rules"), F.size(F.filter("_truths", lambda t: t.isNull())).alias("undecided_rules"),
        F.when(level == 2, "CriticalRisk").when(level == 1, "HighRisk").otherwise("LowRisk").alias("overall_risk"),
        F.aggregate(each(lambda r: sum(WEIGHTS.get(t, 0) for t, _, _ in r.actions)), F.lit(0), lambda n, x: n + x).alias("weighted_score"),
    ]


def counters(claims: DataFrame, rules: list[Rule], claim: Claim | None = None) -> DataFrame:
    """The columns of a report but results and actions, from the rules' truths alone."""
    return summed(compiled(claims, rules, claim).select(*claims.columns, *_counters(rules)))


def at_risk(rows: DataFrame, *risks: str) -> DataFrame:
    """The counted claims of some risks.

    The risk is taken out of an array: a plain filter on it would be moved below, and so judge the rules once more for each
    time that it reads their truths.
    """
    kept = F.filter(F.array("overall_risk"), lambda x: x.isin(*risks))
    return rows.select(*(c for c in rows.columns if c != "overall_risk"), F.explode_outer(kept).alias("overall_risk")).where("overall_risk is not null")


def report(rows: DataFrame) -> DataFrame:
    """Counters, overall risk, weighted score and summary, from the column ``results``."""
    actions = F.flatten(F.transform("results", lambda r: r["actions"]))
    rows = rows.withColumn("actions", actions)
    rows = rows.withColumns({
        "total_rules": F.size("results"),
        "matched_rules": F.size(F.filter("results", lambda r: r["matched"])),
        "undecided_rules": F.size(F.filter("results", lambda r: r["undecided"])),
        "overall_risk": F.when(F.exists("actions", lambda a: a["tag"].isin("REJECT", "FLAG_FRAUD")), "CriticalRisk").when(F.exists("actions", lambda a: (a["tag"] == "REQUIRE_REVIEW") | ((a["tag"] == "RISK_SCORE") & (a["score"] >= 70))), "HighRisk").otherwise("LowRisk"),
        "weighted_score": F.aggregate("actions", F.lit(0), lambda n, a: n + F.when(a["tag"] == "REJECT", WEIGHTS["REJECT"]).when(a["tag"] == "FLAG_FRAUD", WEIGHTS["FLAG_FRAUD"]).when(a["tag"] == "REQUIRE_REVIEW", WEIGHTS["REQUIRE_REVIEW"]).otherwise(0)),
    })
    return summed(rows)


def summed(rows: DataFrame) -> DataFrame:
    """With the summary sentence of the counters."""
    open_ = F.when(F.col("undecided_rules") > 0, F.concat(F.lit(", "), F.col("undecided_rules").cast("string"), F.lit(" not checked (missing data)"))).otherwise("")
    summary = F.concat(F.lit("Evaluated "), F.col("total_rules").cast("string"), F.lit(" rules, "), F.col("matched_rules").cast("string"), F.lit(" matched"), open_, F.lit(". Overall risk: "), F.col("overall_risk"))
    return rows.withColumn("summary", summary)


def merge_finding(reports: DataFrame, reason: Column) -> DataFrame:
    """Add the provider finding (where ``reason`` isn't NULL) to the results as a rejection, then count again."""
    name = "NPPESProviderLookup"
    finding = F.struct(
        F.lit(name).alias("rule_name"), F.lit(True).alias("matched"), F.lit(False).alias("undecided"), reason.alias("details"), F.array().cast("array<string>").alias("reasons"),
        F.array(F.struct(F.lit("REJECT").alias("tag"), reason.alias("message"), F.lit(None).cast("int").alias("score"))).alias("actions"),
    )
    there = F.exists("results", lambda r: r["rule_name"] == name)
    return report(reports.withColumn("results", F.when(reason.isNotNull() & ~there, F.array_append("results", finding)).otherwise(F.col("results"))))


def merge_counted(rows: DataFrame, reason: Column) -> DataFrame:
    """As ``merge_finding``, over the counters of rules among which the finding isn't, without their results."""
    found = reason.isNotNull().cast("int")
    return summed(rows.withColumns({
        "total_rules": F.col("total_rules") + found, "matched_rules": F.col("matched_rules") + found,
        "overall_risk": F.when(reason.isNotNull(), "CriticalRisk").otherwise(F.col("overall_risk")), "weighted_score": F.col("weighted_score") + found * WEIGHTS["REJECT"],
    }))
