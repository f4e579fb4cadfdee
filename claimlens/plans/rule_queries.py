"""Queries of predicates, rules and reports over all claims, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import policy
from ..operators import predicates as p
from ..operators import rules as R
from ..sources import batches
from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The day that counts as today, and amounts that the given tables reach, in place of the rules' own.
DAY = "2000-01-01"
LIMITS = {"ExcessiveTotalCharges": 250_000, "SuspiciouslyLowCharge": 5_000}
AS_OF = f"date '{DAY}'"


def num(x: str) -> str:
    return rf"(case when regexp_full_match({x}, '\s*-?\d+(\.\d+)?([eE][+-]?\d+)?') then try_cast(trim({x}) as double) end)"


def day(x: str) -> str:
    return rf"(case when regexp_full_match({x}, '\d{{4}}-\d{{2}}-\d{{2}}') then try_cast({x} as date) when regexp_full_match({x}, '\d{{8}}') then try_cast(concat(substr({x}, 1, 4), '-', substr({x}, 5, 2), '-', substr({x}, 7, 2)) as date) end)"


def some(pred: str) -> str:
    return f"case when count(l.claim_key) = 0 then null when coalesce(bool_or({pred}), false) then true when count(l.claim_key) > count({pred}) then null else false end"


def every(pred: str) -> str:
    return f"case when count(l.claim_key) = 0 then null when not coalesce(bool_and({pred}), true) then false when count(l.claim_key) > count({pred}) then null else true end"


#: The Luhn sum of a ten-digit number with its prefix, digit by digit.
_LUHN = "24 + " + " + ".join(f"(case when cast(substr(npi, {k + 1}, 1) as int) > 4 then 2 * cast(substr(npi, {k + 1}, 1) as int) - 9 else 2 * cast(substr(npi, {k + 1}, 1) as int) end)" if k % 2 == 0 else f"cast(substr(npi, {k + 1}, 1) as int)" for k in range(10))
NPI_OK = f"(case when npi is null then null when not regexp_full_match(npi, '[0-9]{{10}}') then false else ({_LUHN}) % 10 = 0 end)"
_AGE = f"(year({AS_OF}) - year({day('date_of_birth')}) - case when strftime({AS_OF}, '%m%d') < strftime({day('date_of_birth')}, '%m%d') then 1 else 0 end)"

#: Facts of a claim's lines and codes, each one aggregate over its rows.
LINE_FACTS = {
    "old_line": some(f"{day('l.date_of_service')} < date '1900-01-01'"),
    "future_line": some(f"{day('l.date_of_service')} > {AS_OF}"),
    "bad_line": some(f"({num('l.charge_amount')} < 0 or (l.units is not null and {num('l.units')} <= 0))"),
    "end_first": some(f"(l.date_of_service_end is not null and {day('l.date_of_service_end')} < {day('l.date_of_service')})"),
    "weekend_office": some(f"(isodow({day('l.date_of_service')}) >= 6 and l.place_of_service = '11')"),
    "er": some("l.procedure_code = '99285'"), "e15": some("l.procedure_code = '99215'"), "e14": some("l.procedure_code = '99214'"),
    "pt": some("l.procedure_code in ('97110', '97140', '97530')"), "anes": some("regexp_full_match(l.procedure_code, '0[01][0-9]{3}')"), "surg": some("regexp_full_match(l.procedure_code, '[1-6][0-9]{4}')"),
    "dme": some("(l.procedure_code in ('E0601', 'K0823', 'A4253') and l.place_of_service in ('21', '23'))"),
    "all_positive": every(f"{num('l.charge_amount')} > 0"), "tooth": some("(regexp_matches(l.procedure_code, '^D(27|33)') and l.tooth_number is null)"),
    "cardiac": some("l.procedure_code in ('93306', '93458', '92928')"),
    "preventive": "case when count(l.procedure_code) > 0 then bool_or(l.procedure_code = '99385') end",
    "n_lines": "count(l.claim_key)",
    "line_total": "case when count(l.claim_key) > 0 and count(try_cast(trim(l.charge_amount) as decimal(38,6))) = count(l.claim_key) then cast(sum(try_cast(trim(l.charge_amount) as decimal(38,6))) as double) end",
}
DX_FACTS = {"n_dx": "count(d.code)", "first_dx": "min(d.code)", "emergency": "case when count(d.code) > 0 then bool_or(starts_with(d.code, 'S06') or starts_with(d.code, 'I21') or starts_with(d.code, 'R55') or starts_with(d.code, 'J96')) end"}

FACTS = (
    "lf as (select c.claim_key, " + ", ".join(f"{v} as {k}" for k, v in LINE_FACTS.items()) + " from v_claim c left join v_lines l on l.claim_key = c.claim_key group by c.claim_key), "
    "df as (select c.claim_key, " + ", ".join(f"{v} as {k}" for k, v in DX_FACTS.items()) + " from v_claim c left join v_dx d on d.claim_key = c.claim_key group by c.claim_key), "
    f"f as (select c.*, lf.* exclude (claim_key), df.* exclude (claim_key), {num('claim_amount')} as amount, {num('tenure_days')} as tenure from v_claim c join lf on lf.claim_key = c.claim_key join df on df.claim_key = c.claim_key)"
)

RULE_SQL = {
    "R1": "old_line", "R2": "claim_id is null or npi is null or date_of_birth is null or claim_amount is null", "R3": f"npi is not null and not {NPI_OK}", "R4": "future_line",
    "R5": "npi is not null and not regexp_full_match(npi, '[0-9]{10}')", "R6": "n_dx = 0", "R7": f"{num('total_charges')} > 250000", "R8": f"date_of_birth is not null and not ({_AGE} between 0 and 130)",
    "R9": "bad_line", "R10": "end_first", "R11": f"statement_to_date is not null and {day('statement_to_date')} < {day('statement_from_date')}", "R12": "amount > line_total or amount < line_total",
    "R13": "amount > 500 and facility_type_code is null and weekend_office", "R14": "amount > 50000", "R15": "authorization_number is null and amount > 5000", "R16": "tenure < 90 and amount > 10000",
    "R17": "amount < 5000", "R18": "amount > 10000 and er", "R19": "taxonomy is null and amount > 1000", "R20": "taxonomy is null and tenure < 90 and amount > 5000",
    "R22": "place_of_service = '23' and amount > 5000 and not emergency", "R23": "e15 and e14", "R24": "pt and n_lines > 6 and amount > 3000", "R25": "anes and not surg", "R26": "dme", "R27": "not all_positive",
    "R28": f"preventive and {_AGE} between 0 and 17", "R29": "starts_with(first_dx, 'Z00') and amount > 1000", "R30": "tooth", "R31": "cardiac and not starts_with(taxonomy, '207RC')",
}


def claim() -> R.Claim:
    return R.Claim(as_of=DAY, limits=LIMITS)


def facts_sql(body: str) -> str:
    return views.sql_with_views(f"with {FACTS} {body}", "v_claim", "v_lines", "v_dx")


def truths_sql(keys: list[str]) -> str:
    return "t as (select claim_key, risk_score, ml_status, batch_id, " + ", ".join(f"({RULE_SQL[k]}) as {k}" for k in keys) + " from f)"


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _rule(key: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        truth = R.RULES[key].condition(claim()).truth
        return views.claims(spark, sf_dir).select("claim_key", F.coalesce(truth, F.lit(False)).cast("int").alias("matched"), truth.isNull().cast("int").alias("undecided"))

    return query


for _k in R.RULES:
    add(_k, _rule(_k), facts_sql(f"select claim_key, cast(coalesce({RULE_SQL[_k]}, false) as int) as matched, cast(({RULE_SQL[_k]}) is null as int) as undecided from f"))


def _weights(key: str) -> tuple[int, str]:
    points = {"REJECT": 3, "FLAG_FRAUD": 2, "REQUIRE_REVIEW": 1}
    tags = [t for t, _, _ in R.RULES[key].actions]
    return sum(points.get(t, 0) for t in tags), "critical" if {"REJECT", "FLAG_FRAUD"} & set(tags) else "high"


def report_sql(keys: list[str], select: str) -> str:
    n = lambda ks, x="": " + ".join(f"cast(coalesce({k}, false) as int){x}" for k in ks) or "0"
    critical = [k for k in keys if _weights(k)[1] == "critical"]
    high = [k for k in keys if _weights(k)[1] == "high"]
    rep = (
        f"r as (select t.*, {len(keys)} as total_rules, {n(keys)} as matched_rules, {' + '.join(f'cast({k} is null as int)' for k in keys)} as undecided_rules, "
        f"case when {n(critical)} > 0 then 'CriticalRisk' when {n(high)} > 0 then 'HighRisk' else 'LowRisk' end as overall_risk, "
        f"{' + '.join(f'{_weights(k)[0]} * cast(coalesce({k}, false) as int)' for k in keys)} as weighted_score from t)"
    )
    return views.sql_with_views(f"with {FACTS}, {truths_sql(keys)}, {rep} {select}", "v_claim", "v_lines", "v_dx")


SUMMARY = "concat('Evaluated ', total_rules, ' rules, ', matched_rules, ' matched', case when undecided_rules > 0 then concat(', ', undecided_rules, ' not checked (missing data)') else '' end, '. Overall risk: ', overall_risk)"
HEADER = ("claim_key", "total_rules", "matched_rules", "undecided_rules", "overall_risk", "weighted_score", "summary")


def reports(spark: SparkSession, sf_dir: str, keys: list[str] | None = None) -> DataFrame:
    return R.evaluate(views.claims(spark, sf_dir), [R.RULES[k] for k in keys or R.DEFAULT_RULES], claim())


def counted(spark: SparkSession, sf_dir: str, keys: list[str] | None = None) -> DataFrame:
    return R.counters(views.claims(spark, sf_dir), [R.RULES[k] for k in keys or R.DEFAULT_RULES], claim())


_report = f"select claim_key, total_rules, matched_rules, undecided_rules, overall_risk, weighted_score, {SUMMARY} as summary from r"
add("flagship", lambda s, d: counted(s, d).select(*HEADER), report_sql(R.DEFAULT_RULES, _report))
add("P19", lambda s, d: reports(s, d).select(*HEADER), report_sql(R.DEFAULT_RULES, _report))
_long = " union all ".join(f"select claim_key, '{R.RULES[k].name}' as rule_name, cast(coalesce({k}, false) as int) as matched, cast({k} is null as int) as undecided from t" for k in R.DEFAULT_RULES)
add("P20", lambda s, d: R.truths(views.claims(s, d), [R.RULES[k] for k in R.DEFAULT_RULES], claim()).select("claim_key", "rule_name", F.col("matched").cast("int").alias("matched"), F.col("undecided").cast("int").alias("undecided")), views.sql_with_views(f"with {FACTS}, {truths_sql(R.DEFAULT_RULES)} {_long}", "v_claim", "v_lines", "v_dx"))
add("A3", lambda s, d: counted(s, d).groupBy("matched_rules", "undecided_rules").agg(F.count("*").alias("n")), report_sql(R.DEFAULT_RULES, "select matched_rules, undecided_rules, count(*) as n from r group by all"))
add("A4", lambda s, d: counted(s, d).groupBy("overall_risk").agg(F.count("*").alias("n")), report_sql(R.DEFAULT_RULES, "select overall_risk, count(*) as n from r group by all"))
add("A5", lambda s, d: counted(s, d).select("claim_key", "weighted_score"), report_sql(R.DEFAULT_RULES, "select claim_key, weighted_score from r"))
add("A6", lambda s, d: counted(s, d).select("claim_key", "summary"), report_sql(R.DEFAULT_RULES, f"select claim_key, {SUMMARY} as summary from r"))
_unpivot = f"u as ({_long})"
_with_long = lambda body: views.sql_with_views(f"with {FACTS}, {truths_sql(R.DEFAULT_RULES)}, {_unpivot} {body}", "v_claim", "v_lines", "v_dx")
add("A10", lambda s, d: QUERIES["P20"](s, d).groupBy("rule_name").agg(F.min("undecided").alias("never_checked")), _with_long("select rule_name, min(undecided) as never_checked from u group by 1"))
add("A12", lambda s, d: QUERIES["P20"](s, d).groupBy("rule_name").agg(F.sum("matched").alias("n_matched"), F.sum("undecided").alias("n_undecided")), _with_long("select rule_name, cast(sum(matched) as bigint) as n_matched, cast(sum(undecided) as bigint) as n_undecided from u group by 1"))
# without R12, which every order of the given tables breaks, so that no claim would be clean
_some = ["R3", "R8", "R14", "R16", "R18", "R19"]
_filter = lambda: F.when((F.col("matched_rules") == 0) & (F.col("undecided_rules") == 0), "Clean").when(F.col("matched_rules") == 0, "NotAssessed").otherwise(F.col("overall_risk"))
add("P22", lambda s, d: counted(s, d, _some).select("claim_key", _filter().alias("found_by")), report_sql(_some, "select claim_key, case when matched_rules = 0 and undecided_rules = 0 then 'Clean' when matched_rules = 0 then 'NotAssessed' else overall_risk end as found_by from r"))
add("P23", lambda s, d: R.at_risk(counted(s, d).select("claim_key", "overall_risk"), "HighRisk", "CriticalRisk"), report_sql(R.DEFAULT_RULES, "select claim_key, overall_risk from r where overall_risk in ('HighRisk', 'CriticalRisk')"))
_flag = lambda: F.col("overall_risk").isin("HighRisk", "CriticalRisk")
add("A1", lambda s, d: counted(s, d).groupBy("batch_id").agg(F.count("*").alias("n_total"), F.count_if(_flag()).alias("n_flagged"), F.count_if(~_flag()).alias("n_clean")), report_sql(R.DEFAULT_RULES, "select batch_id, count(*) as n_total, count(*) filter (overall_risk in ('HighRisk', 'CriticalRisk')) as n_flagged, count(*) filter (overall_risk not in ('HighRisk', 'CriticalRisk')) as n_clean from r group by 1"))
_rank = lambda: F.when(F.col("overall_risk") == "CriticalRisk", 0).when(F.col("overall_risk") == "HighRisk", 1).when(F.col("overall_risk") == "MediumRisk", 2).otherwise(3)
add("O1", lambda s, d: counted(s, d).select(_rank().alias("severity"), "claim_key").orderBy("severity", "claim_key").limit(500), report_sql(R.DEFAULT_RULES, "select case overall_risk when 'CriticalRisk' then 0 when 'HighRisk' then 1 when 'MediumRisk' then 2 else 3 end as severity, claim_key from r order by 1, 2 limit 500"))


def _written_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports stored beside the claims and read back; claims of one batch get no report."""
    root = batches.scratch(spark, "reports")
    rows = reports(spark, sf_dir).withColumn("error_message", F.when(F.col("batch_id") == 7, "the rule engine returned no report for this claim"))
    batches.evaluated(spark, root, rows, "2000-01-01 00:00:00")
    return batches.reports(spark, root).select("claim_key", "batch_id", "status", "overall_risk", "weighted_score", "summary", "error_message", F.col("processed_at").cast("string").alias("processed_at"), F.coalesce(F.json_array_length("results"), F.lit(0)).alias("n_results"))


_if_ok = lambda x: f"case when batch_id <> 7 then {x} end"
add("SNK6", _written_back, report_sql(R.DEFAULT_RULES, f"select claim_key, cast(batch_id as string) as batch_id, case when batch_id = 7 then 'not_assessed' else 'evaluated' end as status, {_if_ok('overall_risk')} as overall_risk, {_if_ok('weighted_score')} as weighted_score, {_if_ok(SUMMARY)} as summary, case when batch_id = 7 then 'the rule engine returned no report for this claim' end as error_message, '2000-01-01 00:00:00' as processed_at, case when batch_id = 7 then 0 else total_rules end as n_results from r"))
add("ST5", lambda s, d: counted(s, d).groupBy("batch_id", "overall_risk").agg(F.count("*").alias("n"), F.sum("weighted_score").alias("score")), report_sql(R.DEFAULT_RULES, "select batch_id, overall_risk, count(*) as n, cast(sum(weighted_score) as bigint) as score from r group by 1, 2"))
add("PRJ4", lambda s, d: reports(s, d).select("claim_key", F.coalesce("overall_risk", F.lit("N/A")).alias("risk"), F.coalesce(F.get("actions", F.lit(0))["tag"], F.lit("none")).alias("first_action")),
    report_sql(R.DEFAULT_RULES, "select claim_key, overall_risk as risk, case " + " ".join(f"when coalesce({k}, false) then '{R.RULES[k].actions[0][0]}'" for k in R.DEFAULT_RULES) + " else 'none' end as first_action from r"))


def _not_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports(spark, sf_dir, ["R14", "R16", "R19"]).select("claim_key", F.explode(F.filter("results", lambda r: r["undecided"])).alias("r"))
    return rows.select("claim_key", "r.rule_name", F.array_join("r.reasons", "; ").alias("missing"))


_amount_why = f"case when claim_amount is null then 'financial.claim_amount missing' when {num('claim_amount')} is null then 'financial.claim_amount is not a number' end"
_why = {"R14": _amount_why, "R19": _amount_why, "R16": f"concat_ws('; ', case when tenure_days is null then 'provider.tenure_days missing' end, {_amount_why})"}
add("PRJ5", _not_checked, facts_sql(" union all ".join(f"select claim_key, '{R.RULES[k].name}' as rule_name, {_why[k]} as missing from f where ({RULE_SQL[k]}) is null" for k in _why)))


# decision policy
def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import policy

    return policy.decide(policy.from_results(reports(spark, sf_dir, ["R14", "R16", "R17", "R11"])))


_keys = ["R14", "R16", "R17", "R11"]
_rej, _con = "coalesce(R11, false)", " or ".join(f"coalesce({k}, false)" for k in _keys)
_s = "coalesce(risk_score, 0.0)"
_dsl = "concat_ws(',', " + ", ".join(f"case when {k} then 'DSL:{R.RULES[k].name}' end" for k in _keys) + ")"
_band = f"case when {_s} >= 0.93 then 'ML:risk_ge_siu' when {_s} >= 0.8 then 'ML:risk_ge_high' when {_s} >= 0.35 then 'ML:risk_ge_low' else 'ML:risk_lt_0_35' end"
_join = lambda *x: f"concat_ws(',', {', '.join(f'nullif({y}, {chr(39)}{chr(39)})' for y in x)})"
_status = f"case when {_rej} then 'REJECT' when ml_status <> 'ok' then case when {_con} then 'REQUIRE_REVIEW' else 'APPROVE' end when {_s} >= 0.35 or ({_con}) then 'REQUIRE_REVIEW' else 'APPROVE' end"
_queue = f"case when {_rej} then 'denied' when ml_status <> 'ok' then case when {_con} then 'policy_default' else 'none' end when {_s} >= 0.93 then 'siu_escalation' when {_s} >= 0.8 then 'fraud_priority' when {_s} >= 0.35 or ({_con}) then 'manual_review' else 'none' end"
_reasons = f"case when {_rej} then concat({_dsl}, ',DSL:reject') when ml_status <> 'ok' then {_join(f'case when {_con} then {_dsl} end', chr(39) + 'ML:error_fallback' + chr(39))} when {_s} >= 0.35 then {_join(_dsl, _band)} when {_con} then {_dsl} else {_band} end"
_policy = lambda body: views.sql_with_views(f"with {FACTS}, {truths_sql(_keys)} {body}", "v_claim", "v_lines", "v_dx")
add("D1", lambda s, d: _decided(s, d).select("claim_key", "status", "queue", F.array_join("reason_codes", ",").alias("reasons")), _policy(f"select claim_key, {_status} as status, {_queue} as queue, {_reasons} as reasons from t"))
_all_rejects = " or ".join(f"coalesce({k}, false)" for k in R.DEFAULT_RULES if R.RULES[k].actions[0][0] == "REJECT")
add("D3_all", lambda s, d: reports(s, d).select("claim_key", F.array_join(F.transform("actions", lambda a: a["tag"]), ",").alias("tags"), F.array_join(F.transform("actions", lambda a: a["message"]), "|").alias("messages")), views.sql_with_views(
    f"with {FACTS}, {truths_sql(R.DEFAULT_RULES)} select claim_key, concat_ws(',', " + ", ".join(f"case when {k} then '{R.RULES[k].actions[0][0]}' end" for k in R.DEFAULT_RULES) + ") as tags, concat_ws('|', " + ", ".join(f"case when {k} then '{R.RULES[k].actions[0][1].replace(chr(39), chr(39) * 2)}' end" for k in R.DEFAULT_RULES) + ") as messages from t", "v_claim", "v_lines", "v_dx"))
_any_rule = " or ".join(f"coalesce({k}, false)" for k in R.DEFAULT_RULES)
_over_all = lambda sql: sql.replace(_con, "$any").replace(_rej, f"({_all_rejects})").replace("$any", _any_rule)
add("D1_all", lambda s, d: policy.decide(policy.from_results(reports(s, d))).select("claim_key", "status", "queue"), views.sql_with_views(
    f"with {FACTS}, {truths_sql(R.DEFAULT_RULES)} select claim_key, {_over_all(_status)} as status, {_over_all(_queue)} as queue from t", "v_claim", "v_lines", "v_dx"))
add("D2", lambda s, d: _bands(s, d), views.sql_with_views(f"select claim_key, {_band} as band from v_claim"))
add("D3", lambda s, d: reports(s, d, _keys).select("claim_key", F.array_join(F.transform("actions", lambda a: a["tag"]), ",").alias("tags")), _policy("select claim_key, concat_ws(',', " + ", ".join(f"case when {k} then '{R.RULES[k].actions[0][0]}' end" for k in _keys) + ") as tags from t"))


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import policy

    return views.flat_claims(spark, sf_dir).select("claim_key", policy.band(F.coalesce("risk_score", F.lit(0.0))).alias("band"))


def _fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import overlap

    return overlap.cofiring(R.matched(views.claims(spark, sf_dir), [R.RULES[k] for k in R.DEFAULT_RULES], claim()))


add("V7", _fired, _with_long("select a.rule_name as a, b.rule_name as b, count(*) as n_both, any_value(x.n) as n_a, any_value(y.n) as n_b, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 4) as jaccard from u a join u b on a.claim_key = b.claim_key and a.rule_name < b.rule_name join (select rule_name, count(*) as n from u where matched = 1 group by 1) x on x.rule_name = a.rule_name join (select rule_name, count(*) as n from u where matched = 1 group by 1) y on y.rule_name = b.rule_name where a.matched = 1 and b.matched = 1 group by 1, 2"))


# predicates one by one
def _pred(make: Callable[[R.Claim], p.Pred]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pred = make(claim())
        return views.claims(spark, sf_dir).select("claim_key", pred.truth.cast("int").alias("truth"), F.array_join(pred.reasons, "; ").alias("reasons"))

    return query


def _pred_sql(truth: str, why: str = "''") -> str:
    return facts_sql(f"select claim_key, cast(({truth}) as int) as truth, case when ({truth}) is null then {why} else '' end as reasons from f")


_tax = "'billing_provider.taxonomy missing'"
_no_lines = "'service_lines missing or empty'"
_charge_why = f"case when n_lines = 0 then {_no_lines} else why end"
for _name, _make, _truth, _reason in (
    ("P1", lambda c: p.always(True) & ~p.always(False), "true", "''"),
    ("P2", lambda c: p.equal_text(c("claim_details.place_of_service"), "11") | ~p.equal_text(c("billing_provider.taxonomy"), "207X00000X"), "place_of_service = '11' or taxonomy <> '207X00000X'", _tax),
    ("P3", lambda c: p.equal_number(c("provider.tenure_days"), 7), "tenure = 7", "'provider.tenure_days missing'"),
    ("P4", lambda c: p.at_least(c.amount, c("claim_totals.total_charges")), f"amount >= {num('total_charges')}", f"concat_ws('; ', {_amount_why}, case when total_charges is null then 'claim_totals.total_charges missing' end)"),
    ("P5", lambda c: p.equal_text(c.amount, c("claim_totals.total_charges")), "claim_amount = total_charges", "concat_ws('; ', case when claim_amount is null then 'financial.claim_amount missing' end, case when total_charges is null then 'claim_totals.total_charges missing' end)"),
    ("P6", lambda c: p.between(c.amount, 100000, 200000), "amount between 100000 and 200000", _amount_why),
    ("P7", lambda c: p.is_null(c("billing_provider.taxonomy")), "taxonomy is null", "''"),
    ("P8", lambda c: p.contains(c("billing_provider.taxonomy"), "RC"), "contains(taxonomy, 'RC')", _tax),
    ("P9", lambda c: p.matches(c("billing_provider.taxonomy"), "(^20[[:digit:]]R[[:xdigit:][:blank:]]0{2,4}X$)|(^[[:cntrl:]])|(q$)"), "regexp_full_match(taxonomy, '20[0-9]R[0-9A-Fa-f]0{2,4}X')", _tax),
    ("P10", lambda c: p.greater(c.amount, 100000) & (p.starts_with(c("billing_provider.taxonomy"), "207RC") | ~p.less(c("provider.tenure_days"), 90)), "amount > 100000 and (starts_with(taxonomy, '207RC') or not tenure < 90)", f"concat_ws('; ', {_amount_why}, case when (starts_with(taxonomy, '207RC') or not tenure < 90) is null then concat_ws('; ', case when taxonomy is null then {_tax} end, case when tenure is null then 'provider.tenure_days missing' end) end)"),
    ("P11", lambda c: c.any_line(lambda f: p.equal_text(f("procedure_code"), "99285")), "er", _no_lines),
    ("P14", lambda c: p.count(c.lines, lambda a, b: a >= b, 4), "n_lines >= 4", "''"),
    ("P15", lambda c: p.has_code(c.codes, "code", "Z00", "diagnosis_codes missing or empty"), None, None),
    ("P17", lambda c: (lambda amount: p.greater(amount, 1000) & p.less(amount, 90000))(c.amount), "amount > 1000 and amount < 90000", _amount_why),
    ("P18", lambda c: p.starts_with(c.codes.at(1, "code"), "Z"), None, None),
):
    if _name == "P15":
        add(_name, _pred(_make), views.sql_with_views("select c.claim_key, case when count(d.code) > 0 then cast(bool_or(d.code = 'Z00') as int) end as truth, case when count(d.code) = 0 then 'diagnosis_codes missing or empty' else '' end as reasons from v_claim c left join v_dx d on d.claim_key = c.claim_key group by 1", "v_claim", "v_dx"))
    elif _name == "P18":
        add(_name, _pred(_make), views.sql_with_views("with k as (select claim_key, code, row_number() over (partition by claim_key order by code) as n from v_dx) select c.claim_key, cast(starts_with(k.code, 'Z') as int) as truth, case when k.code is null then 'diagnosis_codes.1.code missing' else '' end as reasons from v_claim c left join k on k.claim_key = c.claim_key and k.n = 2", "v_claim", "v_dx"))
    else:
        add(_name, _pred(_make), _pred_sql(_truth, _reason))


def _sorted_reasons(make: Callable[[R.Claim], p.Pred]) -> Callable[[SparkSession, str], DataFrame]:
    """Reasons in the order of their texts: lines with the same fields have no order that SQL could name."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pred = make(claim())
        return views.claims(spark, sf_dir).select("claim_key", pred.truth.cast("int").alias("truth"), F.array_join(F.array_sort(pred.reasons), "; ").alias("reasons"))

    return query


_why_charge = lambda x: f"case when {x}.charge_amount is null then 'service_lines[].charge_amount missing' when {num(x + '.charge_amount')} is null then 'service_lines[].charge_amount is not a number' end"
add("P12", _sorted_reasons(lambda c: c.every_line(lambda f: p.greater(f("charge_amount"), 0))), facts_sql(
    f"select claim_key, cast(all_positive as int) as truth, case when all_positive is not null then '' when n_lines = 0 then {_no_lines} else y.reasons end as reasons from f left join "
    f"(select l.claim_key, array_to_string(list_sort(list(distinct {_why_charge('l')})), '; ') as reasons from v_lines l where {num('l.charge_amount')} is null group by 1) y using (claim_key)"))
# an ER visit, and another line of the claim that costs more than this one
_dearer = f"{num('b.charge_amount')} > {num('a.charge_amount')}"
add("P13", _sorted_reasons(lambda c: c.any_line(lambda f: p.equal_text(f("procedure_code"), "99285") & c.any_line(lambda g: p.greater(g("charge_amount"), f("charge_amount"))))), views.sql_with_views(
    f"with la as (select *, row_number() over () as line from v_lines), pairs as (select a.claim_key, a.line, a.procedure_code, {_dearer} as dearer, {_why_charge('a')} as why_a, {_why_charge('b')} as why_b from la a join la b on b.claim_key = a.claim_key), "
    "i as (select claim_key, line, procedure_code = '99285' and case when bool_or(dearer) then true when count(*) > count(dearer) then null else false end as met from pairs group by claim_key, line, procedure_code), "
    "o as (select claim_key, case when bool_or(met) then true when count(*) > count(met) then null else false end as truth from i group by 1), "
    "y as (select claim_key, array_to_string(list_sort(list(distinct why)), '; ') as reasons from (select claim_key, unnest([why_a, why_b]) as why from pairs join i using (claim_key, line) where met is null and dearer is null) where why is not null group by 1) "
    f"select c.claim_key, cast(truth as int) as truth, case when truth is not null then '' when o.claim_key is null then {_no_lines} else y.reasons end as reasons from v_claim c left join o on o.claim_key = c.claim_key left join y on y.claim_key = c.claim_key", "v_claim", "v_lines"))


def _procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with procedure codes, a code of their own, both, neither or empty ones."""
    k = F.col("claim_key")
    one = lambda code: F.array(F.struct(F.lit(code).alias("code")))
    rows = views.claims(spark, sf_dir).withColumns({
        "procedure_codes": F.when(k % 3 == 0, F.when(k % 2 == 0, one("99385")).otherwise(one("X"))).when(k % 3 == 1, F.slice(one("X"), 1, 0)),
        "procedure_code": F.when(k % 5 == 0, "99385").when(k % 5 == 1, "Y"), "service_lines": F.when(k % 7 != 0, F.col("service_lines")),
    })
    pred = R.Claim(as_of=DAY, limits=LIMITS, sections=frozenset({"procedure_codes", "procedure_code"})).has_procedure("99385")
    return rows.select("claim_key", pred.truth.cast("int").alias("truth"), F.array_join(pred.reasons, "; ").alias("reasons"))


_found = "case when claim_key % 6 = 0 or claim_key % 5 = 0 or (claim_key % 7 <> 0 and coalesce(preventive, false)) then 1 when claim_key % 3 = 0 or claim_key % 5 = 1 or (claim_key % 7 <> 0 and n_lines > 0) then 0 end"
add("P16", _procedures, facts_sql(f"select claim_key, {_found} as truth, case when ({_found}) is null then 'no procedure_codes, service_lines or procedure_code on the claim' else '' end as reasons from f"))
