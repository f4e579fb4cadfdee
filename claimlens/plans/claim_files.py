"""Claim files written from the given tables, for the queries of the file sources; and these queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files, json_claims
from . import views
from .views import sql_with_views as cte

#: Shapes of a JSON file by its claim's key modulo 10: a claim in the contract, a bare list, a list under
#: ``claims`` with entries that are no claims, a converted claim, and six that are refused whole.
REFUSED = {
    4: ("{bad", "not valid JSON"),
    5: ('{"rulesText": "x", "claims": []}', "an engine test request (rules and a list of claims), not a claims file"),
    6: ('{"claims": 7}', '"claims" must be a list of claims'),
    7: ("[]", "the list of claims is empty"),
    8: ('[3, {"a": 1}]', "none of the 2 entries is a claim"),
    9: ('{"claim": 5}', "no claim found (expected a claim_id or claim field)"),
}


def _json(**fields: Column) -> Column:
    return F.struct(*(c.alias(k) for k, c in fields.items()))


def contract_document() -> Column:
    c = F.col
    lines = F.transform("service_lines", lambda x: x.dropFields("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    return F.to_json(_json(
        claim_id=c("claim_id"), transaction_type=F.lit(" "), provider=c("provider").dropFields("city"), billing_provider=_json(npi=c("billing_provider.npi"), taxonomy=c("billing_provider.taxonomy")),
        claim_details=c("claim_details"), financial=c("financial"), claim_totals=_json(total_charges=c("claim_totals.total_charges")), authorization=c("authorization"),
        patient=c("patient"), subscriber=c("subscriber"), interchange=c("interchange"), service_lines=lines, diagnosis_codes=c("diagnosis_codes"),
    ))


def converted_document() -> Column:
    c, text = F.col, F.lit
    even = F.col("claim_key") % 2 == 0
    line = lambda x: F.struct(
        x["line_number"].alias("line_number"), F.when(x["line_number"] % 2 == 0, x["date_of_service"]).alias("service_date"), F.when(x["line_number"] % 2 == 1, x["date_of_service"]).alias("date_of_service"),
        x["date_of_service_end"].alias("service_date_end"), F.when(x["line_number"] % 3 == 0, "  ").otherwise(x["place_of_service"]).alias("place_of_service"), x["procedure_code"].alias("procedure_code"),
        x["charge_amount"].alias("charge_amount"), F.coalesce(x["units"], text("")).alias("units"), x["tooth_info"].alias("tooth_info"),
    )
    return F.to_json(_json(
        transaction_type=text("837P"), interchange=c("interchange"), submitter=_json(name=text("S"), id=text(" ")), receiver=_json(name=text("R")),
        billing_provider=_json(npi=c("billing_provider.npi"), name=text("Clinic"), taxonomy_code=F.coalesce("billing_provider.taxonomy", text(" ")), address=_json(street=text("1 Main St"), city=text(""), zip=text("62701"))),
        claim=_json(
            claim_id=c("claim_id"), total_charge_amount=c("financial.claim_amount"), place_of_service=c("claim_details.place_of_service"), facility_type_code=c("claim_details.facility_type_code"), frequency_code=text("1"),
            dates=_json(statement_from=c("claim_details.statement_from_date"), statement_to=c("claim_details.statement_to_date"), admission_date=text("")), prior_authorization=c("authorization.authorization_number"),
            subscriber=_json(member_id=c("subscriber.member_id"), first_name=text("Sub"), date_of_birth=c("patient.date_of_birth"), gender=text(" ")), patient=F.when(even, _json(first_name=text("Pat"), date_of_birth=text("2001-02-03"))),
            payer=_json(name=text("Payer"), payer_id=text("P1")), service_lines=F.transform("service_lines", line), diagnosis_codes=F.transform("diagnosis_codes", lambda x: _json(code=x["code"], qualifier=text("ABK"))),
        ),
    ))


def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id and text of one JSON file for each claim."""
    shape = F.col("claim_key") % 10
    own, other = contract_document(), converted_document()
    text = F.when(shape == 0, own).when(shape == 1, F.concat(F.lit("["), own, F.lit(", "), other, F.lit("]"))).when(shape == 2, F.concat(F.lit('{"claims": ['), other, F.lit(', 5, {"x": 1}, null]}'))).when(shape == 3, other)
    for k, (body, _) in REFUSED.items():
        text = text.when(shape == k, F.lit(body))
    return views.claims(spark, sf_dir).select(F.concat(F.lit("c"), "claim_id", F.lit(".json")).alias("file_id"), text.alias("text"))


#: Header fields that SRC1 tells, by path.
HEADER = (
    "claim_id", "transaction_type", "claim_details.place_of_service", "claim_details.facility_type_code", "claim_details.frequency_code", "claim_details.statement_from_date", "claim_details.statement_to_date",
    "claim_details.admission_date", "financial.claim_amount", "claim_totals.total_charges", "authorization.authorization_number", "provider.name", "provider.npi", "provider.taxonomy", "provider.tenure_days",
    "billing_provider.name", "billing_provider.npi", "billing_provider.taxonomy", "billing_provider.address.street", "billing_provider.address.city", "billing_provider.address.zip", "patient.name.first",
    "patient.date_of_birth", "patient.gender", "subscriber.member_id", "subscriber.first_name", "subscriber.date_of_birth", "payer.payer_id", "submitter.name", "submitter.id", "interchange.control_number",
)
_AMOUNT = "case when claim_amount <> 'abc' then rtrim(rtrim(claim_amount, '0'), '.') end"
_CLAIM_SQL = {
    "own": (
        "claim_id", "' '", "place_of_service", "facility_type_code", "null", "statement_from_date", "statement_to_date", "null", "claim_amount", "total_charges", "authorization_number", "concat('Provider ', npi)", "npi",
        "case when claim_key % 2 = 0 then '390200000X' end", "tenure_days", "null", "npi", "taxonomy", "null", "null", "null", "null", "date_of_birth", "null", "concat('M', o_custkey)", "null", "null", "null", "null", "null", "concat('0000', batch_id)",
    ),
    "other": (
        "claim_id", "'837P'", "place_of_service", "facility_type_code", "'1'", "statement_from_date", "statement_to_date", "null", _AMOUNT, _AMOUNT, "authorization_number", "'Clinic'", "npi", "taxonomy", "null", "'Clinic'", "npi", "taxonomy",
        "'1 Main St'", "null", "'62701'", "case when claim_key % 2 = 0 then 'Pat' else 'Sub' end", "case when claim_key % 2 = 0 then '2001-02-03' else date_of_birth end", "null", "concat('M', o_custkey)", "'Sub'", "date_of_birth", "'P1'", "'S'", "null", "concat('0000', batch_id)",
    ),
}


def _name(path: str) -> str:
    return path.replace(".", "_")


def _header_sql(kind: str, pos: int, shapes: str) -> str:
    if kind == "own":  # a name that is made from nothing is nothing, also in DuckDB
        values = [f"case when npi is not null then {v} end" if v.startswith("concat('Provider") else v for v in _CLAIM_SQL[kind]]
    else:
        values = list(_CLAIM_SQL[kind])
    return f"select concat('c', claim_id, '.json') as file_id, {pos} as pos, " + ", ".join(f"cast({v} as string) as {_name(p)}" for v, p in zip(values, HEADER, strict=True)) + f" from v_claim where claim_key % 10 in ({shapes})"


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_claims.normalised(json_claims.entries(json_files(spark, sf_dir))[0])


LINE = ("line_number", "date_of_service", "date_of_service_end", "place_of_service", "procedure_code", "charge_amount", "units", "tooth_number")


def converted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # outer: a plain explode would first filter claims by the size of their lines, and so read them three times
    rows = accepted(spark, sf_dir).where("transaction_type = '837P'").select("file_id", "pos", F.explode_outer("service_lines").alias("x")).where("x is not null")
    return rows.select("file_id", "pos", *(F.col(f"x.{c}") for c in LINE[:-1]), F.col("x.tooth_info.tooth_number").alias("tooth_number"))


_LINES_SQL = (
    "select concat('c', claim_id, '.json') as file_id, case when c.claim_key % 10 = 1 then 2 else 1 end as pos, cast(line_number as string) as line_number, date_of_service, date_of_service_end, "
    "case when line_number % 3 = 0 then c.place_of_service else l.place_of_service end as place_of_service, procedure_code, charge_amount, units, tooth_number from v_claim c join v_lines l on l.claim_key = c.claim_key where c.claim_key % 10 in (1, 2, 3)"
)
_REFUSED_SQL = " union all ".join(
    [f"select concat('c', claim_id, '.json') as file_id, cast(null as int) as pos, '{reason}' as reason from v_claim where claim_key % 10 = {k}" for k, (_, reason) in REFUSED.items()]
    + [f"select concat('c', claim_id, '.json'), {pos}, '{reason}' from v_claim where claim_key % 10 = 2" for pos, reason in ((2, "not a claim"), (3, "no claim found (expected a claim_id or claim field)"), (4, "not a claim"))]
)

#: Paths that references are made of: the contract's, some with an index, sections, replaced and unknown ones.
ASKED = [*json_claims.contract_paths(), *(p.replace("*", "3") for p in json_claims.contract_paths() if "*" in p), "patient", "billing_provider.address", "service_lines", "service_lines.0", "service_lines.*.tooth_info", *files.RENAMED, "service_lines.7.line_amount", "claim.npi", "patient.age", "service_lines.units", "2300.CLM.unknown", "diagnosis_codes.0.code.x", ""]
_UNKNOWN = [*files.RENAMED, "service_lines.7.line_amount", "claim.npi", "patient.age", "service_lines.units", "2300.CLM.unknown", "diagnosis_codes.0.code.x", ""]


def _quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.register(spark, sf_dir)
    return spark.sql(f"select p_partkey, element_at(array({_quoted(ASKED)}), cast(1 + p_partkey % {len(ASKED)} as int)) as path from part")


_HINT = "case " + " ".join(f"when path = '{a}' then '{b}'" for a, b in files.RENAMED.items()) + " when path = 'service_lines.7.line_amount' then 'service_lines.*.charge_amount' else 'none' end"


def register_queries(add) -> None:
    vs = ("v_claim", "v_lines", "v_dx")
    add("SRC1", lambda s, d: accepted(s, d).select("file_id", "pos", *(F.col(p).alias(_name(p)) for p in HEADER)), cte(" union all ".join([_header_sql("own", 1, "0, 1"), _header_sql("other", 2, "1"), _header_sql("other", 1, "2, 3")]), *vs))
    add("SRC1_refused", lambda s, d: json_claims.entries(json_files(s, d))[1], cte(_REFUSED_SQL, *vs))
    add("SRC7", converted_lines, cte(_LINES_SQL, *vs))
    add("P25", lambda s, d: files.contract_issues(references(s, d)), f"select p_partkey, path, {_HINT} as hint from (select p_partkey, [{_quoted(ASKED)}][cast(1 + p_partkey % {len(ASKED)} as int)] as path from part) where path in ({_quoted(_UNKNOWN)})")
