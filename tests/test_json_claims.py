"""JSON claim files: entries, refusals, and the projection to the claim contract."""

import json

import pytest
from pyspark.sql import functions as F

from claimlens.operators import predicates as p
from claimlens.operators import rules as R
from claimlens.sources import files, json_claims


def read(spark, *texts):
    rows = spark.createDataFrame([(str(k), t if isinstance(t, str) else json.dumps(t)) for k, t in enumerate(texts)], "file_id string, text string")
    good, bad = json_claims.entries(rows)
    return json_claims.normalised(good), bad


def test_shapes_and_refusals(spark):
    good, bad = read(
        spark, {"claim_id": "1"}, [{"claim_id": "2"}, 5, {"x": 1}, None], {"claims": 3}, "{bad", [], {"claims": [{"claim": {}}]}, {"rulesText": "r", "claims": []}, {"claims": []}, [1, "x"], 7,
        "null", {"claim": 5}, {"claim_id": None}, {"claims": None}, "", [[{"claim_id": 1}]],
    )
    assert sorted((r.file_id, r.pos) for r in good.collect()) == [("0", 1), ("1", 1), ("12", 1), ("5", 1)]
    assert sorted(((r.file_id, r.pos or 0, r.reason) for r in bad.collect()), key=lambda r: (int(r[0]), r[1])) == [
        ("1", 2, "not a claim"), ("1", 3, "no claim found (expected a claim_id or claim field)"), ("1", 4, "not a claim"), ("2", 0, '"claims" must be a list of claims'), ("3", 0, "not valid JSON"),
        ("4", 0, "the list of claims is empty"), ("6", 0, "an engine test request (rules and a list of claims), not a claims file"), ("7", 0, "the list of claims is empty"), ("8", 0, "none of the 2 entries is a claim"),
        ("9", 0, "not a claim"), ("10", 0, "not a claim"), ("11", 0, "no claim found (expected a claim_id or claim field)"), ("13", 0, '"claims" must be a list of claims'), ("14", 0, "not valid JSON"), ("15", 0, "none of the 1 entries is a claim"),
    ]


def test_converted_claims_are_flattened(spark):
    line = {"line_number": 1, "service_date": "20260301", "place_of_service": " ", "procedure_code": "99213", "charge_amount": "10", "units": "", "tooth_info": {"tooth_number": "3"}}
    doc = {
        "transaction_type": "837D", "billing_provider": {"npi": " ", "name": "Clinic", "taxonomy_code": "207X", "address": {"city": "S", "street": ""}},
        "claim": {"claim_id": "A", "total_charge_amount": "150.50", "place_of_service": "11", "dates": {"statement_from": "20260301"}, "subscriber": {"first_name": "Sam", "member_id": "M"}, "service_lines": [line, {"date_of_service": "x", "place_of_service": "21"}, 5]},
    }
    row = read(spark, doc)[0].first().asDict(recursive=True)
    assert row["claim_id"] == "A" and row["provider"] == {"name": "Clinic", "npi": None, "tax_id": None, "taxonomy": "207X", "tenure_days": None}
    assert row["financial"]["claim_amount"] == row["claim_totals"]["total_charges"] == "150.5"
    assert row["billing_provider"]["address"] == {"street": None, "city": "S", "state": None, "zip": None}
    assert row["patient"]["name"]["first"] == "Sam" and row["diagnosis_codes"] == []  # without a patient, the subscriber
    first, second, third = row["service_lines"]
    assert (first["line_number"], first["date_of_service"], first["place_of_service"], first["units"], first["tooth_info"]["tooth_number"]) == ("1", "20260301", "11", None, "3")
    assert (second["date_of_service"], second["place_of_service"]) == ("x", "21") and third["procedure_code"] is None
    other = read(spark, {"claim": {**doc["claim"], "patient": {"gender": "F"}, "total_charge_amount": 12}}, {"claim": {"total_charge_amount": "abc", "service_lines": None}})[0].orderBy("file_id").collect()
    assert (other[0].patient.gender, other[0].patient.name.first, other[0].financial.claim_amount) == ("F", None, "12")
    assert other[1].financial.claim_amount is None and other[1].service_lines == [] and other[1].claim_id is None


def test_projecting_twice_changes_nothing(spark):
    doc = {"transaction_type": "837P", "submitter": {"name": "S"}, "billing_provider": {"npi": "1"}, "claim": {"claim_id": "A", "total_charge_amount": "7.25", "subscriber": {"member_id": "M"}, "diagnosis_codes": [{"code": "Z00", "qualifier": "ABK"}], "service_lines": [{"units": "2", "service_date": "20260301"}]}}
    once, _ = read(spark, doc, {"claim_id": "B", "patient": {"gender": " "}, "service_lines": [{"units": "3"}]})
    again = json_claims.normalised(once.select("file_id", "pos", F.try_parse_json(F.to_json(F.struct(*(c for c in once.columns if c not in ("file_id", "pos", "doc"))))).alias("doc")))
    drop = lambda rows: [r.asDict(recursive=True) for r in rows.drop("doc").orderBy("file_id").collect()]
    assert drop(once) == drop(again) and drop(once)[1]["patient"]["gender"] == " "  # a claim in the contract keeps its values


def test_nothing_to_read(spark):
    good, bad = read(spark, "[]")
    assert good.count() == 0 and bad.count() == 1
    rows = spark.createDataFrame([], "file_id string, text string")
    assert json_claims.normalised(json_claims.entries(rows)[0]).count() == json_claims.entries(rows)[1].count() == 0


class Asked(R.Claim):
    """Notes every path that a rule's condition reads."""

    def __init__(self):
        super().__init__()
        self.paths = {"service_lines", "diagnosis_codes"}
        note = self.paths.add

        class Items(p.Items):
            def field(self, item, name):
                note(f"{self.path}.*.{name}")
                return super().field(item, name)

            def at(self, index, name):
                note(f"{self.path}.{index}.{name}")
                return super().at(index, name)

        self.lines, self.codes = Items("service_lines", F.col("service_lines")), Items("diagnosis_codes", F.col("diagnosis_codes"))

    def __call__(self, path):
        self.paths.add(path)
        return super().__call__(path)


def test_the_contract_knows_every_field_that_rules_read(spark):
    asked = Asked()
    for rule in R.RULES.values():
        rule.condition(asked)
    assert {"billing_provider.taxonomy", "claim_id", "claim_totals.service_line_total", "service_lines.*.tooth_info.tooth_number", "diagnosis_codes.0.code"} <= asked.paths
    assert files.contract_issues(spark.createDataFrame([(x,) for x in sorted(asked.paths)], "path string")).collect() == []


@pytest.mark.parametrize(("path", "hint"), [("2300.CLM.claim_amount", "financial.claim_amount"), ("service_lines.4.line_amount", "service_lines.*.charge_amount"), ("service_lines.units", "none"), ("claim", "none"), ("patient.name.first.x", "none"), ("subscriber.member_id", None), ("patient", None), ("service_lines.0", None), ("payer.payer_id", None)])
def test_contract(spark, path, hint):
    rows = files.contract_issues(spark.createDataFrame([(path, 1)], "path string, key int")).collect()
    assert [r.hint for r in rows] == ([] if hint is None else [hint])
