"""Registered queries on the smallest given tables: they run, and do their whole job."""

from claimlens import catalog
from claimlens.plans import views
from claimlens.sources import x12

SF = "/root/testdata/sf0.001"


def test_rule_files_of_the_catalogue(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet")
    n = parts.count()
    assert catalog.QUERIES["SRC8"](spark, SF).count() == parts.where("p_partkey % 3 <> 0 and p_partkey % 7 <> 0").count()
    assert catalog.QUERIES["PRJ6"](spark, SF).where("inner_name <> 'none'").count() == parts.where("p_partkey % 7 <> 0").count() < n
    texts = {r.p_name: r["count"] for r in parts.where("p_partkey % 3 <> 0").groupBy("p_name").count().collect()}
    assert {r.name: r.n_texts for r in catalog.QUERIES["J8"](spark, SF).collect()} == {r.p_name: texts.get(r.p_name, 0) for r in parts.select("p_name").distinct().collect()}


def test_x12_files_are_read_once_and_in_one_order(spark):
    plan = lambda name: catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    assert sum("Generate posexplode" in x for x in plan("X9")) == 1
    assert sum("Sort [" in x and "seg_no" in x for x in plan("X10")) == 1


def test_reports_without_results_make_no_reasons(spark):
    plan = lambda name: catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    for name in ("P19", "PRJ4", "D1_all", "D3_all", "A7"):
        assert "_reasons" not in plan(name)
    # rules are judged where their truths are made, not in a filter below
    assert not [x for x in plan("P23").splitlines() if "Filter" in x and "_truths" in x or "Filter" in x and "_number_" in x]


def test_claims_are_dealt_by_their_number_whatever_the_session_says(spark, monkeypatch):
    monkeypatch.setattr(views, "TASK_CLAIMS", 100)
    n = -(-spark.read.parquet(f"{SF}/orders.parquet").count() // 100)
    for name in ("X1", "X10", "SRC7"):
        dealt = [x for x in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
        assert dealt and all(f", {n}), REPARTITION_BY_NUM" in x for x in dealt)


def test_claims_go_to_their_files_once_and_without_what_their_keys_tell(spark, monkeypatch):
    monkeypatch.setattr(views, "TASK_CLAIMS", 100)
    for name in ("X3", "X4", "X5", "X6", "X7", "X8", "X12"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
        dealt = [i for i, x in enumerate(plan) if "Exchange hashpartitioning(" in x and "o_custkey" in x]
        assert len(dealt) == 1 and not [x for x in plan[: dealt[0]] if "Exchange hashpartitioning(file_id" in x]
        sent = plan[dealt[0] + 1]
        assert "Project [" in sent and " AS text#" in sent and not [c for c in ("file_id", "kind", "st", "member_id") if f"{c}#" in sent.replace("list#", "")]


def test_parties_that_nobody_reads_are_not_told(spark):
    claims = x12.claims(spark.createDataFrame([("a", "ISA")], "file_id string, text string"))
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    assert "DMG" in plan(claims.select("patient.gender")) and "DMG" not in plan(claims.select("claim_id", "claim_details"))
    # where a claim's segments are ordered, its parties stand on its own segment alone
    below = plan(claims.select("patient.gender")).split("Sort [file_id", 1)[1].splitlines()[1]
    assert "CASE WHEN (seg_id" in below and "= CLM) THEN" in below


def test_lists_of_json_claims_are_read_once(spark):
    plan = catalog.QUERIES["SRC7"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.claim.service_lines") == 1 and "schema_of_variant" not in plan
