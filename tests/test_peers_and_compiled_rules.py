"""Rules in two levels, and providers beside their peers."""

import random

from pyspark.sql import functions as F

from claimlens.operators import peers
from claimlens.operators import rules as R


def claims(spark):
    rows = []
    for k in range(60):
        lines = None if k % 7 == 0 else [{"procedure_code": "99285" if k % 2 else None, "charge_amount": ["1", "x", None, "20000"][(k + j) % 4], "units": str(k % 3 - 1), "date_of_service": ["2024-01-06", "20240230", None][(k + j) % 3], "date_of_service_end": None, "place_of_service": "11"} for j in range(k % 4)]
        rows.append({"claim_key": k, "financial": {"claim_amount": ["60000", "3", "n/a", None, "600"][k % 5]}, "service_lines": lines, "extra": k})
    line = "struct<procedure_code:string,charge_amount:string,units:string,date_of_service:string,date_of_service_end:string,place_of_service:string>"
    return spark.createDataFrame(rows, f"claim_key int, financial struct<claim_amount:string>, service_lines array<{line}>, extra int")


OWN = ["R1", "R4", "R9", "R10", "R14", "R17"]


def test_compiled_rules_say_what_each_says_alone(spark):
    table, rules = claims(spark), [R.RULES[k] for k in OWN]
    claim = R.Claim(as_of="2024-01-06")
    whole = {r.claim_key: r for r in R.evaluate(table, rules, claim).collect()}
    assert len(whole) == 60 and all(r.extra == r.claim_key for r in whole.values())
    for k, rule in enumerate(rules):
        alone = rule.condition(R.Claim(as_of="2024-01-06"))
        for r in table.select("claim_key", alone.truth.alias("t"), alone.reasons.alias("why")).collect():
            x = whole[r.claim_key].results[k]
            assert (x.rule_name, x.matched, x.undecided, x.reasons) == (rule.name, r.t or False, r.t is None, r.why)
    header = ["claim_key", "total_rules", "matched_rules", "undecided_rules", "overall_risk", "weighted_score", "summary"]
    assert {r.claim_key: tuple(r) for r in R.counters(table, rules, claim).select(*header).collect()} == {k: tuple(r[c] for c in header) for k, r in whole.items()}
    said = {(r.claim_key, r.rule_name): (r.matched, r.undecided) for r in R.truths(table, rules, claim).collect()}
    assert said == {(k, x.rule_name): (x.matched, x.undecided) for k, r in whole.items() for x in r.results}
    assert {r.claim_key: r.rules for r in R.matched(table, rules, claim).collect()} == {k: sorted(x.rule_name for x in r.results if x.matched) for k, r in whole.items()}


def test_a_field_is_parsed_once_however_many_rules_read_it(spark):
    table = claims(spark)
    rules = [R.RULES[k] for k in OWN] * 34
    plan = R.counters(table, rules, R.Claim(as_of="2024-01-06"))._jdf.queryExecution().analyzed().toString()
    one = R.counters(table, rules[:6], R.Claim(as_of="2024-01-06"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("_number_financial_claim_amount") > one.count("_number_financial_claim_amount")
    parsed = lambda text: text.count("AS _number_financial_claim_amount")
    assert parsed(plan) == parsed(one) == 1
    assert R.counters(table, rules, R.Claim(as_of="2024-01-06")).where("total_rules = 204").count() == 60


def test_no_rules_and_no_claims(spark):
    assert R.truths(claims(spark).limit(0), [R.RULES["R14"]]).count() == 0
    assert [r.total_rules for r in R.counters(claims(spark).limit(1), []).collect()] == [0]
    assert R.truths(claims(spark), []).count() == 0


def percent_rank(values, v):
    return sum(x < v for x in values) / (len(values) - 1) if len(values) > 1 else 0.0


def test_percentiles_against_plain_ranks(spark):
    told = random.Random(3)
    rows = []
    for k in range(3000):  # a hot group with a third of the rows, many ties, a group of one, null groups
        group = ("hot", None) if k % 3 == 0 else (told.choice(["a", None]), told.choice([1, 2]))
        rows.append((k, *group, "x", float(told.choice([0, 0, 0, 1, told.random(), told.randrange(50)]))))
    rows.append((3000, "lone", 9, "x", 5.0))
    values = spark.createDataFrame(rows, "provider int, specialty string, state int, feature string, value double")
    groups = {}
    for _, a, b, _, v in rows:
        groups.setdefault((a, b), []).append(v)
    for parts in (2, 16):
        got = peers.percentiles(values, ["specialty", "state"], parts).collect()
        assert len(got) == len(rows)
        for r in got:
            own = sorted(groups[r.specialty, r.state])
            n = len(own)
            assert r.peers == n and abs(r.percentile - percent_rank(own, r.value)) < 1e-12
            assert abs(r.peer_median - (own[(n - 1) // 2] + own[n // 2]) / 2) < 1e-12
    for r in peers.sketched(values, ["specialty", "state"], 50, 1000).collect():
        own = groups[r.specialty, r.state]
        assert abs(r.percentile - percent_rank(own, r.value)) <= 1 / 50 + 1 / 1000 + 1 / max(1, len(own) - 1)


def test_features_by_hand(spark):
    services = [
        (1, 10, 7, "99215", 5, 1000), (1, 10, 7, "A", 5, 500), (1, 11, 8, "A", 6, 300), (1, 12, 8, None, 6, 200), (1, 13, None, "B", 9, 0), (1, 14, 8, "B", None, 0),
        (2, 20, None, None, 3, 100),
    ]
    lines = spark.createDataFrame(services, "provider int, claim_key int, patient int, code string, month int, cents long")
    who = spark.createDataFrame([(1, 30, "s"), (2, None, None), (3, 1, "s")], "provider int, tenure_days int, specialty string")
    got = {r.provider: r for r in peers.features(lines, who).collect()}
    assert set(got) == {1, 2} and got[2].specialty is None
    assert tuple(got[1][c] for c in peers.FEATURES) == (2.0, 3.0, 2000 / 6 / 100, 1.0, 1 / 6, 3.0, 2 / 6, 30.0)
    assert tuple(got[2][c] for c in peers.FEATURES) == (0.0, None, 1.0, None, 0.0, 0.0, None, None)
    assert peers.tall(peers.features(lines, who).withColumn("region", F.lit(1)), ["specialty", "region"]).count() == 12
    assert peers.percentiles(peers.tall(peers.features(lines.limit(0), who), ["specialty"]), ["specialty"]).count() == 0
