"""Rules held against each other by classes: the same pairs as rule by rule, and no table of nodes sent to every task."""

import random

from pyspark.sql import functions as F

from claimlens import catalog
from claimlens.operators import conditions, overlap

SF = "/root/testdata/sf0.001"


def library(spark):
    pick, rows = random.Random(5), []
    for k in range(40):
        for field in pick.sample(["f", "g"], pick.choice([1, 1, 2])):
            low, width = pick.randrange(4), pick.randrange(3)
            rows.append((f"r{k}", "", field, float(low), pick.random() < 0.3, float(low + width), False, None))
    constraints = spark.createDataFrame(rows, "rule string, scope string, field string, low double, low_open boolean, high double, high_open boolean, text string")
    leaf = F.to_json(F.struct("scope", "field", "low", "low_open", "high", "high_open"))
    conjuncts = constraints.select("rule", F.when(F.col("field") == "f", 0).otherwise(1).alias("conjunct"), leaf.alias("leaf"), "scope", "field", "low", "low_open", "high", "high_open")
    rules = constraints.groupBy("rule").agg(F.to_json(F.array_sort(F.collect_list(F.struct("field", "low", "low_open", "high")))).alias("condition")).withColumn("outcome", F.when(F.col("rule").endswith("3"), "R").otherwise("Q"))
    said = {}
    for rule, _, field, low, open_, high, _, _ in rows:
        said.setdefault(rule, {})[field] = (low, open_, high)
    return rules, conjuncts, constraints, said


def test_levels_of_classes_are_those_of_each_pair(spark):
    rules, conjuncts, constraints, said = library(spark)
    outcome = {r.rule: r.outcome for r in rules.collect()}
    inside = lambda p, q: (p[0] > q[0] or (p[0] == q[0] and (not q[1] or p[1]))) and p[2] <= q[2]
    implies = lambda a, b: all(f in said[a] and inside(said[a][f], x) for f, x in said[b].items())

    def meets(a, b):
        shared = [(said[a][f], said[b][f]) for f in said[a] if f in said[b]]
        ok = [max(x[0], y[0]) < min(x[2], y[2]) or (max(x[0], y[0]) == min(x[2], y[2]) and not any(z[1] and z[0] == max(x[0], y[0]) for z in (x, y))) for x, y in shared]
        return bool(ok) and all(ok)

    want = {}
    for a in said:
        for b in said:
            if a < b:
                equal = outcome[a] == outcome[b]
                if said[a] == said[b]:
                    want[a, b] = "ExactDuplicate" if equal else "Shadowed"
                elif implies(a, b) or implies(b, a):
                    want[a, b] = "Subsumption" if equal else "Shadowed"
                elif meets(a, b):
                    want[a, b] = "ConditionOverlap"
    assert len(set(want.values())) == 4
    assert sorted((r.a, r.b, r.level) for r in overlap.levels(rules, conjuncts, constraints).collect()) == sorted((a, b, x) for (a, b), x in want.items())
    assert sorted(map(tuple, overlap.implied(conjuncts).collect())) == sorted((a, b) for a in said for b in said if a != b and implies(a, b))
    assert sorted(map(tuple, overlap.overlapping(overlap.intervals(constraints)).collect())) == sorted((a, b) for a in said for b in said if a < b and meets(a, b))
    tiers = [overlap.TIERS[x] for x in want.values()]
    assert {r.tier: r.n for r in overlap.tiers(rules, conjuncts, constraints).collect()} == {t: tiers.count(t) for t in tiers}
    assert {r.a: r.n_pairs for r in overlap.partners(rules, conjuncts, constraints).collect()} == {a: n for a in said if (n := sum(x == a for x, _ in want))}
    assert {r.rule for r in overlap.faulty(rules, conjuncts, constraints).collect()} == {x for pair, level in want.items() if overlap.TIERS[level] != "overlap" for x in pair}


def test_nodes_of_conditions_are_not_broadcast(spark):
    rows = catalog.QUERIES["V1"](spark, SF), conditions.digests(conditions.table(spark, {"a": ("and", ("cmp", ">", "f", 1.0), ("not", ("cmp", ">", "f", 9.0)))}))
    for x in rows:
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "BroadcastHashJoin" not in plan


def test_duplicates_name_their_condition(spark):
    found = catalog.QUERIES["V5"](spark, "/root/testdata/sf0.01")
    assert found.columns == ["condition", "outcome", "n", "first_rule"]
    assert all(r.condition.startswith("Brand#") and r.condition.count(":") == 3 for r in found.collect())
