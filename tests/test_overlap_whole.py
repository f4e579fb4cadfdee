"""Overlap of rules is their whole job: items' fields count, conjuncts are told one by one, and no pairs are shuffled."""

import itertools

from pyspark.sql import functions as F

from claimlens import catalog
from claimlens.operators import conditions, overlap
from claimlens.operators import predicates as p
from claimlens.operators import rules as R

SF = "/root/testdata/sf0.001"


def told(spark, **made):
    return conditions.summaries(conditions.table(spark, {k: f(R.Claim()).tree for k, f in made.items()}))


def bounded(rows):
    return overlap.intervals(rows.select("rule", F.inline("constraints")))


def test_fields_of_items_make_overlaps_and_rule_none_out(spark):
    code = lambda c, x: c.any_line(lambda f: p.equal_text(f("procedure_code"), x))
    rows = told(spark, a=lambda c: p.greater(c.amount, 5) & code(c, "1"), b=lambda c: p.greater(c("provider.tenure_days"), 5) & code(c, "1"), c=lambda c: p.less(c.amount, 5) & code(c, "1"), d=lambda c: p.greater(c.amount, 7) & code(c, "2"))
    assert sorted(map(tuple, overlap.overlapping(bounded(rows)).collect())) == [("a", "b"), ("a", "d"), ("b", "c")]


def test_registered_overlaps_are_whole(spark):
    parts = {str(r.p_partkey): (r.p_brand, float(r.p_size), r.p_partkey % 2 == 0, float(r.p_size + r.p_partkey % 7)) for r in spark.read.parquet(f"{SF}/part.parquet").collect()}

    def meets(a, b):  # all rules hold the same field of a line
        low, high = max(a[1], b[1]), min(a[3], b[3])
        return a[0] != b[0] or low < high or (low == high and not any(x[2] and x[1] == low for x in (a, b)))

    want = {(a, b) for a, b in itertools.combinations(sorted(parts), 2) if meets(parts[a], parts[b])}
    assert {tuple(r) for r in catalog.QUERIES["V3"](spark, SF).collect()} == want
    levels = {(r.a, r.b): r.tier for r in catalog.QUERIES["V6"](spark, SF).collect()}
    assert want <= levels.keys()
    assert {r.tier: r.n for r in catalog.QUERIES["A13"](spark, SF).collect()} == {t: list(levels.values()).count(t) for t in set(levels.values())}


def test_every_conjunct_must_be_implied(spark):
    null = lambda c: p.is_null(c("patient.gender"))
    rows = told(
        spark, a=lambda c: p.greater(c.amount, 10), b=lambda c: p.greater(c.amount, 5) & null(c), c=lambda c: p.greater(c.amount, 10) & ~~null(c), d=lambda c: p.greater(c.amount, 5) | null(c),
        e=lambda c: p.between(c.amount, 6, 8), f=lambda c: p.at_least(c.amount, 6) & p.at_most(c.amount, 8), g=null, h=lambda c: p.equal_number(c.amount, 7),
    )
    got = {tuple(r) for r in overlap.implied(rows.select("rule", F.inline("conjuncts"))).collect()}
    assert got == {("a", "d"), ("b", "d"), ("b", "g"), ("c", "a"), ("c", "b"), ("c", "d"), ("c", "g"), ("e", "d"), ("e", "f"), ("f", "d"), ("f", "e"), ("g", "d"), ("h", "d"), ("h", "e"), ("h", "f")}


def test_rules_without_bounds_have_levels(spark):
    null = lambda c: p.is_null(c("patient.gender"))
    rows = told(spark, a=null, b=lambda c: null(c) & p.greater(c.amount, 5), c=lambda c: ~~null(c), d=lambda c: ~null(c), e=lambda c: null(c) & p.is_null(c.amount))
    found = overlap.levels(rows.select("rule", "condition", F.when(F.col("rule") == "e", "R").otherwise("Q").alias("outcome")), rows.select("rule", F.inline("conjuncts")), rows.select("rule", F.inline("constraints")))
    assert {(r.a, r.b): r.level for r in found.collect()} == {("a", "b"): "Subsumption", ("a", "c"): "ExactDuplicate", ("b", "c"): "Subsumption", ("a", "e"): "Shadowed", ("c", "e"): "Shadowed"}


def test_summaries_are_what_the_joins_tell(spark):
    nodes = conditions.table(spark, {k: R.RULES[k].condition(R.Claim()).tree for k in R.RULES})
    rows = conditions.summaries(nodes).persist()
    assert sorted(map(tuple, rows.select("rule", "condition").collect())) == sorted(map(tuple, conditions.digests(nodes).collect()))
    assert sorted(map(str, rows.select("rule", F.inline("constraints")).collect())) == sorted(map(str, conditions.constraints(nodes).select("rule", *conditions.CONSTRAINT).collect()))


def test_pairs_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(overlap, "BLOCK", 8)
    for name in ("V3", "V4", "V6"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
        at = next(i for i, x in enumerate(plan) if "SortMergeJoin [value" in x)
        assert not [x for x in plan[:at] if "Exchange" in x]
