"""Patterns, places of codes, correlated quantifiers, and conditions as data."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from claimlens.operators import conditions
from claimlens.operators import predicates as p
from claimlens.operators import rules as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


VALUES = ["AF09", "12 3", "1\t3", "xyz", "xyz\n", "q", "q\n", "", "\x01", "\x7f", "a]b", "a-b", "a^b", "a\\b", "é", "a.b", "aXb", "a\nb", "aaa", "aaaa", "{", "a{2}", "A_1", "&&", "[x", "ab" * 3, "~", " ", "x|y"]
PATTERNS = {
    "^[[:xdigit:]]+$": r"\A[0-9A-Fa-f]+\Z", "[[:blank:]]": "[ \t]", "(xyz$)|(q$)": r"(xyz\Z)|(q\Z)", "[[:cntrl:]]": "[\x00-\x1f\x7f]", "^[[:graph:]]+$": r"\A[!-~]+\Z", "^[[:print:]]*$": r"\A[ -~]*\Z",
    "^[[:alpha:]]{3}$": r"\A[A-Za-z]{3}\Z", "[^[:alnum:]_]": "[^A-Za-z0-9_]", "[]x]": r"[\]x]", "[^]a-z]": r"[^\]a-z]", "a[-^]b": r"a[\-^]b", "[\\]b": r"[\\]b", "a.b": r"a[\s\S]b", "a\\.b": r"a\.b",
    "^a**$": r"\A(?:a*)*\Z", "^(ab)+$": r"\A(?:ab)+\Z", "^a{2,3}$": r"\Aa{2,3}\Z", "^a{4,}$": r"\Aa{4,}\Z", "[[:punct:]]": r"[!-/:-@\[-`{-~]", "[&][&]": "&&", "[[]x": r"\[x", "(^a|b$)": r"(\Aa|b\Z)",
    "^[[:word:]]+$": r"\A[A-Za-z0-9_]+\Z", "^[[:space:]]$": r"\A[ \t\n\v\f\r]\Z", "x\\|y": r"x\|y", "{": r"\{", "^$": r"\A\Z", "[A-F[:digit:]]": "[A-F0-9]", "a\\{2": r"a\{2",
}


@pytest.mark.parametrize("posix", PATTERNS)
def test_patterns(spark, posix):
    rows = spark.createDataFrame([(v,) for v in VALUES], "v string")
    got = [r[0] for r in rows.select(p.matches(p.Field("v", F.col("v")), posix).truth).collect()]
    assert got == [re.search(PATTERNS[posix], v) is not None for v in VALUES]


@pytest.mark.parametrize("posix", ["[[:letter:]]", "[[:alpha:]", "[a", "(a", "[z-a]", "*a", "(?:a)", "\\d", "a\\", "a{x}", "[[.a.]]", "a{3"])
def test_unknown_patterns_are_refused(posix):
    with pytest.raises(ValueError):
        p.java_pattern(posix)


def test_procedures_in_three_places(spark):
    line = "array<struct<procedure_code:string>>"
    rows = [([("A",)], None, None, True), (None, [("A",)], None, True), (None, None, "A", True), (None, None, None, None), ([], [], None, None), ([("B",)], [("C",)], "D", False), ([], None, "B", False), ([(None,)], None, None, False), ([("B",)], None, "A", True)]
    claims = spark.createDataFrame([(*r[:3], k) for k, r in enumerate(rows)], f"procedure_codes array<struct<code:string>>, service_lines {line}, procedure_code string, k int").withColumn("diagnosis_codes", F.lit(None).cast("array<struct<code:string>>"))
    pred = R.Claim(sections=frozenset({"procedure_codes", "procedure_code"})).has_procedure("A")
    got = claims.orderBy("k").select(pred.truth.alias("t"), pred.reasons.alias("r")).collect()
    assert [r.t for r in got] == [r[3] for r in rows]
    assert [bool(r.r) for r in got] == [r[3] is None for r in rows]
    alone = R.Claim().has_procedure("A")  # a table without the other places
    assert [r[0] for r in claims.orderBy("k").select(alone.truth).collect()] == [None, True, None, None, None, False, None, None, None]


def test_inner_items_against_outer_ones(spark):
    rows = spark.createDataFrame([([("1", "x"), ("5", "y")],), ([("5", "x"), ("1", "y")],), ([("5", "x"), (None, "y")],), ([],), ([("7", "x")],)], "service_lines array<struct<n:string,k:string>>").withColumn("diagnosis_codes", F.lit(None).cast("array<struct<code:string>>"))
    c = R.Claim()
    dearer = c.any_line(lambda f: p.equal_text(f("k"), "x") & c.any_line(lambda g: p.greater(g("n"), f("n"))))
    assert [r[0] for r in rows.select(dearer.truth).collect()] == [True, False, None, None, False]
    every = c.every_line(lambda f: c.any_line(lambda g: p.less(g("n"), f("n")) | p.equal_text(g("k"), f("k"))))
    assert [r[0] for r in rows.select(every.truth).collect()] == [True, True, True, None, True]


def trees(**made):
    c = R.Claim()
    return {k: f(c).tree for k, f in made.items()}


def told(spark, by_name):
    return {r.rule: r.digest for r in conditions.digests(conditions.table(spark, by_name)).collect()}


def test_conditions_in_another_order_have_one_digest(spark):
    a, b, d = (lambda c: p.greater(c.amount, 5)), (lambda c: p.is_null(c("patient.gender"))), (lambda c: c.any_line(lambda f: p.equal_text(f("units"), "1") & p.less(f("charge_amount"), 3)))
    d2 = lambda c: c.any_line(lambda f: p.less(f("charge_amount"), 3) & p.equal_text(f("units"), "1"))
    same = {f"s{k}": (lambda c, x=x: x[0](c) & (x[1](c) & x[2](c))) for k, x in enumerate(itertools.permutations((a, b, d)))}
    same |= {"t1": lambda c: (b(c) & d2(c)) & a(c), "t2": lambda c: a(c) & b(c) & d(c) & a(c), "t3": lambda c: ~~(a(c) & b(c)) & ~~d2(c), "t4": lambda c: ~~~~(b(c) & d(c)) & a(c)}
    got = told(spark, trees(**same))
    assert len(got) == len(same) and len(set(got.values())) == 1
    other = {
        "o0": lambda c: a(c) | b(c) | d(c), "o1": lambda c: a(c) & b(c) & ~d(c), "o2": lambda c: a(c) & b(c), "o3": a, "o4": lambda c: ~a(c), "o5": lambda c: p.at_least(c.amount, 5), "o6": lambda c: p.greater(c.amount, 6), "o7": lambda c: a(c) & (b(c) | d(c)), "o8": lambda c: (a(c) & b(c)) | d(c),
        "o9": lambda c: c.every_line(lambda f: p.equal_text(f("units"), "1") & p.less(f("charge_amount"), 3)), "o10": lambda c: p.equal_text(c.amount, "5"), "o11": lambda c: p.equal_number(c.amount, 5), "o12": lambda c: ~(a(c) & b(c)), "o13": lambda c: ~a(c) & ~b(c),
        "o14": lambda c: c.any_line(lambda f: c.any_line(lambda g: p.greater(f("n"), g("n")))), "o15": lambda c: c.any_line(lambda f: c.any_line(lambda g: p.greater(g("n"), f("n")))), "o16": lambda c: p.always(True), "o17": lambda c: p.always(False),
    }
    got |= told(spark, trees(**other))
    assert len(set(got.values())) == 1 + len(other)
    assert told(spark, trees(x=lambda c: a(c) | a(c), y=a, z=lambda c: ~~a(c))) == dict.fromkeys("xyz", got["o3"])
    assert told(spark, {k: R.RULES[k].condition(R.Claim()).tree for k in R.RULES}).keys() == R.RULES.keys()
    assert conditions.digests(conditions.table(spark, trees(x=a)).limit(0)).collect() == []


def test_constraints_of_the_rules(spark):
    rows = conditions.constraints(conditions.table(spark, {k: R.RULES[k].condition(R.Claim()).tree for k in R.RULES})).collect()
    got = {(r.rule, r.scope, r.field): (r.low, r.low_open, r.high, r.high_open, r.text) for r in rows}
    amount = "financial.claim_amount"
    assert got["R14", "", amount] == (50000.0, True, None, False, None) and got["R17", "", amount] == (None, False, 5.0, True, None)
    assert got["R13", "service_lines", "service_lines#0.place_of_service"] == (None, False, None, False, "11") and got["R13", "", amount][0] == 500.0
    assert got["R16", "", "provider.tenure_days"] == (None, False, 90.0, True, None)
    # under OR and NOT nothing is known, nor of fields compared with fields
    assert not [k for k in got if k[0] in ("R1", "R2", "R3", "R5", "R9", "R12", "R27")]
    assert {k for k in got if k[0] == "R26"} == set()  # lists bound nothing
    made = conditions.constraints(conditions.table(spark, trees(x=lambda c: p.between(c.amount, 1, 9) & ~p.greater(c.amount, 3) & (p.less(c.amount, 4) | p.less(c.amount, 5)) & p.compare(c.amount, lambda a, b: a != b, 7)))).collect()
    assert [(r.low, r.high, r.low_open, r.high_open) for r in made] == [(1.0, 9.0, False, False)]
