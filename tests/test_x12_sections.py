"""X12 files are judged where their rows are, and ordered by sections, not by segments."""

from claimlens import catalog
from claimlens.sources import x12

SF = "/root/testdata/sf0.001"
ISA = "ISA*00*          *00*          *ZZ*TESTSUBMIT01   *ZZ*STMED01        *261016*1200*^*00501*000000101*0*T*:"


def windows(name, spark):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    return sum("- Window [" in x or x.lstrip(" :+-").startswith("Window [") for x in plan), plan


def test_envelopes_are_judged_without_ordering_segments(spark):
    for name in ("X1", "X13"):
        n, plan = windows(name, spark)
        assert n == 0 and not [x for x in plan if "posexplode" in x or "Sort [file_id" in x]


def test_parties_are_told_over_sections(spark):
    for name in ("X3", "X5", "X6", "X7", "X8", "X9", "X11"):
        n, plan = windows(name, spark)
        assert n <= 2 and not [x for x in plan if "SortAggregate" in x or "lx_no" in x and "Sort [" in x]


def test_lines_are_told_once(spark):
    plan = catalog.QUERIES["X11"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "inline" in plan and not [x for x in plan.splitlines() if "Filter " in x and "size(" in x]


def test_first_errors_and_sections_of_odd_files(spark):
    text = lambda *segs: ISA + "~" + "~".join(segs) + "~"
    gs, ge, iea = "GS*HC*A*B*20261016*1200*101*X*005010X222A1", "GE*1*101", "IEA*1*000000101"
    files = {
        "open": (text(gs, "ST*837*1*x", "ST*837*2*x", "SE*2*2", "GE*2*101", iea), "Incomplete transmission: ST before the open one is closed"), "outside": (text("ST*837*1*x", "SE*2*1", iea), "ST outside a functional group"),
        "sets": (text(gs, "ST*837*1*x", "SE*2*1", "GE*2*101", iea), "GE says 2 transaction sets"), "end": (text(gs, "ST*837*1*x", "SE*9*1", ge), "Incomplete transmission: the last segment is not IEA"),
        "set id": (text(gs, "ST*837*1*x", "SE*2*7", ge, "IEA*1*999"), "Transaction set control number mismatch"),
        "fine": (text(gs, "ST*837*1*x", "HL*1**20*1", "NM1*85*2*ONE", "CLM*A*1", "N3*LATE", "NM1*85*2*TWO", "LX*1", "SV1*HC:1*1", "CLM*B*2", "SE*10*1", ge, iea), None),
    }
    rows = spark.createDataFrame([(k, x) for k, (x, _) in files.items()], "file_id string, text string")
    assert {r.file_id: r.reason for r in x12.envelope_errors(rows).collect()} == {k: e for k, (_, e) in files.items() if e}
    got = {r.claim_id: r for r in x12.claims(rows).collect()}
    # what a claim's own segments say of a party isn't told before it, nor in place of what its loop said first
    assert {k: (r.ts_no, r.billing_provider.name, r.billing_provider.address.street) for k, r in got.items()} == {"A": (1, "ONE", None), "B": (1, "ONE", None)}
    assert got["A"].service_lines[0].procedure_code == "1" and got["B"].service_lines is None
