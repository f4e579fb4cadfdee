"""Claims engine: truth tables, rules, providers, duplicates, X12, policy and overlap on small tables."""

import pytest
from pyspark.sql import functions as F

from claimlens.functions import text as tx
from claimlens.operators import ingest, overlap, policy, providers
from claimlens.operators import predicates as p
from claimlens.operators import rules as R
from claimlens.sources import files, x12
from claimlens.streaming import ingest as stream

ISA = "ISA*00*          *00*          *ZZ*TESTSUBMIT01   *ZZ*STMED01        *261016*1200*^*00501*000000101*0*T*:~"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("5", 5.0), (" 5", 5.0), ("5 ", None), (".5", None), ("+5", None), ("5d", None), ("NaN", None), ("1e400", None), ("6.5e4", 65000.0), ("-3.25", -3.25)])
def test_to_number(spark, text, want):
    assert one(spark, tx.to_number(F.lit(text))) == want


def test_scalars(spark):
    assert [one(spark, tx.number_text(F.lit(x))) for x in (65000.0, 0.5, 12.25)] == ["65000", "0.5", "12.25"]
    assert [str(one(spark, tx.to_day(F.lit(x)))) for x in (" 2026-03-10 ", "20260310", "2026-03-10T01:02:03", "2026-02-30")] == ["2026-03-10"] * 3 + ["None"]
    assert one(spark, tx.age_on(F.lit("2000-02-29").cast("date"), F.lit("2026-02-28").cast("date"))) == 25
    assert [one(spark, tx.is_valid_npi(F.lit(x))) for x in ("1003000118", "1234567890", "123456789")] == [True, False, False]
    assert one(spark, tx.is_weekend(F.lit("2026-11-28").cast("date"))) and one(spark, tx.money_prefix(F.lit("12abc"))) == 12.0


def test_three_valued_logic(spark):
    rows = spark.createDataFrame([("5",), (None,), ("x",)], "v string")
    f, t, n = p.Field("v", F.col("v")), p.always(True), p.always(False)
    for pred, want in ((p.greater(f, 3), [True, None, None]), (p.greater(f, 3) | t, [True] * 3), (p.greater(f, 3) & n, [False] * 3), (~p.greater(f, 3), [False, None, None])):
        assert [r[0] for r in rows.select(pred.truth).collect()] == want
    assert [r[0] for r in rows.select((p.greater(f, 3) & p.less(f, 9)).reasons).collect()] == [[], ["v missing"], ["v is not a number"]]


def test_quantifiers(spark):
    rows = spark.createDataFrame([([("1",), (None,)],), ([],), (None,), ([("0",)],)], "c array<struct<n:string>>")
    items = p.Items("c", F.col("c"))
    some, every = (q(items, lambda x: p.greater(items.field(x, "n"), 0)) for q in (p.exists, p.for_all))
    assert [r[0] for r in rows.select(some.truth).collect()] == [True, None, None, False]
    assert [r[0] for r in rows.select(every.truth).collect()] == [None, None, None, False]
    assert [r[0] for r in rows.select(every.reasons).collect()] == [["c[].n missing"], ["c missing or empty"], ["c missing or empty"], []]


def test_provider_checks(spark):
    registry = spark.createDataFrame([("1", "2007-01-01", None, None, None), ("2", "2007-01-01", "2008-01-09", "2009-07-10", None), ("3", None, None, None, "2020-01-01")], "npi string, e string, d string, r string, o string")
    registry = registry.select("npi", *(F.col(a).cast("date").alias(b) for a, b in (("e", "enumeration_date"), ("d", "deactivation_date"), ("r", "reactivation_date"), ("o", "dropped_on"))))
    days = ["2006-12-31", "2008-01-09", "2008-01-10", "2009-07-10", "2020-01-01"]
    pairs = spark.createDataFrame([(n, d) for n in ("1", "2", "3", "4") for d in days], "npi string, d string").select("npi", F.col("d").cast("date").alias("day"))
    got = {(r.npi, str(r.day)): r.why for r in providers.lookup(pairs, registry).select("npi", "day", providers.problem(F.col("npi"), F.col("day")).alias("why")).collect()}
    assert "not issued until" in got["1", days[0]] and got["1", days[1]] is None
    assert [bool(got["2", d]) for d in days] == [True, False, True, False, False]
    assert "has not been in the NPPES file since" in got["3", days[4]] and "not found" in got["4", days[0]]
    claims = spark.createDataFrame([(1,), (2,)], "claim_key long")
    npis = spark.createDataFrame([(1, 0, "1"), (1, 1, "4")], "claim_key long, npi_pos int, npi string")
    found = providers.findings(claims, npis, spark.createDataFrame([(1, "2010-01-01")], "claim_key long, d string").select("claim_key", F.col("d").cast("date").alias("day")), registry)
    assert {r.claim_key: r.reason for r in found.collect()} == {1: "NPI 4 not found in NPPES registry", 2: providers.NO_DATES}


def test_upsert_lets_new_nulls_win(spark):
    old = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "k string, x int, y int")
    new = spark.createDataFrame([("a", None, 9), ("c", 5, 6)], "k string, x int, y int")
    assert sorted(map(tuple, providers.upsert(old, new, "k").collect())) == [("a", None, 9), ("b", 3, 4), ("c", 5, 6)]
    assert sorted(map(tuple, providers.upsert(old, new, "k", ["y"]).collect())) == [("a", 1, 9), ("b", 3, 4), ("c", 5, 6)]


def test_duplicate_tiers(spark):
    entries = spark.createDataFrame([(0, "F1", "c1"), (1, "F1", "c2"), (2, "F2", "c1"), (3, "F2", "c1"), (4, "F3", "old")], "entry_pos int, sha256 string, fingerprint string")
    done_files = spark.createDataFrame([("F1", "b0")], "sha256 string, previous_batch string")
    done_claims = spark.createDataFrame([("old", "f", "b0")], "fingerprint string, previous_filename string, previous_claim_batch string")
    got = {r.entry_pos: (r.kind, r.reported) for r in ingest.split_duplicates(entries, done_files, done_claims).collect()}
    # a claim in a refused file isn't seen by later entries
    assert got == {0: ("file", True), 1: ("file", False), 2: (None, False), 3: ("submission", True), 4: ("claim", True)}


def x12_text(body, count=None, control="000000101"):
    segs = ["ST*837*0001*005010X222A1", "HL*1**20*1", "NM1*85*2*CLINIC*****XX*1003005000", "PRV*BI*PXC*207X00000X", *body]
    return ISA + "GS*HC*A*B*20261016*1200*101*X*005010X222A1~" + "~".join(segs) + f"~SE*{count or len(segs) + 1}*0001~GE*1*101~IEA*1*{control}~"


def test_x12(spark):
    sub = ["HL*2*1*22*0", "NM1*IL*1*ONE*A****MI*M1", "DMG*D8*19850315*F", "NM1*PR*2*P*****PI*P1"]
    claim = ["CLM*C1*62000.00***11:B:1*Y", "HI*ABK:Z0000*BG:01", "LX*1", "SV1*HC:27447*62000.00*UN*1***1", "DTP*472*RD8*20260814-20260815"]
    other = ["CLM*C2*5***12:B:7*Y", "LX*1", "SV1*HC:99213*5*UN*2***1", "DTP*472*D8*20260901", "HL*3*1*22*0", "NM1*IL*1*TWO*B****MI*M2", "CLM*C3*7***11:B:1*Y"]
    files_ = spark.createDataFrame([("ok", "﻿\n" + x12_text(sub + claim + other)), ("count", x12_text(sub + claim, 99)), ("iea", x12_text(sub + claim, None, "000000999")), ("cut", x12_text(sub)[:-20]), ("plain", "hello"), ("short", "ISA*00*~"), ("none", x12_text(sub))], "file_id string, text string")
    bad = {r.file_id: r.reason for r in x12.rejected(files_).collect()}
    for k, said in (("count", "SE segment count is 99"), ("iea", "Interchange control number mismatch"), ("cut", "Incomplete transmission"), ("plain", "must start with ISA"), ("short", "too short"), ("none", "No claims found")):
        assert said in bad[k]
    assert "ok" not in bad
    got = {r.claim_id: r for r in x12.claims(files_).where("file_id = 'ok'").collect()}
    assert {k: r.subscriber.member_id for k, r in got.items()} == {"C1": "M1", "C2": "M1", "C3": "M2"}
    c1 = got["C1"]
    assert (c1.financial.claim_amount, c1.provider.npi, c1.patient.date_of_birth, c1.transaction_type) == ("62000", "1003005000", "19850315", "837P")
    assert [c.code for c in c1.diagnosis_codes] == ["Z0000"] and [c.code for c in c1.other_codes] == ["01"]
    line = c1.service_lines[0]
    assert (line.procedure_code, line.charge_amount, line.date_of_service, line.date_of_service_end, line.place_of_service) == ("27447", "62000.00", "20260814", "20260815", "11")
    assert got["C3"].service_lines is None


@pytest.mark.parametrize(("score", "concern", "status", "want"), [(0.34, False, "ok", ("APPROVE", "none")), (0.35, False, "ok", ("REQUIRE_REVIEW", "manual_review")), (0.8, False, "ok", ("REQUIRE_REVIEW", "fraud_priority")), (0.93, False, "ok", ("REQUIRE_REVIEW", "siu_escalation")), (0.1, True, "ok", ("REQUIRE_REVIEW", "manual_review")), (None, False, "error", ("APPROVE", "none")), (0.9, True, "error", ("REQUIRE_REVIEW", "policy_default"))])
def test_policy(spark, score, concern, status, want):
    rows = spark.createDataFrame([(False, concern, ["DSL:x"] if concern else [], status, score)], "rejected boolean, concern boolean, dsl_reasons array<string>, ml_status string, risk_score double")
    r = policy.decide(rows).first()
    assert (r.status, r.queue) == want


def test_overlap_levels(spark):
    con = "rule string, scope string, field string, low double, low_open boolean, high double, high_open boolean, text string"
    rows = [("a", "", "f", 10.0, True, None, False, None), ("b", "", "f", 20.0, True, None, False, None), ("c", "", "f", None, False, 10.0, False, None), ("d", "", "f", None, False, 15.0, False, None)]
    constraints = spark.createDataFrame(rows, con)
    iv = constraints.withColumns({"low": F.coalesce("low", F.lit(float("-inf"))), "high": F.coalesce("high", F.lit(float("inf")))})
    conjuncts = iv.select("rule", F.lit(0).alias("conjunct"), F.concat("rule", F.lit("?")).alias("leaf"), "scope", "field", "low", "low_open", "high", "high_open")
    rules = constraints.select("rule", F.col("rule").alias("condition"), F.when(F.col("rule") == "b", "R").otherwise("Q").alias("outcome"))
    got = {(r.a, r.b): r.level for r in overlap.levels(rules, conjuncts, constraints).collect()}
    assert got == {("a", "b"): "Shadowed", ("c", "d"): "Subsumption", ("a", "d"): "ConditionOverlap"}


def test_stream_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.x12").write_text("one")
    seen = []
    run = lambda k: stream.ingest(spark, "s", str(tmp_path / "in"), str(tmp_path / "ledger"), str(tmp_path / f"check{k}"), lambda rows: seen.extend(r.filename for r in rows.collect())).awaitTermination(120)
    run(0)
    run(1)
    (tmp_path / "in" / "b.edi").write_text("two")
    run(1)
    assert seen == ["a.x12", "b.edi"]


def test_rules_have_queries():
    from claimlens import catalog

    assert set(R.RULES) <= set(catalog.QUERIES) and set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def test_fixed_limits_of_rules(spark):
    rows = spark.createDataFrame([("749999", "4.99"), ("750001", "5"), (None, None)], "total string, amount string")
    claim = R.Claim(lambda name: {"claim_totals": F.struct(F.col("total").alias("total_charges")), "financial": F.struct(F.col("amount").alias("claim_amount"))}.get(name, F.lit(None).cast("array<struct<a:string>>")))
    assert [r[0] for r in rows.select(R.RULES["R7"].condition(claim).truth).collect()] == [False, True, None]
    assert [r[0] for r in rows.select(R.RULES["R17"].condition(claim).truth).collect()] == [True, False, None]


def test_emergency_visit_without_a_code_is_no_match(spark):
    rows = spark.createDataFrame([(("20000",), [(None,)]), (("20000",), [("99285",)]), (("20000",), [])], "financial struct<claim_amount:string>, service_lines array<struct<procedure_code:string>>")
    claim = R.Claim(lambda name: F.col(name) if name != "diagnosis_codes" else F.lit(None).cast("array<struct<code:string>>"))
    assert [r[0] for r in rows.select(R.RULES["R18"].condition(claim).truth).collect()] == [False, True, None]


def test_scorer_view_and_fingerprint(spark):
    rows = spark.createDataFrame([(1, ("n", "1", "2 St"), ("m",), ("c1",), "5"), (2, ("n", "1", "2 St"), ("m",), ("c2",), "5"), (3, ("n", "2", "2 St"), ("m",), ("c1",), "5")], "k int, provider struct<name:string,npi:string,address:string>, subscriber struct<id:string>, interchange struct<control:string>, amount string")
    seen = policy.scorer_view(rows)
    assert seen.columns == ["k", "provider", "interchange", "amount"] and seen.schema["provider"].dataType.names == ["npi"]
    a, b, c = (r.fingerprint for r in ingest.with_fingerprint(rows, ["k"]).orderBy("k").collect())
    assert a == b != c
    turned = rows.select("amount", "k", "subscriber", F.struct("provider.npi", "provider.address", "provider.name").alias("provider"))
    assert ingest.with_fingerprint(turned, ["k"]).orderBy("k").first().fingerprint == a


def test_requests_in_a_window(spark):
    rows = spark.createDataFrame([("b", k, t) for k, t in enumerate((0, 40, 80, 141, 150, 500))] + [("c", 9, 1)], "batch string, id int, at int").withColumn("ts", F.timestamp_seconds("at"))
    assert sorted(r.id for r in ingest.at_most_once(rows, ["batch"], "ts", "id").collect()) == [0, 2, 3, 5, 9]
    got = {r.id: r.allowed for r in ingest.rate_limited(rows, ["batch"], "ts", "id", 2, 100).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True, 9: True}


def test_monthly_files_registry_and_listing(spark, tmp_path):
    links = spark.createDataFrame([(f"NPPES_Data_Dissemination_{m}.zip",) for m in ("March_2025", "March_2025_V2", "December_2024_V2", "Smarch_2030", "April_2024")], "link string")
    assert files.latest_monthly_file(links).first().link == "NPPES_Data_Dissemination_March_2025_V2.zip"
    (tmp_path / "r.csv").write_text("\ufeff" + ",".join(f'"{h}"' for h in reversed(files.REGISTRY_HEADERS.values())) + "\n" + ",".join(f'"{k}"' if k != "npi" else '"1234567890"' for k in reversed(files.REGISTRY_HEADERS)) + "\n")
    row = files.registry_csv(spark, str(tmp_path / "r.csv")).first()
    assert (row.npi, row.taxonomy, row.state) == ("1234567890", "taxonomy", "state")
    (tmp_path / "bad.csv").write_text("NPI\n1\n")
    with pytest.raises(ValueError, match="Entity Type Code"):
        files.registry_csv(spark, str(tmp_path / "bad.csv"))
    for name in ("b.x12", "a.edi", "c.json", "d.txt"):
        (tmp_path / name).write_text(name)
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "e.x12").write_text("e")
    assert [r.path.rsplit("/", 1)[1] for r in files.listing(spark, str(tmp_path)).collect()] == ["a.edi", "b.x12", "d.txt"]


def test_scores_contract_and_cofiring(spark):
    bodies = [(1, '{"contract_version":"1.0","risk_score":0.5}'), (2, '{"contract_version":"2.0","risk_score":0.5}'), (3, "{bad"), (4, '{"contract_version":"1.0","ml_probability":"0.25","model_id":"m"}')]
    got = {r.claim_id: tuple(r)[1:] for r in policy.normalised_scores(spark.createDataFrame(bodies, "claim_id int, body string")).collect()}
    assert got == {1: ("ok", 0.5, "unknown"), 2: ("error", None, "unknown"), 3: ("error", None, "unknown"), 4: ("ok", 0.25, "m")}
    scored = policy.with_scores(spark.createDataFrame([(1,), (2,)], "claim_key int"), spark.createDataFrame([(1, 0.9)], "claim_key int, risk_score double")).collect()
    assert {r.claim_key: r.score for r in scored} == {1: 0.9, 2: 0.42}
    lost = files.contract_issues(spark.createDataFrame([("financial.claim_amount",), ("service_lines.3.units",), ("payer.payer_name",), ("patient.age",)], "path string")).collect()
    assert {r.path: r.hint for r in lost} == {"payer.payer_name": "payer.name", "patient.age": "none"}
    fired = spark.createDataFrame([(1, ["A", "B"]), (2, ["A"]), (3, ["A", "B", "C"]), (4, [])], "claim_key int, rules array<string>")
    assert {(r.a, r.b): (r.n_both, r.n_a, r.n_b) for r in overlap.cofiring(fired).collect()} == {("A", "B"): (2, 3, 2), ("A", "C"): (1, 3, 1), ("B", "C"): (1, 2, 1)}


def test_x12_parties_and_types(spark):
    def text(version, body):
        segs = ["ST*837*0001*" + version, *body]
        return ISA + f"GS*HC*A*B*20261016*1200*101*X*{version}~" + "~".join(segs) + f"~SE*{len(segs) + 1}*0001~GE*1*101~IEA*1*000000101~"

    head = ["NM1*41*2*SUB*****46*S1", "PER*IC*DESK*TE*555", "HL*1**20*1", "NM1*85*2*CLINIC*****XX*1", "N3*1 MAIN ST", "N4*TOWN*IL*62701", "REF*EI*99", "NM1*87*2*OTHER", "N3*2 SIDE ST"]
    member = ["HL*2*1*22*1", "SBR*P**G1", "NM1*IL*1*LAST*FIRST*MID***MI*M1", "N3*3 ELM ST", "N4*CITY*TX*75001", "DMG*D8*19700101*F", "NM1*PR*2*PAYER*****PI*P1"]
    child = ["HL*3*2*23*0", "NM1*QC*1*CHILD*KIM", "DMG*D8*20010203*M", "CLM*C1*10***13:A:7", "DTP*434*RD8*20260101-20260103", "DTP*435*DT*202601011200", "NM1*82*1*DOC*ANN****XX*7", "PRV*PE*PXC*T1", "NM1*PR*2*SECOND*****PI*P2", "LX*1", "SV2*0300*HC:99*10*UN*2"]
    second = ["HL*4*1*22*0", "NM1*IL*1*TWO*B****MI*M2", "CLM*C2*5***11:A:1", "LX*1", "SV2*0301*HC:98*5*UN*1"]
    dental = ["HL*1**20*1", "NM1*85*2*TEETH*****XX*2", "HL*2*1*22*0", "NM1*IL*1*D*E****MI*M3", "CLM*C3*7***11:B:1", "LX*1", "SV3*AD:D1*7****3", "TOO*JP*12*L"]
    rows = spark.createDataFrame([("i", text("005010X223A2", head + member + child + second)), ("d", text("5010", dental))], "file_id string, text string")
    got = {r.claim_id: r for r in x12.claims(rows).collect()}
    c1, c2, c3 = got["C1"], got["C2"], got["C3"]
    assert (c1.transaction_type, c2.transaction_type, c3.transaction_type) == ("837I", "837I", "837D")
    assert tuple(c1.billing_provider.address) == ("1 MAIN ST", "TOWN", "IL", "62701") and c1.billing_provider.tax_id == "99"
    assert (c1.submitter.contact_name, c1.submitter.contact_phone) == ("DESK", "555") and c3.submitter.contact_name is None
    assert (c1.patient.name.first, c1.patient.date_of_birth, c1.patient.gender) == ("KIM", "20010203", "M")
    assert (c1.subscriber.middle_name, c1.subscriber.date_of_birth, c1.subscriber.group_number, c1.subscriber.relationship_code, c1.subscriber.address.city) == ("MID", "19700101", "G1", None, "CITY")
    # nothing of the first member stays for the second; another payer inside a claim isn't the payer
    assert (c2.subscriber.member_id, c2.subscriber.group_number, c2.subscriber.address.city, c2.payer.payer_id, c2.patient.name.first) == ("M2", None, None, None, "B") and c1.payer.payer_id == "P1"
    assert (c1.rendering_provider.npi, c1.rendering_provider.taxonomy_code, c2.rendering_provider.npi) == ("7", "T1", None)
    assert tuple(c1.claim_details) == (None, "13", "7", "20260101", "20260103", "20260101")
    line = c1.service_lines[0]
    assert (line.date_of_service, line.place_of_service, line.revenue_code, line.units) == ("20260101", None, "0300", "2")
    assert tuple(c3.service_lines[0].tooth_info) == ("JP", "12", "L") and (c3.service_lines[0].units, c3.service_lines[0].place_of_service) == ("3", "11")


def test_links_and_notices(spark):
    pages = spark.createDataFrame([(1, '<a href="/a.zip">x</a> <A HREF = \'/b.zip\'>'), (2, "no link"), (3, None), (4, "")], "site int, html string")
    assert sorted(tuple(r) for r in files.hrefs(pages, "html", "site").collect()) == [(1, "/a.zip"), (1, "/b.zip")]
    rows = spark.createDataFrame([("b", x) for x in "edcbaa"] + [(None, "z"), ("c", None), ("d", "y"), ("d", "x")], "k string, item string")
    assert {r.k: r.notice for r in files.notices(rows, "k", "item").collect()} == {"b": "a | b | c (and 2 more)", None: "z", "d": "x | y"}
    assert files.notices(rows.limit(0), "k", "item").count() == 0


def test_x12_codes_of_several_segments(spark):
    body = "CLM*A*10***11:B:1~HI*ABK:A1*BE:V1~REF*G1*P~HI*ABF:A2~LX*1~SV1*HC:99213*10*UN*1~HI*ABK:LINE~LX*2~SV1*HC:99214*5*UN*2~CLM*B*5***11:B:1~LX*1~SV1*HC:1*5*UN*1"
    got = {r.claim_id: r for r in x12.claims(spark.createDataFrame([("f", x12_text(body.split("~")))], "file_id string, text string")).collect()}
    assert [c.code for c in got["A"].diagnosis_codes] == ["A1", "A2"] and [c.code for c in got["A"].other_codes] == ["V1"] and got["B"].diagnosis_codes == []
    assert [(x.line_number, x.procedure_code) for x in got["A"].service_lines] == [(1, "99213"), (2, "99214")] and got["A"].authorization.authorization_number == "P"
