"""Committed batches and reports, and per-key rules in order, against plain versions."""

import datetime as dt
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from claimlens.operators import ingest, policy
from claimlens.sources import batches

ENTRY = "batch_id string, entry_pos long, kind string, reported boolean, claim string"


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), ENTRY)


FIRST = [("a", 1, None, False, "x"), ("a", 2, "claim", True, "y"), ("b", 3, "file", True, "z"), ("b", 4, "file", False, "z")]


def held(spark, root):
    return sorted((r.batch_id, r.entry_pos) for r in batches.claims(spark, root, "batch_id string, entry_pos long").collect())


def told(spark, root):
    return sorted((r.batch_id, r.file_count, r.refused, r.status, r.completed_at is not None) for r in batches.batches(spark, root).collect())


def test_a_batch_is_stored_once(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    assert told(spark, root) == held(spark, root) == []
    assert batches.ingested(spark, root, entries(spark, *FIRST)) is not None
    want = [("a", 1, 1, "pending", False), ("b", 0, 1, "failed", True)]
    assert told(spark, root) == want and held(spark, root) == [("a", 1)]
    assert batches.ingested(spark, root, entries(spark, *FIRST)) is None
    batches.ingested(spark, root, entries(spark, *FIRST, ("c", 9, None, False, "w")))
    assert told(spark, root) == [*want, ("c", 1, 0, "pending", False)] and held(spark, root) == [("a", 1), ("c", 9)]
    assert batches.ingested(spark, root, entries(spark)) is None


def test_a_job_that_dies_between_the_tables_leaves_nothing_to_see(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/s"
    rows = ingest.batch_rows
    # the marks fail once the claims are written
    monkeypatch.setattr(ingest, "batch_rows", lambda e: rows(e).withColumn("status", F.raise_error(F.lit("killed")).cast("string")))
    with pytest.raises(Exception, match="killed"):
        batches.ingested(spark, root, entries(spark, *FIRST))
    assert len(list((tmp_path / "s" / "claims").glob("attempt=*/part-*"))) > 0  # rows of the lost attempt lie there
    assert told(spark, root) == held(spark, root) == []
    monkeypatch.undo()
    batches.ingested(spark, root, entries(spark, *FIRST))
    assert held(spark, root) == [("a", 1)] and len(list((tmp_path / "s" / "claims").iterdir())) == 2


def test_reports_lie_beside_the_claims_and_the_latest_counts(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/s"
    schema = "claim_key long, batch_id string, overall_risk string, weighted_score int, matched_rules int, undecided_rules int, summary string, results array<struct<rule_name:string>>, error_message string"
    row = lambda k, risk, error=None: (k, "a", risk, 3, 1, 0, "s", [("R",)], error)
    made = lambda *rows: spark.createDataFrame(list(rows), schema)
    batches.evaluated(spark, root, made(row(1, "LowRisk"), row(2, "HighRisk", "no report")), "2026-01-01 00:00:00")
    got = {r.claim_key: (r.status, r.overall_risk, r.error_message) for r in batches.reports(spark, root).collect()}
    assert got == {1: ("evaluated", "LowRisk", None), 2: ("not_assessed", None, "no report")}
    batches.evaluated(spark, root, made(row(2, "HighRisk")), "2026-01-02 00:00:00")
    # an attempt without its mark is not seen
    made(row(1, "CriticalRisk")).write.parquet(f"{root}/reports/attempt=lost")
    got = {r.claim_key: (r.status, r.overall_risk) for r in batches.reports(spark, root).collect()}
    assert got == {1: ("evaluated", "LowRisk"), 2: ("evaluated", "HighRisk")}


START = dt.datetime(2026, 1, 1)


def plain(rows, seconds, most):
    """Accepted at most once in so many seconds, and allowed under the rate, for rows (key, second, id)."""
    once, allowed, last, recent = set(), {}, {}, {}
    for key, at, n in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or at - last[key] > seconds:
            once.add(n)
            last[key] = at
        own = recent.setdefault(key, deque())
        while own and own[0] <= at - seconds:
            own.popleft()
        allowed[n] = len(own) < most
        if allowed[n]:
            own.append(at)
    return once, allowed


@pytest.mark.parametrize("partitions", [1, 7])
def test_keys_in_order(spark, partitions):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.randrange(400), rng.randrange(100_000)]), n) for n in range(3000)]
    events = spark.createDataFrame([(k, START + dt.timedelta(seconds=at), n) for k, at, n in rows] + [("a", None, -1)], "user string, ts timestamp, id long").repartition(partitions)
    once, allowed = plain(rows, 60, 5)
    assert {r.id for r in ingest.at_most_once(events, ["user"], "ts", "id", 60).collect()} == once
    assert {r.id: r.allowed for r in ingest.rate_limited(events, ["user"], "ts", "id", 5, 60).collect()} == allowed
    assert ingest.at_most_once(events.limit(0), ["user"], "ts", "id").collect() == []


def test_a_million_events_of_one_key_without_a_pause(spark):
    n = 1_000_000
    events = spark.range(n).select(F.lit("hot").alias("user"), F.timestamp_micros(F.col("id") * 500_000).alias("ts"), "id")
    assert ingest.at_most_once(events, ["user"], "ts", "id", 60).count() == -(-n // 121)
    # 1000 of each 60 s may pass, 120 come: all do; of 50 in 60 s, 50 do
    assert ingest.rate_limited(events, ["user"], "ts", "id", 1000, 60).where("not allowed").count() == 0
    assert ingest.rate_limited(events, ["user"], "ts", "id", 50, 60).where("allowed").count() == sum(min(50, n - k) for k in range(0, n, 120))


@pytest.mark.parametrize("days", [0, 1, 30])
def test_rows_within_days(spark, days):
    rng = random.Random(days)
    rows = [(n, rng.choice(["a", "b", None]), dt.date(2026, 1, 1) + dt.timedelta(days=rng.choice([0, rng.randrange(300)]))) for n in range(200)] + [(900, "a", None)]
    table = spark.createDataFrame(rows, "key long, who string, day date")
    got = sorted(tuple(r) for r in ingest.within_days(table, "key", ["who"], "day", days).collect())
    want = sorted((a, b, w, (e - d).days) for a, w, d in rows for b, v, e in rows if d and e and w is not None and w == v and 0 <= (e - d).days <= days and ((e - d).days > 0 or a < b))
    assert got == want


def test_edit_tables(spark):
    lines = spark.createDataFrame([(1, "A", 5), (1, "B", 5), (1, "B", 5), (2, "A", None), (2, "C", 70), (3, "B", 1), (4, None, 3)], "claim_key long, procedure_code string, age int")
    pairs = spark.createDataFrame([("A", "B"), ("A", "B"), ("C", "A"), ("B", "C")], "one string, other string")
    assert sorted(tuple(r) for r in policy.unbundled(lines, pairs).collect()) == [(1, "A", "B"), (2, "C", "A")]
    edits = spark.createDataFrame([("A", 10, 20), ("C", None, 60), ("B", 5, None)], "procedure_code string, low int, high int")
    assert sorted((r.claim_key, r.procedure_code) for r in policy.age_mismatches(lines, edits).collect()) == [(1, "A"), (2, "C"), (3, "B")]
