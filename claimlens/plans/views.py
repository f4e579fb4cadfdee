"""Claims-shaped views over the given tables: the same SQL makes them in Spark and in the check's SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

_DAY = "concat(cast(year({0}) as string), '-', lpad(cast(month({0}) as string), 2, '0'), '-', lpad(cast(day({0}) as string), 2, '0'))"


def _check_digit(nine: str) -> str:
    """SQL for the check digit of a nine-digit provider number with its issuer prefix."""
    parts = ["24"]  # what the prefix adds
    for k in range(9):
        d = f"cast(substr({nine}, {k + 1}, 1) as int)"
        parts.append(f"(case when {d} > 4 then 2 * {d} - 9 else 2 * {d} end)" if k % 2 == 0 else d)
    return f"cast((10 - ({' + '.join(parts)}) % 10) % 10 as string)"


_NINE = "concat('1', lpad(cast(s_suppkey as string), 8, '0'))"
VIEWS = {
    "v_provider": f"""
        select s_suppkey, s_name,
               case when s_suppkey % 11 = 0 then {_NINE}
                    when s_suppkey % 7 = 0 then concat({_NINE}, cast((cast({_check_digit(_NINE)} as int) + 1) % 10 as string))
                    else concat({_NINE}, {_check_digit(_NINE)}) end as npi,
               case when s_suppkey % 5 = 0 then null when s_suppkey % 3 = 0 then '207RC0000X' else '207X00000X' end as taxonomy
        from supplier""",
    "v_registry": """
        select npi, s_name as provider_name,
               case when s_suppkey % 29 = 0 then null else cast('1995-01-01' as date) + cast(s_suppkey * 37 % 1200 as int) end as enumeration_date,
               case when s_suppkey % 4 = 1 then cast('1997-01-01' as date) + cast(s_suppkey * 53 % 1500 as int) end as deactivation_date,
               case when s_suppkey % 8 = 1 then cast('1997-01-01' as date) + cast(s_suppkey * 53 % 1500 + 200 as int) end as reactivation_date,
               case when s_suppkey % 5 = 3 then cast('2000-06-01' as date) + cast(s_suppkey % 300 as int) end as dropped_on
        from v_provider where s_suppkey % 13 <> 0""",
    "v_lines": f"""
        select l_orderkey as claim_key, l_linenumber as line_number, l_partkey, l_suppkey, l_quantity, l_extendedprice,
               case when l_partkey % 97 = 0 then 'unknown'
                    when l_partkey % 2 = 0 then {_DAY.format('l_shipdate')}
                    else replace({_DAY.format('l_shipdate')}, '-', '') end as date_of_service,
               case when l_partkey % 6 = 0 then {_DAY.format('l_shipdate')} when l_partkey % 6 = 3 then '1998-06-15' end as date_of_service_end,
               case when l_suppkey % 2 = 0 then '11' when l_suppkey % 3 = 0 then '21' else '23' end as place_of_service,
               case l_partkey % 12 when 0 then '99285' when 1 then '99214' when 2 then '99215' when 3 then '97110' when 4 then '00140'
                    when 5 then 'D2740' when 6 then 'E0601' when 7 then '93306' when 8 then '99385' when 9 then '27447' else cast(l_partkey as string) end as procedure_code,
               case when l_partkey % 89 = 0 then 'n/a' when l_partkey % 83 = 0 then null else cast(cast(l_extendedprice as decimal(18,2)) as string) end as charge_amount,
               case when l_suppkey % 10 = 9 then null else cast(cast(l_quantity as int) - 3 as string) end as units,
               case when l_partkey % 24 = 5 then cast(l_linenumber as string) end as tooth_number
        from lineitem""",
    "v_dx": """
        select distinct l_orderkey as claim_key, case p_size % 7 when 0 then 'S06' when 1 then 'I21' when 2 then 'Z00' else p_type end as code
        from lineitem join part on l_partkey = p_partkey where p_size % 5 <> 0""",
    "v_claim": f"""
        select o_orderkey as claim_key, cast(o_orderkey as string) as claim_id, o_custkey,
               case when o_orderkey % 31 = 0 then null when o_orderkey % 37 = 0 then 'abc' else cast(cast(o_totalprice as decimal(18,2)) as string) end as claim_amount,
               case when o_orderkey % 41 = 0 then null else cast(cast(o_totalprice as decimal(18,2)) as string) end as total_charges,
               case when o_orderpriority in ('1-URGENT', '2-HIGH') then concat('PA', cast(o_orderkey as string)) end as authorization_number,
               case o_orderstatus when 'F' then '11' when 'O' then '21' else '23' end as place_of_service,
               case when o_orderstatus = 'O' then '13' end as facility_type_code,
               {_DAY.format('o_orderdate')} as statement_from_date,
               case when o_orderstatus = 'O' then case when o_custkey % 4 = 0 then '1997-03-01' else {_DAY.format('o_orderdate')} end end as statement_to_date,
               case when o_custkey % 17 = 0 then null when o_custkey % 19 = 0 then '1850-01-01'
                    else concat(cast(1925 + o_custkey % 80 as string), '-', lpad(cast(1 + o_custkey % 12 as string), 2, '0'), '-', lpad(cast(1 + o_custkey % 28 as string), 2, '0')) end as date_of_birth,
               case when s_suppkey % 13 = 0 then null else cast((o_orderkey * 7 + s_suppkey) % 400 as string) end as tenure_days,
               npi, taxonomy, cast(o_orderdate as date) as order_day, o_custkey % 25 as batch_id,
               case when o_custkey % 25 in (3, 11) then 'failed' else 'completed' end as batch_status,
               case when o_orderkey % 23 = 0 then null when o_orderkey % 29 = 1 then 0.35 when o_orderkey % 29 = 2 then 0.8 when o_orderkey % 29 = 3 then 0.93
                    else cast(o_orderkey * 37 % 1000 as double) / 1000.0 end as risk_score,
               case when o_orderkey % 47 = 0 then 'error' else 'ok' end as ml_status
        from orders left join v_provider on s_suppkey = o_custkey % (select count(*) from supplier)""",
}


#: About how many claims are one task.
TASK_CLAIMS = 16_384


def claim_tasks(spark: SparkSession) -> int:
    return max(1, -(-spark.table("orders").count() // TASK_CLAIMS))


def register(spark: SparkSession, sf_dir: str) -> None:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for name, sql in VIEWS.items():
        spark.sql(sql).createOrReplaceTempView(name)


def sql_with_views(body: str, *names: str) -> str:
    """A query with the views it needs as common table expressions."""
    need = [n for n in VIEWS if n in names or any(n in VIEWS[m] for m in names if m in VIEWS) or n in body]
    need = [n for n in VIEWS if n in need or any(n in VIEWS[m] for m in need)]
    ctes = ", ".join(f"{n} as ({VIEWS[n]})" for n in need)
    if not need:
        return body
    rest = body.lstrip()
    return f"with {ctes}, {rest[4:].lstrip()}" if rest.lower().startswith("with ") else f"with {ctes} {rest}"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.table("v_lines")


def flat_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.table("v_claim")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.table("v_registry")


def dealt(spark: SparkSession, view: str, parts: int | None = None, repeats: bool = False, **keys: str) -> DataFrame:
    """The rows of a view over tables whose own columns are dealt by a key first, so that what the view makes of them isn't shuffled."""
    sql = VIEWS[view].replace("select distinct", "select", 1) if repeats else VIEWS[view]
    tables = {}
    for name, key in keys.items():
        tables[name] = spark.table(name).repartition(parts, key)
        sql, n = re.subn(f"from {name}\\b", f"from {{{name}}}", sql, count=1)
        assert n == 1, name
    return spark.sql(sql, **tables)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested claim per order; orders, their lines and their codes are dealt by the claim's key once each.

    Tasks hold about TASK_CLAIMS claims however large the tables are, so that none has to spill what it gathers.
    """
    register(spark, sf_dir)
    parts = claim_tasks(spark)
    flat = dealt(spark, "v_claim", parts, orders="o_orderkey")
    order = ("line_number", "l_partkey", "l_suppkey", "date_of_service", "l_quantity", "l_extendedprice")
    line = F.struct(*order, "date_of_service_end", "place_of_service", "procedure_code", "charge_amount", "units", F.struct("tooth_number").alias("tooth_info"))
    by_claim = dealt(spark, "v_lines", parts, lineitem="l_orderkey").groupBy("claim_key").agg(F.array_sort(F.collect_list(line)).alias("service_lines"))
    # repeated codes go where a claim's codes meet, not by a shuffle of their own
    codes = dealt(spark, "v_dx", repeats=True).repartition(parts, "claim_key").groupBy("claim_key").agg(F.array_sort(F.collect_set(F.struct("code"))).alias("diagnosis_codes"))
    rows = flat.join(by_claim, "claim_key", "left").join(codes, "claim_key", "left")
    total = F.when(F.size("service_lines") > 0, F.aggregate("service_lines", F.lit(0).cast("decimal(38,6)"), lambda a, x: (a + F.trim(x["charge_amount"]).try_cast("decimal(38,6)")).cast("decimal(38,6)")))
    return rows.select(
        "claim_key", "claim_id", "o_custkey", "order_day", "batch_id", "batch_status", "risk_score", "ml_status",
        F.struct("place_of_service", "facility_type_code", "statement_from_date", "statement_to_date").alias("claim_details"),
        F.struct("claim_amount").alias("financial"),
        F.struct("total_charges", total.cast("string").alias("service_line_total")).alias("claim_totals"),
        F.struct("authorization_number").alias("authorization"),
        F.struct("npi", F.when(F.col("claim_key") % 2 == 0, "390200000X").alias("taxonomy"), "tenure_days", F.concat(F.lit("Provider "), "npi").alias("name"), F.lit("Springfield").alias("city")).alias("provider"),
        F.struct("npi", "taxonomy", F.lit("1 Main St").alias("address"), F.lit("555").alias("phone")).alias("billing_provider"),
        F.struct("date_of_birth").alias("patient"), F.struct(F.concat(F.lit("M"), F.col("o_custkey").cast("string")).alias("member_id")).alias("subscriber"),
        F.struct(F.concat(F.lit("0000"), F.col("batch_id").cast("string")).alias("control_number")).alias("interchange"),
        "service_lines", "diagnosis_codes",
    )
