"""Queries of sources, table maintenance, joins, windows, sets, functions and streams, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import conditions, ingest, overlap, peers, policy, providers
from ..operators import rules as R
from ..sources import batches, files
from . import claim_files, x12_files
from . import rule_queries as rq
from . import views
from .views import sql_with_views as cte

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
Query = Callable[[SparkSession, str], DataFrame]


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def table(name: str, of: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        views.register(spark, sf_dir)
        return of(spark.table(name))

    return query


# sources
_reg_csv = lambda t: t.select(F.col("npi").alias("NPI"), F.date_format("enumeration_date", "MM/dd/yyyy").alias("day"), F.col("provider_name"))
add("SRC3", table("v_registry", lambda t: _reg_csv(t).where(F.length("NPI") == 10).select(F.col("NPI").alias("npi"), tx.to_registry_day(F.col("day")).cast("string").alias("enumeration_date"), "provider_name")),
    cte("select npi, strftime(enumeration_date, '%Y-%m-%d') as enumeration_date, provider_name from v_registry where length(npi) = 10", "v_registry"))
_named = "concat('f', event_id, case event_id % 5 when 0 then '.JSON' when 1 then '.x12' when 2 then '.Edi' when 3 then '.txt' else '' end)"
add("SRC4", table("events", lambda t: t.select("event_id", files.file_kind(F.expr(_named)).alias("kind"))),
    f"select event_id, case lower(regexp_extract({_named}, '\\.([^./]+)$', 1)) when 'json' then 'json' when 'x12' then 'x12' when 'edi' then 'x12' else 'ignored' end as kind from events")
_MONTHS = "array('January', 'March', 'August', 'December', 'Smarch')"
_links = "select page_id, concat('/x/NPPES_Data_Dissemination_', element_at({m}, cast(1 + page_id % 5 as int)), '_', cast(2020 + page_id * 7 % 5 as string), case when page_id % 3 = 0 then '_V2' else '' end, '.zip') as link, cast(page_id % 10 as int) as site from pages"
add("SRC6", lambda s, d: files.latest_monthly_file(files.hrefs(_sql(s, d, f"select site, concat(html, '<a href=\"', link, '\">file</a>') as html from ({_links.format(m=_MONTHS)}) join pages using (page_id)"), "html", "site"), "site"),
    f"select site, arg_max(link, (2020 + page_id * 7 % 5, [1, 3, 8, 12, 0][cast(1 + page_id % 5 as int)], page_id % 3 = 0)) as link from ({_links.format(m=_MONTHS.replace('array(', '[').replace(')', ']')).replace('element_at(', 'list_extract(')}) join pages using (page_id) where page_id % 5 <> 4 group by 1")
_rules = "select p_partkey, p_name as name, p_partkey % 3 <> 0 as active, case when p_partkey % 7 = 0 then '  ' else concat(' RULE r', cast(p_partkey as string), chr(10), 'WHEN TRUE ') end as rule_text from part"
add("SRC8", lambda s, d: files.active_rules(_sql(s, d, _rules)).select("p_partkey", "name", F.trim("rule_text").alias("rule_text")), f"select p_partkey, name, trim(rule_text, ' ') as rule_text from ({_rules}) where active and trim(rule_text, ' ') <> ''")


def _sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    views.register(spark, sf_dir)
    return spark.sql(sql)


# submissions over documents: text digest as fingerprint, source as batch
BATCHES = "select distinct source as batch_id, case when source in ('src1', 'src3') then 'failed' else 'completed' end as status from documents"
ENTRIES = "select doc_id as entry_pos, doc_id as id, doc_id as inserted_at, source as batch_id, concat('f', cast(doc_id as string)) as filename, sha2(concat(lang, source, substr(sha2(text, 256), 1, 1)), 256) as sha256, sha2(text, 256) as fingerprint from documents"
_ENTRIES_D = ENTRIES.replace("sha2(concat(lang, source, substr(sha2(text, 256), 1, 1)), 256)", "sha256(concat(lang, source, substr(sha256(text), 1, 1)))").replace("sha2(text, 256)", "sha256(text)")
_OLD, _NEW = "entry_pos % 3 = 0", "entry_pos % 3 <> 0"


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, batches = _sql(spark, sf_dir, ENTRIES), _sql(spark, sf_dir, BATCHES)
    old = entries.where(_OLD)
    files_ = ingest.previous_files(old.select("sha256", "batch_id").distinct(), batches)
    return ingest.split_duplicates(entries.where(_NEW), files_, ingest.previous_claims(old, batches))


_J4 = f"j4 as (select sha256, min(batch_id) as previous_batch from e join b using (batch_id) where {_OLD} and status <> 'failed' group by 1)"
_J5 = f"j5 as (select fingerprint, arg_min(filename, id) as previous_filename, arg_min(batch_id, id) as previous_claim_batch from e join b using (batch_id) where {_OLD} and status <> 'failed' group by 1)"
_J6 = f"j6 as (select e.*, previous_batch, previous_claim_batch, case when previous_batch is not null then 'file' when previous_claim_batch is not null then 'claim' end as early from e left join j4 using (sha256) left join j5 using (fingerprint) where {_NEW}), k as (select *, coalesce(early, case when row_number() over (partition by fingerprint, early is null order by entry_pos) > 1 then 'submission' end) as kind from j6), z as (select *, case when kind = 'file' then row_number() over (partition by sha256, coalesce(kind, '') order by entry_pos) = 1 else kind is not null end as reported from k)"
_SUB = f"with e as ({_ENTRIES_D}), b as ({BATCHES}), {_J4}, {_J5}, {_J6} "
add("J4", lambda s, d: ingest.previous_files(_sql(s, d, ENTRIES).where(_OLD).select("sha256", "batch_id").distinct(), _sql(s, d, BATCHES)), f"with e as ({_ENTRIES_D}), b as ({BATCHES}), {_J4} select * from j4")
add("J5", lambda s, d: ingest.previous_claims(_sql(s, d, ENTRIES).where(_OLD), _sql(s, d, BATCHES)), f"with e as ({_ENTRIES_D}), b as ({BATCHES}), {_J5} select * from j5")
add("J6", lambda s, d: _split(s, d).select("entry_pos", F.coalesce("kind", F.lit("accepted")).alias("kind"), F.col("reported").cast("int").alias("reported")), _SUB + "select entry_pos, coalesce(kind, 'accepted') as kind, cast(reported as int) as reported from z")


def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches stored, submitted once more, and read back with the number of their stored claims."""
    root, split = batches.scratch(spark, "batches"), _split(spark, sf_dir)
    batches.ingested(spark, root, split)
    batches.ingested(spark, root, split)
    held = batches.claims(spark, root, "batch_id string, entry_pos long").groupBy("batch_id").agg(F.count("*").alias("n_stored"), F.count_distinct("entry_pos").alias("n_entries"))
    return batches.batches(spark, root).join(held, "batch_id", "left").select("batch_id", "file_count", "refused", "status", F.coalesce("n_stored", F.lit(0)).alias("n_stored"), F.coalesce("n_entries", F.lit(0)).alias("n_entries"), F.col("completed_at").isNotNull().cast("int").alias("completed"))


_N = "count(*) filter (kind is null)"
add("SNK1", _ingested, _SUB + f"select batch_id, {_N} as file_count, count(*) filter (reported) as refused, case when {_N} = 0 then 'failed' else 'pending' end as status, {_N} as n_stored, {_N} as n_entries, cast({_N} = 0 as int) as completed from z group by 1")
add("W1", lambda s, d: _sql(s, d, ENTRIES).withColumn("n", F.row_number().over(Window.partitionBy("fingerprint").orderBy("entry_pos"))).where("n = 1").select("fingerprint", "entry_pos"), f"select fingerprint, min(entry_pos) as entry_pos from ({_ENTRIES_D}) group by 1")
add("W2", lambda s, d: _split(s, d).where("kind = 'file' and reported").select("sha256", "entry_pos"), _SUB + "select sha256, min(entry_pos) as entry_pos from z where kind = 'file' group by 1")
_led = ["sha256", "filename", "batch_id", "id"]
add("SNK4", lambda s, d: ingest.ledger_upsert(_sql(s, d, ENTRIES).where(_OLD).select(*_led), _sql(s, d, ENTRIES).where(_NEW).select(*_led), ["sha256"], "id"), f"select sha256, arg_max(filename, id) as filename, arg_max(batch_id, id) as batch_id, max(id) as id from ({_ENTRIES_D}) e where {_NEW} or sha256 not in (select sha256 from ({_ENTRIES_D}) x where {_NEW}) group by 1")
_keys = ["batch_id", "sha256", "fingerprint"]
_old_new = f"with e as ({_ENTRIES_D}), o as (select distinct batch_id, sha256, fingerprint from e where {_OLD}), n as (select * from e where {_NEW}) "
_not_in = "not exists (select 1 from o where o.batch_id = n.batch_id and o.sha256 = n.sha256 and o.fingerprint = n.fingerprint)"
_new_rows = lambda s, d: ingest.new_only(_sql(s, d, ENTRIES).where(_NEW), _sql(s, d, ENTRIES).where(_OLD), _keys).select("entry_pos", "batch_id")
add("J7", _new_rows, _old_new + f"select entry_pos, batch_id from n where {_not_in}")
add("SNK5", lambda s, d: _new_rows(s, d).groupBy("batch_id").agg(F.count("*").alias("n_new")), _old_new + f"select batch_id, count(*) as n_new from n where {_not_in} group by 1")
add("ST1", lambda s, d: _new_rows(s, d).select("entry_pos"), _old_new + f"select entry_pos from n where {_not_in}")
add("T1", lambda s, d: _sql(s, d, ENTRIES).where(_NEW).select(*_keys).intersect(_sql(s, d, ENTRIES).where(_OLD).select(*_keys)), _old_new + "select batch_id, sha256, fingerprint from n intersect select batch_id, sha256, fingerprint from o")
add("T2", lambda s, d: _sql(s, d, ENTRIES).where(_NEW).select(*_keys).subtract(_sql(s, d, ENTRIES).where(_OLD).select(*_keys)), _old_new + "select batch_id, sha256, fingerprint from n except select batch_id, sha256, fingerprint from o")
add("T3", lambda s, d: _sql(s, d, "select doc_id as id, lang as kind from documents").unionByName(_sql(s, d, "select event_id as id, event_type as kind from events"), allowMissingColumns=True).groupBy("kind").agg(F.count("*").alias("n")), "select kind, count(*) as n from (select doc_id as id, lang as kind from documents union all select event_id, event_type from events) group by 1")
add("A9", lambda s, d: _sql(s, d, ENTRIES).groupBy("batch_id").agg(F.count_distinct("sha256").alias("n_files"), F.count_distinct("fingerprint").alias("n_claims")), f"select batch_id, count(distinct sha256) as n_files, count(distinct fingerprint) as n_claims from ({_ENTRIES_D}) group by 1")
add("PRJ8", lambda s, d: files.notices(_sql(s, d, ENTRIES), "batch_id", "sha256"),
    f"select batch_id, concat(array_to_string(list_slice(list_sort(list(distinct sha256)), 1, 3), ' | '), case when count(distinct sha256) > 3 then concat(' (and ', count(distinct sha256) - 3, ' more)') else '' end) as notice from ({_ENTRIES_D}) group by 1")


# provider registry
def _npis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.flat_claims(spark, sf_dir).select("claim_key", F.lit(0).alias("npi_pos"), tx.blank_to_null(F.col("npi")).alias("npi"))


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.lines(spark, sf_dir).select("claim_key", tx.to_service_day(F.col("date_of_service")).alias("day"))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.findings(views.flat_claims(spark, sf_dir), _npis(spark, sf_dir), _days(spark, sf_dir), views.registry(spark, sf_dir))


_J1 = "n as (select c.claim_key, c.npi, r.npi is not null as known, enumeration_date, deactivation_date, reactivation_date, dropped_on from v_claim c left join v_registry r on r.npi = c.npi)"
_sd = rq.day("date_of_service")
_J2 = f"s as (select distinct claim_key, {_sd} as day from v_lines where {_sd} is not null), j2 as (select n.claim_key, n.npi, s.day, case when n.npi is null then null when not known then concat('NPI ', npi, ' not found in NPPES registry') when day < enumeration_date then concat('Provider NPI ', npi, ' was not issued until ', enumeration_date, ', service rendered on ', day) when day > deactivation_date and not coalesce(reactivation_date > deactivation_date and day >= reactivation_date, false) then concat('Provider NPI ', npi, ' was deactivated on ', deactivation_date, ', service rendered on ', day) when day >= dropped_on then concat('Provider NPI ', npi, ' has not been in the NPPES file since ', dropped_on, ', service rendered on ', day) end as reason from n join s using (claim_key))"
_J3 = f"j3 as (select c.claim_key, case when c.claim_key not in (select claim_key from s) then '{providers.NO_DATES}' else x.reason end as reason from v_claim c left join (select claim_key, arg_min(reason, day) as reason from j2 where reason is not null group by 1) x on x.claim_key = c.claim_key)"
_vs = ("v_claim", "v_registry", "v_lines", "v_provider")
add("J1", lambda s, d: providers.lookup(_npis(s, d).where("npi is not null"), views.registry(s, d)).select("claim_key", "npi", "provider_name"), cte("select c.claim_key, c.npi, r.provider_name from v_claim c left join v_registry r on r.npi = c.npi where c.npi is not null", *_vs))


def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _npis(spark, sf_dir).where("npi is not null").join(_days(spark, sf_dir).where("day is not null").distinct(), "claim_key")
    return providers.lookup(pairs, views.registry(spark, sf_dir)).select("claim_key", "day", F.coalesce(providers.problem(F.col("npi"), F.col("day")), F.lit("valid")).alias("outcome"))


add("J2", lambda s, d: _asof(s, d).withColumn("day", F.col("day").cast("string")), cte(f"with {_J1}, {_J2} select claim_key, cast(day as string) as day, coalesce(reason, 'valid') as outcome from j2 where npi is not null", *_vs))
add("ST6", lambda s, d: _asof(s, d).where("outcome like '%since%'").groupBy("claim_key").agg(F.count("*").alias("n_late")), cte(f"with {_J1}, {_J2} select claim_key, count(*) as n_late from j2 where reason like '%since%' group by 1", *_vs))
add("J3", lambda s, d: _findings(s, d).select("claim_key", F.coalesce("reason", F.lit("ok")).alias("reason")), cte(f"with {_J1}, {_J2}, {_J3} select claim_key, coalesce(reason, 'ok') as reason from j3", *_vs))
add("R21", lambda s, d: _findings(s, d).select("claim_key", F.col("reason").isNotNull().cast("int").alias("matched"), F.coalesce("reason", F.lit("")).alias("message")), cte(f"with {_J1}, {_J2}, {_J3} select claim_key, cast(reason is not null as int) as matched, coalesce(reason, '') as message from j3", *_vs))
add("O4", lambda s, d: _asof(s, d).where("outcome <> 'valid'").groupBy("claim_key").agg(F.min("day").cast("string").alias("first_day")), cte(f"with {_J1}, {_J2} select claim_key, cast(min(day) as string) as first_day from j2 where reason is not null group by 1", *_vs))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = rq.counted(spark, sf_dir).select(*rq.HEADER)
    return R.merge_counted(counted.join(_findings(spark, sf_dir), "claim_key", "left"), F.col("reason"))


add("A7", lambda s, d: _merged(s, d).select("claim_key", "total_rules", "matched_rules", "overall_risk", "weighted_score"),
    rq.report_sql(R.DEFAULT_RULES, f", {_J1}, {_J2}, {_J3} select claim_key, total_rules + cast(reason is not null as int) as total_rules, matched_rules + cast(reason is not null as int) as matched_rules, case when reason is not null then 'CriticalRisk' else overall_risk end as overall_risk, weighted_score + 3 * cast(reason is not null as int) as weighted_score from r join j3 using (claim_key)"))
_NEWREG = "select npi, concat(provider_name, '*') as provider_name, cast(null as date) as enumeration_date, deactivation_date, reactivation_date, cast(null as date) as dropped_on from v_registry where provider_name not like '%3'"
_day = lambda c: F.col(c).cast("string").alias(c)
add("SNK2", lambda s, d: providers.upsert(_unique_registry(s, d), providers.last_per_key(_sql(s, d, _NEWREG), "npi", "provider_name"), "npi").select("npi", "provider_name", _day("enumeration_date"), _day("dropped_on")),
    cte("select npi, case when provider_name like '%3' then provider_name else concat(provider_name, '*') end as provider_name, case when provider_name like '%3' then cast(enumeration_date as string) end as enumeration_date, case when provider_name like '%3' then cast(dropped_on as string) end as dropped_on from v_registry", *_vs))
add("SNK3", lambda s, d: providers.mark_dropped(_unique_registry(s, d), _sql(s, d, _NEWREG), providers.FULL_FILE_PREFIX + "20000101.csv", "2000-01-01").select("npi", _day("dropped_on")),
    cte("select npi, cast(case when dropped_on is null and provider_name like '%3' then date '2000-01-01' else dropped_on end as string) as dropped_on from v_registry", *_vs))
add("T4", lambda s, d: QUERIES["SNK3"](s, d).groupBy(F.col("dropped_on").isNotNull().cast("int").alias("dropped")).agg(F.count("*").alias("n")), cte("select cast(dropped_on is not null or provider_name like '%3' as int) as dropped, count(*) as n from v_registry group by 1", *_vs))
add("W6", lambda s, d: providers.last_per_key(_sql(s, d, "select c_custkey, c_nationkey, c_name from customer"), "c_nationkey", "c_custkey"), "select max(c_custkey) as c_custkey, c_nationkey, arg_max(c_name, c_custkey) as c_name from customer group by c_nationkey")


def _unique_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.registry(spark, sf_dir)


# catalogue
_CAT = "select p_name as name, min(p_partkey) as p_partkey, min(p_size) as size, min(p_brand) as entry_type from part group by p_name"
add("SNK7", lambda s, d: providers.upsert(_sql(s, d, _CAT), _sql(s, d, _CAT).where("size < 5").select("name", F.lit("BA Rule").alias("entry_type"), F.lit(0).alias("size")), "name", ["entry_type"]), f"select name, p_partkey, size, case when size < 5 then 'BA Rule' else entry_type end as entry_type from ({_CAT})")
add("J8", lambda s, d: _sql(s, d, _CAT).join(_sql(s, d, _rules).where("active").groupBy("name").agg(F.count("*").alias("n_texts")), "name", "left").select("name", F.coalesce("n_texts", F.lit(0)).cast("bigint").alias("n_texts")), f"select c.name, coalesce(n, 0) as n_texts from ({_CAT}) c left join (select name, count(*) as n from ({_rules}) where active group by 1) r using (name)")
add("A8", lambda s, d: _sql(s, d, _CAT).groupBy("entry_type").agg(F.count("*").alias("n"), F.count_if(F.col("size") > 25).alias("n_active")), f"select entry_type, count(*) as n, count(*) filter (size > 25) as n_active from ({_CAT}) group by 1")
add("O3", lambda s, d: _sql(s, d, _CAT).orderBy("entry_type", "name").select("entry_type", "name"), f"select entry_type, name from ({_CAT}) order by 1, 2")
add("P26", lambda s, d: _sql(s, d, "select lower(p_name) as name, p_partkey from part").groupBy("name").agg(F.count("*").alias("n")).where("n > 1"), "select lower(p_name) as name, count(*) as n from part group by 1 having count(*) > 1")
_inner = r"(?s)\A(?:\s*(?:--[^\n]*)?\n)*\s*RULE\s+(\w+)"
add("PRJ6", lambda s, d: _sql(s, d, _rules).select("p_partkey", F.coalesce(F.nullif(F.regexp_extract("rule_text", _inner, 1), F.lit("")), F.lit("none")).alias("inner_name")), f"select p_partkey, case when p_partkey % 7 = 0 then 'none' else concat('r', p_partkey) end as inner_name from ({_rules})")
add("A2", lambda s, d: views.registry(s, d).select(F.lit("registry").alias("what")).unionAll(views.flat_claims(s, d).select(F.lit("claims"))).groupBy("what").agg(F.count("*").alias("n")), cte("select 'registry' as what, count(*) as n from v_registry union all select 'claims', count(*) from v_claim", *_vs))

# claims: filters, projections, pages
add("PRJ1", lambda s, d: views.claims(s, d).select("claim_key", F.round(F.col("claim_totals.service_line_total").cast("double"), 2).alias("line_total")), rq.facts_sql("select claim_key, round(line_total, 2) as line_total from f"))
add("PRJ2", lambda s, d: policy.scorer_view(views.claims(s, d)).select("claim_key", F.to_json(F.struct("provider", "billing_provider"), {"ignoreNullFields": "true"}).alias("providers"), F.array_join(F.array(*map(F.lit, sorted(policy.scorer_view(views.claims(s, d)).columns))), ",").alias("kept")),
    cte("""select claim_key, concat('{"provider":{', concat_ws(',', case when npi is not null then concat('"npi":"', npi, '"') end, case when claim_key % 2 = 0 then '"taxonomy":"390200000X"' end, case when tenure_days is not null then concat('"tenure_days":"', tenure_days, '"') end), '},"billing_provider":{', concat_ws(',', case when npi is not null then concat('"npi":"', npi, '"') end, case when taxonomy is not null then concat('"taxonomy":"', taxonomy, '"') end), '}}') as providers,
        'authorization,batch_id,batch_status,billing_provider,claim_details,claim_id,claim_key,claim_totals,diagnosis_codes,financial,interchange,ml_status,o_custkey,order_day,provider,risk_score,service_lines' as kept from v_claim""", *_vs))
add("PRJ3", lambda s, d: ingest.with_fingerprint(views.claims(s, d).select("claim_key", "claim_id", "interchange", "financial", "authorization", "claim_details"), ["claim_key"]).select("claim_key", "fingerprint"),
    cte("""select claim_key, sha256(concat('{', concat_ws(',', case when authorization_number is not null then concat('"authorization":{"authorization_number":"', authorization_number, '"}') else '"authorization":{}' end,
        concat('"claim_details":{', concat_ws(',', case when facility_type_code is not null then concat('"facility_type_code":"', facility_type_code, '"') end, concat('"place_of_service":"', place_of_service, '"'), concat('"statement_from_date":"', statement_from_date, '"'), case when statement_to_date is not null then concat('"statement_to_date":"', statement_to_date, '"') end), '}'),
        concat('"claim_id":"', claim_id, '"'), concat('"financial":{', case when claim_amount is not null then concat('"claim_amount":"', claim_amount, '"') else '' end, '}')), '}')) as fingerprint from v_claim""", *_vs))
add("P21", lambda s, d: views.flat_claims(s, d).where((F.col("order_day") > "1996-01-01") & F.col("order_day").between("1995-06-01", "1999-12-31")).select("claim_key"), cte("select claim_key from v_claim where order_day > date '1996-01-01' and order_day between date '1995-06-01' and date '1999-12-31'", *_vs))
add("P24", lambda s, d: views.flat_claims(s, d).where("batch_status = 'completed'").select("claim_key"), cte("select claim_key from v_claim where batch_status = 'completed'", *_vs))
add("P27", lambda s, d: ingest.oversize(views.flat_claims(s, d), 70), cte("select batch_id, count(*) as n, case when count(*) > 70 then 'failed' else 'processing' end as status from v_claim group by 1", *_vs))
_SCORES = "select claim_key, risk_score from v_claim where risk_score is not null"
add("J10", lambda s, d: policy.with_scores(views.flat_claims(s, d).select("claim_key"), _sql(s, d, _SCORES)).select("claim_key", "score"), cte("select claim_key, coalesce(risk_score, 0.42) as score from v_claim", *_vs))
add("D5", lambda s, d: views.flat_claims(s, d).select("claim_key", F.when(F.col("ml_status") == "ok", F.coalesce("risk_score", F.lit(0.42))).otherwise(0.74).alias("score"), F.when(F.col("risk_score").isNull(), "fraud_stub_v1").otherwise("scored").alias("model_id")), cte("select claim_key, case when ml_status = 'ok' then coalesce(risk_score, 0.42) else 0.74 end as score, case when risk_score is null then 'fraud_stub_v1' else 'scored' end as model_id from v_claim", *_vs))
_BODY = "select claim_id, case when claim_key % 9 = 0 then '{bad' else concat('{\"contract_version\":\"1.0\",\"', case when claim_key % 2 = 0 then 'risk_score' else 'ml_probability' end, '\":\"', cast(risk_score as string), '\"}') end as body from v_claim"
add("D4", lambda s, d: policy.normalised_scores(_sql(s, d, _BODY)).select("claim_id", "ml_status"), cte("select claim_id, case when claim_key % 9 <> 0 and risk_score is not null then 'ok' else 'error' end as ml_status from v_claim", *_vs))
add("J12", lambda s, d: views.flat_claims(s, d).join(views.lines(s, d), "claim_key").groupBy("batch_id").agg(F.count("*").alias("n_lines")), cte("select batch_id, count(*) as n_lines from v_claim join v_lines using (claim_key) group by 1", *_vs))
add("O2", lambda s, d: views.flat_claims(s, d).where("batch_id = 5").orderBy("order_day", "claim_key").select("claim_key", _day("order_day")), cte("select claim_key, cast(order_day as string) as order_day from v_claim where batch_id = 5 order by 2, 1", *_vs))
add("W5", lambda s, d: views.flat_claims(s, d).orderBy(F.desc("order_day"), F.desc("claim_key")).offset(20).limit(20).select("claim_key"), cte("select claim_key from v_claim order by order_day desc, claim_key desc limit 20 offset 20", *_vs))
_w = lambda: Window.partitionBy("claim_key").orderBy("line_number", "l_partkey", "l_suppkey", "date_of_service", "l_quantity", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
_wd = "over (partition by claim_key order by line_number, l_partkey, l_suppkey, date_of_service, l_quantity, l_extendedprice rows unbounded preceding)"
add("W3", lambda s, d: views.lines(s, d).withColumn("g", F.sum(F.when(F.col("place_of_service") == "11", 1).otherwise(0)).over(_w())).groupBy("claim_key", "g").agg(F.count("*").alias("n")), cte(f"with x as (select claim_key, sum(case when place_of_service = '11' then 1 else 0 end) {_wd} as g from v_lines) select claim_key, cast(g as bigint) as g, count(*) as n from x group by 1, 2", "v_lines"))
add("W4", lambda s, d: views.lines(s, d).withColumn("h", F.last(F.when(F.col("place_of_service") == "11", F.col("line_number")), True).over(_w())).groupBy("claim_key", "h").agg(F.count("*").alias("n")), cte(f"with x as (select claim_key, last_value(case when place_of_service = '11' then line_number end ignore nulls) {_wd} as h from v_lines) select claim_key, h, count(*) as n from x group by 1, 2", "v_lines"))
add("O5", lambda s, d: views.flat_claims(s, d).groupBy("batch_id").agg(F.max_by("claim_key", F.struct("order_day", "claim_key")).alias("newest")), cte("select batch_id, arg_max(claim_key, (order_day, claim_key)) as newest from v_claim group by 1", *_vs))
_gold = "select claim_key, procedure_code as rule from v_lines"
add("T5", lambda s, d: files.golden_diff(_sql(s, d, _gold + " where l_partkey % 3 <> 0"), _sql(s, d, _gold + " where l_partkey % 4 <> 0")), cte(f"with e as (select distinct * from ({_gold} where l_partkey % 3 <> 0)), a as (select distinct * from ({_gold} where l_partkey % 4 <> 0)) select claim_key, rule, 'missing' as side from (select * from e except select * from a) union all select claim_key, rule, 'extra' from (select * from a except select * from e)", "v_lines"))

# scalar functions, one query each over a whole view
_L, _C = "v_lines", "v_claim"
_dt = lambda c: tx.to_day(F.col(c))
for _n, _t, _k, _e, _s in (
    ("S1", _L, "l_partkey", lambda: tx.is_weekend(_dt("date_of_service")).cast("int"), f"cast(isodow({_sd}) >= 6 as int)"),
    ("S2", _C, "claim_key", lambda: (tx.to_number(F.col("claim_amount")) > 50000).cast("int"), f"cast({rq.num('claim_amount')} > 50000 as int)"),
    ("S3", _C, "claim_key", lambda: F.col("taxonomy").startswith("207R").cast("int"), "cast(starts_with(taxonomy, '207R') as int)"),
    ("S4", _L, "l_partkey", lambda: F.col("procedure_code").isin("97110", "99285").cast("int"), "cast(procedure_code in ('97110', '99285') as int)"),
    ("S5", _L, "l_partkey", lambda: (_dt("date_of_service") > F.lit(rq.DAY).cast("date")).cast("int"), f"cast({_sd} > {rq.AS_OF} as int)"),
    ("S6", _C, "claim_key", lambda: (_dt("statement_to_date") < _dt("statement_from_date")).cast("int"), f"cast({rq.day('statement_to_date')} < {rq.day('statement_from_date')} as int)"),
    ("S7", _C, "claim_key", lambda: tx.is_npi_format(F.col("npi")).cast("int"), "cast(regexp_full_match(npi, '[0-9]{10}') as int)"),
    ("S8", _C, "claim_key", lambda: tx.is_valid_npi(F.col("npi")).cast("int"), f"cast({rq.NPI_OK} as int)"),
    ("S9", _C, "claim_key", lambda: tx.age_on(_dt("date_of_birth"), F.lit(rq.DAY).cast("date")), rq._AGE),
    ("S11", _L, "l_partkey", lambda: _dt("date_of_service").cast("string"), f"cast({_sd} as string)"),
    ("S12", _L, "l_partkey", lambda: tx.to_service_day(F.col("date_of_service")).cast("string"), f"cast({_sd} as string)"),
    ("S13", _C, "claim_key", lambda: tx.to_registry_day(F.date_format("order_day", "MM/dd/yyyy")).cast("string"), "cast(order_day as string)"),
    ("S14", _C, "claim_key", lambda: tx.provider_name(F.lit(1), F.lit(""), F.col("place_of_service"), F.coalesce("facility_type_code", F.lit(""))), "case when facility_type_code is null then place_of_service else concat(place_of_service, ', ', facility_type_code) end"),
    ("S15", _C, "claim_key", lambda: tx.entity_type(F.substring("place_of_service", 1, 1)), "case when place_of_service like '2%' then 2 else 1 end"),
    ("S16", _C, "claim_key", lambda: tx.to_number(F.col("claim_amount")), rq.num("claim_amount")),
    ("S17", _L, "l_partkey", lambda: tx.number_text(F.col("l_quantity") / 4), "case when l_quantity % 4 = 0 then cast(cast(l_quantity / 4 as bigint) as string) else rtrim(rtrim(cast(cast(l_quantity / 4 as decimal(20,4)) as string), '0'), '.') end"),
    ("S19", _C, "claim_key", lambda: tx.blank_to_null(F.concat(F.lit(" "), F.coalesce("facility_type_code", F.lit("")))), "facility_type_code"),
    ("S20", _C, "claim_key", lambda: tx.threshold_label(F.col("risk_score")), "case risk_score when 0.35 then '0_35' when 0.8 then '0_80' when 0.93 then '0_93' else 'custom' end"),
):
    add(_n, (lambda t, k, e: lambda s, d: table(t, lambda x: x.select(k, e().alias("value")))(s, d))(_t, _k, _e), cte(f"select {_k}, {_s} as value from {_t}", _t, "v_provider"))
add("S18", table("documents", lambda t: t.select("doc_id", F.sha2("text", 256).alias("digest"))), "select doc_id, sha256(text) as digest from documents")
add("S24", table("events", lambda t: t.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "string").alias("k"))), "select event_id, json_extract_string(props, '$.k') as k from events")

# streams as tables
_KEYED = "with e as (select user_id, event_type, ts, min(event_id) as event_id from events group by all), nx as (select e.user_id, e.event_type, e.ts, min(n.ts) as next_ts from e left join e n on e.user_id = n.user_id and e.event_type = n.event_type and n.ts > e.ts + interval 60 seconds group by all)"
add("ST4", table("events", lambda t: ingest.at_most_once(t, ["user_id", "event_type"], "ts", "event_id", 60).select("event_id")),
    _KEYED.replace("with e", "with recursive e") + ", a(user_id, event_type, ts) as (select user_id, event_type, min(ts) from e group by 1, 2 union all select nx.user_id, nx.event_type, nx.next_ts from a join nx using (user_id, event_type, ts) where nx.next_ts is not null) select event_id from a join e using (user_id, event_type, ts)")
# allowed events are few enough here that the window is 36 hours and the limit 2; the operator's own are 60 seconds and 1000
add("ST7", table("events", lambda t: ingest.rate_limited(t, ["user_id"], "ts", "event_id", 2, 129_600).select("user_id", "event_id", F.col("allowed").cast("int").alias("allowed"))),
    "with recursive e as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as n from events), a(user_id, event_id, n, allowed, last, before) as (select user_id, event_id, n, 1, ts, cast(null as timestamp) from e where n = 1 union all select e.user_id, e.event_id, e.n, case when before is null or before <= e.ts - interval 36 hours then 1 else 0 end, case when before is null or before <= e.ts - interval 36 hours then e.ts else last end, case when before is null or before <= e.ts - interval 36 hours then last else before end from a join e on e.user_id = a.user_id and e.n = a.n + 1) select user_id, event_id, allowed from a")

# rule overlap over trees of conditions: every part is a rule, its bounds written in one order or another
def _conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of each part's condition: bounds on a field, an OR, a NOT and a quantifier over lines."""
    node = lambda n, above, kind, op=None, field=None, low=None, text=None: F.struct(
        F.lit(n).alias("node"), F.array(*map(F.lit, above)).cast("array<int>").alias("ancestors"), F.lit(kind).alias("kind"), (op if op is not None else F.lit(None)).cast("string").alias("op"), (field if field is not None else F.lit(None)).cast("string").alias("field"),
        (low if low is not None else F.lit(None)).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(text).cast("string").alias("text"))
    lit, brand = F.lit, F.col("p_brand")
    low = lambda n, above: node(n, above, "cmp", F.when(F.col("p_partkey") % 2 == 0, ">").otherwise(">="), brand, F.col("p_size"))
    high = lambda n, above: node(n, above, "cmp", lit("<="), brand, F.col("p_size") + F.col("p_partkey") % 7)
    kind, tenure = (lambda n, above: node(n, above, "cmp", lit("="), lit("kind"), None, "x")), (lambda n, above: node(n, above, "cmp", lit("<"), lit("provider.tenure_days"), lit(90)))
    code = lambda n, above: node(n, above, "cmp", lit("="), lit("service_lines#0.procedure_code"), None, "99285")
    other = lambda n, above: node(n, above, "cmp", lit(">"), brand, lit(1))
    plain = [node(0, [], "and"), low(1, [0]), node(2, [0], "and"), high(3, [0, 2]), node(4, [0, 2], "or"), kind(5, [0, 2, 4]), tenure(6, [0, 2, 4]), node(7, [0], "not"), other(8, [0, 7]), node(9, [0], "exists", None, lit("service_lines")), code(10, [0, 9])]
    turned = [
        node(0, [], "and"), node(1, [0], "exists", None, lit("service_lines")), node(2, [0, 1], "and"), code(3, [0, 1, 2]), code(4, [0, 1, 2]), node(5, [0], "and"), high(6, [0, 5]), low(7, [0, 5]), low(8, [0, 5]), node(9, [0], "not"), node(10, [0, 9], "not"), node(11, [0, 9, 10], "not"),
        other(12, [0, 9, 10, 11]), node(13, [0], "or"), node(14, [0, 13], "or"), tenure(15, [0, 13, 14]), kind(16, [0, 13, 14]), kind(17, [0, 13]),
    ]
    views.register(spark, sf_dir)
    rows = spark.table("part").withColumn("nodes", F.when(F.col("p_partkey") % 4 < 2, F.array(*plain)).otherwise(F.array(*turned)))
    return rows.select(F.col("p_partkey").cast("string").alias("rule"), F.inline("nodes"))


def _constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conditions.constraints(_conditions(spark, sf_dir)).where("scope = ''")


_CON = "select cast(p_partkey as string) as rule, '' as scope, p_brand as field, cast(p_size as double) as low, p_partkey % 2 = 0 as low_open, cast(p_size + p_partkey % 7 as double) as high, false as high_open, cast(null as string) as text from part"
_CON_SQL = """select rule, '' as scope, field, low, cast(low_open as int) as low_open, cast(null as double) as high, cast(null as string) as text from ({c}) union all select rule, '', field, low, cast(low_open as int), null, null from ({c}) where cast(rule as int) % 4 >= 2
    union all select rule, '', field, null, 0, high, null from ({c}) union all select rule, 'service_lines', 'service_lines#0.procedure_code', null, 0, null, '99285' from ({c}) union all select rule, 'service_lines', 'service_lines#0.procedure_code', null, 0, null, '99285' from ({c}) where cast(rule as int) % 4 >= 2""".replace("{c}", _CON)
_IV = f"select rule, scope, field, max(low) as low, min(high) as high, bool_or(low_open) as low_open from ({_CON}) group by 1, 2, 3"
add("V1", lambda s, d: conditions.constraints(_conditions(s, d)).select("rule", "scope", "field", "low", F.col("low_open").cast("int").alias("low_open"), "high", "text"), _CON_SQL)
add("V2", lambda s, d: overlap.intervals(_constraints(s, d)).select("rule", "field", "low", "high", F.col("low_open").cast("int").alias("low_open")), f"select rule, field, low, high, cast(low_open as int) as low_open from ({_IV})")
_MEET = f"select a.rule as a, b.rule as b from ({_IV}) a join ({_IV}) b on a.field = b.field and a.rule < b.rule where greatest(a.low, b.low) < least(a.high, b.high) or (greatest(a.low, b.low) = least(a.high, b.high) and not (a.low_open and a.low = greatest(a.low, b.low)) and not (b.low_open and b.low = greatest(a.low, b.low)))"
# where rules hold a field of the lines' as well: such a field can make an overlap, but can't rule one out
_IV_ALL = f"select rule, scope, field, low, high, low_open, cast(null as string) as text from ({_IV}) union all select distinct rule, 'service_lines', 'service_lines#0.procedure_code', null, null, false, '99285' from ({_CON})"
_FITS = "case when a.text is not null or b.text is not null then coalesce(a.text = b.text, false) else greatest(a.low, b.low) < least(a.high, b.high) or (greatest(a.low, b.low) = least(a.high, b.high) and not (a.low_open and a.low = greatest(a.low, b.low)) and not (b.low_open and b.low = greatest(a.low, b.low))) end"
_MEET_ALL = f"select a, b from (select a.rule as a, b.rule as b, bool_or({_FITS}) as meets, bool_and(({_FITS}) or a.scope <> '') as possible from ({_IV_ALL}) a join ({_IV_ALL}) b on a.scope = b.scope and a.field = b.field and a.rule < b.rule group by 1, 2) where meets and possible"


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conditions.summaries(_conditions(spark, sf_dir))


def _bounded(told: DataFrame, everywhere: bool = True) -> DataFrame:
    """The constraints of the rules' conditions, on fields of the claim alone or of its items too."""
    rows = told.select("rule", F.inline_outer("constraints")).where("field is not null or low is not null or high is not null or text is not null")
    return rows if everywhere else rows.where("scope = ''")


add("V3", lambda s, d: overlap.overlapping(overlap.intervals(_bounded(_summaries(s, d)))), _MEET_ALL)
_CJ = f"select rule, cast(0 as int) as conjunct, concat(field, ':', cast(cast(low as int) as string), ':', cast(cast(high as int) as string), ':', cast(cast(low_open as int) as string)) as leaf, scope, field, low, low_open, high, high_open from ({_CON})"
_IMP = f"select p.rule as p, q.rule as q from ({_CJ}) p join ({_CJ}) q on p.field = q.field and p.rule <> q.rule where (p.low > q.low or (p.low = q.low and (not q.low_open or p.low_open))) and p.high <= q.high"


def _conjuncts(told: DataFrame) -> DataFrame:
    """What the rules' conditions join by AND, one by one."""
    return told.select("rule", F.inline_outer("conjuncts")).where("part is not null")


def _outcomes(told: DataFrame) -> DataFrame:
    """rule, condition (its digest) and outcome, as often as the rule comes."""
    rows = told.select("rule", "condition", F.when(F.col("rule").cast("int") % 5 == 0, "REJECT").otherwise("REVIEW").alias("outcome"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return rows.drop("copy")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rule, condition (its digest) and outcome."""
    return conditions.digests(_conditions(spark, sf_dir)).select("rule", F.col("digest").alias("condition"), F.when(F.col("rule").cast("int") % 5 == 0, "REJECT").otherwise("REVIEW").alias("outcome"))


add("V4", lambda s, d: overlap.implied(_conjuncts(_summaries(s, d))), _IMP)
_RU = f"select rule, leaf as condition, case when cast(rule as int) % 5 = 0 then 'REJECT' else 'REVIEW' end as outcome from ({_CJ})"


def _duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions that several rules have with one outcome: told apart by their digests, named by their bounds."""
    bounds = F.concat_ws(":", "field", *(F.col(c).cast("int").cast("string") for c in ("low", "high", "low_open")))
    named = overlap.intervals(_constraints(spark, sf_dir)).select("rule", bounds.alias("named"))
    found = _judged(spark, sf_dir).join(named.hint("merge"), "rule", "left").groupBy("condition", "outcome").agg(F.min("named").alias("named"), F.count("*").alias("n"), F.min("rule").alias("first_rule"))
    return found.where("n > 1").select(F.col("named").alias("condition"), "outcome", "n", "first_rule")


add("V5", _duplicates, f"select condition, outcome, count(*) as n, min(rule) as first_rule from ({_RU}) group by 1, 2 having count(*) > 1")
_LEV = f"with imp as (select distinct least(p, q) as a, greatest(p, q) as b from ({_IMP})), ov as ({_MEET}), ru as ({_RU}), pr as (select a, b from imp union select a, b from ov), lv as (select pr.a, pr.b, case when x.condition = y.condition and x.outcome = y.outcome then 'ExactDuplicate' when x.condition = y.condition then 'Shadowed' when imp.a is not null and x.outcome = y.outcome then 'Subsumption' when imp.a is not null then 'Shadowed' else 'ConditionOverlap' end as level from pr join ru x on x.rule = pr.a join ru y on y.rule = pr.b left join imp on imp.a = pr.a and imp.b = pr.b) "


def _compared(of: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], everywhere: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        told = _summaries(spark, sf_dir)
        return of(_outcomes(told), _conjuncts(told), _bounded(told, everywhere))

    return query


_TIER = "case level when 'Shadowed' then 'conflict' when 'ConditionOverlap' then 'overlap' else 'redundant' end"
_LEV_ALL = _LEV.replace(_MEET, _MEET_ALL)
add("V6", _compared(overlap.levels, True), _LEV_ALL + f"select a, b, level, {_TIER} as tier from lv")
add("A13", _compared(overlap.tiers, True), _LEV_ALL + f"select {_TIER} as tier, count(*) as n from lv group by 1")
add("V8", _compared(overlap.faulty, False), _LEV + f"select distinct unnest([a, b]) as rule from lv where {_TIER} <> 'overlap'")
add("J11", _compared(overlap.partners, False), _LEV + "select a, count(*) as n_pairs from lv group by 1")

# catalogue entries without logic in the reference: extensions
add("N1", table("v_lines", lambda t: t.withColumn("day", tx.to_day(F.col("date_of_service"))).where("day is not null").selectExpr("claim_key", "l_suppkey", "l_partkey", "day", "lag(day) over (partition by l_suppkey, l_partkey order by day, claim_key) as b").where("datediff(day, b) <= 30").groupBy("l_suppkey").agg(F.count("*").alias("n"))), cte(f"select l_suppkey, count(*) as n from (select l_suppkey, {_sd} as day, lag({_sd}) over (partition by l_suppkey, l_partkey order by {_sd}, claim_key) as b from v_lines where {_sd} is not null) where day - b <= 30 group by 1", "v_lines"))
# the same member at the same provider again within 30 days; the same day and procedure for another amount
add("N1_member", lambda s, d: ingest.within_days(views.flat_claims(s, d).where("npi is not null"), "claim_key", ["o_custkey", "npi"], "order_day", 30).select("first", "second", "o_custkey", "apart"),
    cte("select a.claim_key as first, b.claim_key as second, a.o_custkey, cast(b.order_day - a.order_day as int) as apart from v_claim a join v_claim b on a.o_custkey = b.o_custkey and a.npi = b.npi and (b.order_day, b.claim_key) > (a.order_day, a.claim_key) and b.order_day - a.order_day <= 30", *_vs))
add("N1_amount", lambda s, d: ingest.other_amounts(views.lines(s, d).where("l_suppkey is not null"), "claim_key", ["l_suppkey", "date_of_service", "procedure_code"], "charge_amount"),
    cte("select l_suppkey, date_of_service, procedure_code, count(*) as n_rows, count(distinct charge_amount) as n_amounts, min(claim_key) as first from v_lines group by 1, 2, 3 having count(distinct charge_amount) > 1", "v_lines"))
add("N2", lambda s, d: views.lines(s, d).join(s.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey").where("l_quantity > p_size").select("claim_key", "line_number", "l_partkey"), cte("select claim_key, line_number, l_partkey from v_lines join part on l_partkey = p_partkey where l_quantity > p_size", "v_lines"))
add("N3", table("v_lines", lambda t: t.groupBy("claim_key").agg(F.bool_or(F.col("procedure_code") == "99214").alias("x"), F.bool_or(F.col("procedure_code") == "99215").alias("y")).where("x and y").select("claim_key")), cte("select claim_key from v_lines group by 1 having bool_or(procedure_code = '99214') and bool_or(procedure_code = '99215')", "v_lines"))
_PAIRS = "select distinct case p_size % 4 when 0 then '99214' when 1 then '97110' when 2 then '99285' else '27447' end as one, case p_partkey % 3 when 0 then '99215' when 1 then '93306' else 'E0601' end as other from part where p_size % 3 = 0"
add("N3_table", lambda s, d: policy.unbundled(views.lines(s, d), _sql(s, d, _PAIRS)), cte(f"select distinct x.claim_key, one, other from v_lines x join ({_PAIRS}) on procedure_code = one join v_lines y on y.claim_key = x.claim_key and y.procedure_code = other", "v_lines"))
_AGES = "select distinct case p_size % 5 when 0 then '99385' when 1 then '93306' when 2 then '97110' when 3 then '99285' else '27447' end as procedure_code, cast(p_size % 5 * 10 as int) as low, cast(p_size % 5 * 10 + 25 as int) as high from part"
add("N8_table", lambda s, d: policy.age_mismatches(views.lines(s, d).join(views.flat_claims(s, d).select("claim_key", tx.age_on(tx.to_day(F.col("date_of_birth")), F.lit(rq.DAY).cast("date")).alias("age")), "claim_key"), _sql(s, d, _AGES)).select("claim_key", "line_number", "procedure_code", "age", "low", "high"),
    cte(f"select claim_key, line_number, l.procedure_code, age, low, high from v_lines l join (select claim_key, {rq._AGE} as age from v_claim) using (claim_key) join ({_AGES}) e on e.procedure_code = l.procedure_code where age < low or age > high", "v_lines", "v_claim"))
add("N4", lambda s, d: (lambda t: t.join(t.where("l_quantity > 25").select("procedure_code", "place_of_service").distinct(), ["procedure_code", "place_of_service"], "left_anti").groupBy("procedure_code").agg(F.count("*").alias("n")))(views.lines(s, d)), cte("select procedure_code, count(*) as n from v_lines x where not exists (select 1 from v_lines y where y.l_quantity > 25 and y.procedure_code = x.procedure_code and y.place_of_service = x.place_of_service) group by 1", "v_lines"))
add("N5", lambda s, d: views.flat_claims(s, d).join(views.registry(s, d).where("deactivation_date is not null").select("npi"), "npi", "left_semi").select("claim_key"), cte("select claim_key from v_claim where npi in (select npi from v_registry where deactivation_date is not null)", *_vs))
add("N6", lambda s, d: _sql(s, d, "select o_custkey, claim_key, size(collect_set(npi) over (partition by o_custkey order by order_day range between interval 90 days preceding and current row)) as n from v_claim").where("n >= 1").groupBy("o_custkey").agg(F.max("n").cast("bigint").alias("n")), cte("select a.o_custkey, max(n) as n from (select x.o_custkey, x.claim_key, count(distinct y.npi) as n from v_claim x join v_claim y on y.o_custkey = x.o_custkey and y.order_day between x.order_day - 90 and x.order_day group by 1, 2) a where n >= 1 group by 1", *_vs))
add("N7", table("events", lambda t: t.groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.count_distinct("event_type").alias("n")).where("n > 1")), "select user_id, cast(cast(ts as date) as string) as day, count(distinct event_type) as n from events group by 1, 2 having count(distinct event_type) > 1")
add("N8", lambda s, d: views.claims(s, d).where(R.RULES["R28"].condition(rq.claim()).truth).select("claim_key"), rq.facts_sql(f"select claim_key from f where {rq.RULE_SQL['R28']}"))
add("N9", table("v_lines", lambda t: t.withColumn("day", tx.to_day(F.col("date_of_service"))).where("day is not null").groupBy("l_suppkey", F.col("day").cast("string").alias("day")).agg(F.sum(F.col("l_quantity") * 20).alias("minutes")).where("minutes > 1440")), cte(f"select l_suppkey, cast({_sd} as string) as day, sum(l_quantity * 20) as minutes from v_lines where {_sd} is not null group by 1, 2 having sum(l_quantity * 20) > 1440", "v_lines"))
add("N10", table("v_lines", lambda t: t.withColumn("day", tx.to_day(F.col("date_of_service"))).where(F.datediff(F.lit("2002-01-01").cast("date"), "day") > 1500).groupBy("claim_key").agg(F.count("*").alias("n"))), cte(f"select claim_key, count(*) as n from v_lines where date '2002-01-01' - {_sd} > 1500 group by 1", "v_lines"))

# X12: interchanges written from the claims, then read back as tables
x12_files.register_queries(add)
claim_files.register_queries(add)


# peer groups
_SERVICES = """select l_suppkey as provider, l.claim_key as claim_key, o_custkey as patient, procedure_code as code,
    case when date_of_service <> 'unknown' then cast(substr(replace(date_of_service, '-', ''), 1, 4) as int) * 12 + cast(substr(replace(date_of_service, '-', ''), 5, 2) as int) end as month,
    cast(round(l_extendedprice * 100) as bigint) as cents from v_lines l join orders on o_orderkey = l.claim_key"""
_PROVIDERS = """select s.s_suppkey as provider, p.taxonomy as specialty, n.n_regionkey as region, {} as tenure_days
    from supplier s join v_provider p on p.s_suppkey = s.s_suppkey left join nation n on n.n_nationkey = s.s_nationkey left join v_registry r on r.npi = p.npi"""
_PEERS = ["specialty", "region"]


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.register(spark, sf_dir)
    return peers.features(spark.sql(_SERVICES), spark.sql(_PROVIDERS.format("datediff(date'2000-01-01', r.enumeration_date)")))


def _sketch_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = peers.tall(_features(spark, sf_dir), _PEERS)
    near = peers.sketched(values, _PEERS).select("provider", "feature", F.col("percentile").alias("near"))
    off = F.abs(F.col("near") - F.col("percentile")) <= 1 / 100 + 1 / 10_000 + F.when(F.col("peers") > 1, 1 / (F.col("peers") - 1)).otherwise(1)
    return peers.percentiles(values, _PEERS).join(near, ["provider", "feature"]).select("provider", "feature", off.cast("int").alias("holds"))


_features_sql = f"""services as ({_SERVICES}), providers as ({_PROVIDERS.format("date '2000-01-01' - r.enumeration_date")}),
    pat as (select provider, count(distinct patient) as patients, count(*) as services, sum(cents) as cents, count(distinct code) as codes, count(*) filter (code in ('99205', '99215')) as high from services group by 1),
    top as (select provider, max(n) as top from (select provider, code, count(*) as n from services where code is not null group by 1, 2) group by 1),
    mon as (select provider, month, count(distinct claim_key) as n from services where month is not null group by 1, 2),
    jump as (select a.provider, max(a.n - coalesce(b.n, 0)) as jump from mon a left join mon b on b.provider = a.provider and b.month = a.month - 1
        where exists (select 1 from mon c where c.provider = a.provider and c.month < a.month) group by 1),
    features as (select p.provider, specialty, region, cast(patients as double) as patients, services / nullif(patients, 0) as services_per_patient, cast(cents as double) / services / 100 as paid_per_service,
        cast(jump as double) as monthly_jump, high / services as high_visit_share, cast(codes as double) as codes, top / services as top_code_share, cast(tenure_days as double) as tenure_days
        from providers p join pat using (provider) left join top using (provider) left join jump using (provider)),
    tall as (""" + " union all ".join(f"select provider, specialty, region, '{n}' as feature, {n} as value from features where {n} is not null" for n in peers.FEATURES) + ")"
_rounded = ", ".join(f"round({n}, 6) as {n}" for n in peers.FEATURES)
add("PB1_features", lambda s, d: _features(s, d).selectExpr("provider", "specialty", "region", *(f"round({n}, 6) as {n}" for n in peers.FEATURES)), views.sql_with_views(f"with {_features_sql} select provider, specialty, region, {_rounded} from features"))
add("PB1", lambda s, d: peers.percentiles(peers.tall(_features(s, d), _PEERS), _PEERS).select("provider", *_PEERS, "feature", "peers", F.round("percentile", 6).alias("percentile"), F.round("peer_median", 6).alias("peer_median")), views.sql_with_views(
    f"with {_features_sql} select provider, specialty, region, feature, count(*) over w as peers, round(percent_rank() over (partition by specialty, region, feature order by value), 6) as percentile, round(median(value) over w, 6) as peer_median from tall window w as (partition by specialty, region, feature)"))
add("PB1_sketch", _sketch_holds, views.sql_with_views(f"with {_features_sql} select provider, feature, 1 as holds from tall"))
