"""X12 files written from the given tables, for the queries that read them back; and these queries.

A file holds a customer's claims from one run of RUN keys. Its claims are professional,
institutional and dental (a functional group each), in up to two transaction sets a group, the
second of them with a patient who isn't the subscriber. Files of some customers have a wrong
count, control number or end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import x12
from . import views
from .views import sql_with_views as cte

RUN = 131_072
VERSIONS = ("005010X222A1", "005010X223A2", "005010X224A2")
ISA = "ISA*00*          *00*          *ZZ*TESTSUBMIT01   *ZZ*STMED01        *261016*1200*^*00501*000000101*0*T*:"


def _seg(*elements: Column | str) -> Column:
    """A segment, unless one of its columns is NULL."""
    return F.concat(*(x for e in elements for x in (F.lit("*"), F.lit(e) if isinstance(e, str) else e.cast("string"))[(e is elements[0]) :]))


def _plain(day: Column) -> Column:
    return F.replace(day, F.lit("-"), F.lit(""))


def _lines(kind: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))

    def segs(x: Column, k: Column) -> Column:
        code, amount, units = x["procedure_code"], blank(x["charge_amount"]), blank(x["units"])
        place = F.when((k + 1) % 3 == 0, "").otherwise(x["place_of_service"])
        professional = _seg("SV1", F.concat(F.lit("HC:"), code), amount, "UN", units, place, "", "1")
        institutional = _seg("SV2", F.concat(F.lit("0"), (k + 301).cast("string")), F.concat(F.lit("HC:"), code), amount, "UN", units)
        dental = _seg("SV3", F.concat(F.lit("AD:"), code), amount, "", "", "", units)
        return F.array(
            _seg("LX", k + 1), F.when(kind == 0, professional).when(kind == 1, institutional).otherwise(dental), F.when(kind == 2, _seg("TOO", "JP", x["tooth_info"]["tooth_number"])),
            F.when((kind != 1) | (k % 2 == 0), _seg("DTP", "472", "D8", x["date_of_service"])),
        )

    return F.flatten(F.transform(F.coalesce("service_lines", F.array()), segs))


def _claim(kind: Column) -> Column:
    c, key, odd = F.col, F.col("claim_key"), F.col("claim_key") % 2 == 1
    often = F.when(key % 4 == 0, "7").when(key % 4 == 1, "8").otherwise("1")
    place = F.when(kind == 1, F.concat(F.coalesce("claim_details.facility_type_code", F.lit("13")), F.lit(":A:"), often)).otherwise(F.concat(c("claim_details.place_of_service"), F.lit(":B:"), often))
    begin = _plain(c("claim_details.statement_from_date"))
    period = F.concat(begin, F.lit("-"), F.coalesce(_plain(c("claim_details.statement_to_date")), begin))
    codes = F.array_join(F.transform("diagnosis_codes", lambda x: F.concat(F.lit("ABK:"), x["code"])), "*")
    own = F.array(
        _seg("CLM", c("claim_id"), F.coalesce("financial.claim_amount", F.lit("")), "", "", place, "Y", "A", "Y", "Y"), F.when(kind == 1, _seg("DTP", "434", "RD8", period)),
        F.when(kind == 1, _seg("DTP", "435", "DT", F.concat(begin, F.lit("1200")))).when(key % 5 == 0, _seg("DTP", "435", "D8", begin)), _seg("REF", "G1", c("authorization.authorization_number")), _seg("HI", codes),
        F.when(kind == 1, F.lit("HI*BE:A1::D8")), F.when(odd, _seg("NM1", "82", "1", "DOC", "ANN", "", "", "", "XX", c("provider.npi"))), F.when(odd, _seg("PRV", "PE", "PXC", c("billing_provider.taxonomy"))),
    )
    return F.filter(F.concat(own, _lines(kind)), lambda s: s.isNotNull())


def _head(kind: Column, st: Column) -> Column:
    """A transaction set up to its first claim."""
    c, dependent = F.col, F.col("st") == 1
    customer = c("o_custkey").cast("string")
    version = F.element_at(F.array(*map(F.lit, VERSIONS)), (kind + 1).cast("int"))
    street = lambda name: _seg("N3", F.concat(customer, F.lit(name)))
    segs = (
        _seg("ST", "837", c("set_id"), version), F.lit("BHT*0019*00*T1*20261016*1200*CH"), _seg("NM1", "41", "2", F.concat(F.lit("SUBMITTER "), st.cast("string")), "", "", "", "", "46", F.concat(F.lit("S"), st.cast("string"))),
        F.when(kind != 2, _seg("PER", "IC", F.concat(F.lit("DESK "), kind.cast("string")), "TE", F.concat(F.lit("555"), customer))), F.lit("NM1*40*2*PAYER*****46*P1"), F.lit("HL*1**20*1"), _seg("PRV", "BI", "PXC", c("taxonomy")),
        _seg("NM1", "85", "2", F.concat(F.lit("CLINIC "), customer), "", "", "", "", "XX", F.coalesce("npi", F.lit(""))), street(" MAIN ST"), F.lit("N4*SPRINGFIELD*IL*62701"), _seg("REF", "EI", customer),
        _seg("HL", "2", "1", "22", st), _seg("SBR", "P", F.when(dependent, "").otherwise("18"), F.concat(F.lit("G"), customer)), _seg("NM1", "IL", "1", "MEMBER", "ALEX", "", "", "", "MI", c("member_id")), street(" ELM ST"),
        _seg("N4", F.concat(F.lit("CITY "), kind.cast("string")), "TX", "75001"), _seg("DMG", "D8", _plain(c("birth")), "F"), _seg("NM1", "PR", "2", "PAYER", "", "", "", "", "PI", F.concat(F.lit("P"), kind.cast("string"))),
        *(F.when(dependent, s) for s in ("HL*3*2*23*0", "PAT*19", "NM1*QC*1*CHILD*KIM", "DMG*D8*20010203*M")),
    )
    return F.filter(F.array(*segs), lambda s: s.isNotNull())


def interchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id and text of one X12 file for each customer and run of claims."""
    key, customer = F.col("claim_key"), F.col("o_custkey").cast("string")
    file_id = F.concat(customer, F.lit("-"), F.floor(key / RUN).cast("string"))
    rows = views.claims(spark, sf_dir).select("o_custkey", "claim_key", _claim(key % 3).alias("segs"), F.col("provider.npi"), F.col("billing_provider.taxonomy"), F.col("patient.date_of_birth").alias("birth"))
    # a claim is shuffled as text, without what its keys tell
    rows = rows.withColumns({"n": F.size("segs"), "text": F.nullif(F.array_join("segs", "~"), F.lit(""))}).drop("segs")
    # what is read of a file is many times its text, so tasks are dealt by claims, not by the size of texts
    rows = rows.repartition(views.claim_tasks(spark), file_id).withColumns({"file_id": file_id, "kind": key % 3, "st": F.floor(key / 3) % 2})
    sets = rows.groupBy("file_id", "o_custkey", "kind", "st").agg(
        F.array_sort(F.collect_list(F.struct("claim_key", "text"))).alias("claims"), F.sum("n").alias("n"), *(F.max(x).alias(x) for x in ("npi", "taxonomy", "birth")),
    ).withColumns({"set_id": F.concat(F.lit("000"), (F.col("kind") * 2 + F.col("st") + 1).cast("string")), "member_id": F.concat(F.lit("M"), customer)})
    sets = sets.withColumn("head", _head(F.col("kind"), F.col("st")))
    size = F.size("head") + F.col("n") + 1 + F.when(F.col("o_custkey") % 10 == 3, 1).otherwise(0)
    text = F.concat(F.array_join(F.concat("head", "claims.text"), "~"), F.lit("~"), _seg("SE", size, F.col("set_id")))
    files = sets.select("file_id", "o_custkey", F.struct("kind", "st", text.alias("text")).alias("x")).groupBy("file_id", "o_custkey").agg(F.array_sort(F.collect_list("x")).alias("x"))

    def group(k: int) -> Column:
        mine = F.filter("x", lambda x: x["kind"] == k)
        whole = F.concat(F.lit(f"GS*HC*TESTSUBMIT0{k}*STMED01*20261016*1200*{101 + k}*X*{VERSIONS[k]}~"), F.array_join(F.transform(mine, lambda x: x["text"]), "~"), F.lit("~GE*"), F.size(mine).cast("string"), F.lit(f"*{101 + k}"))
        return F.when(F.size(mine) > 0, whole)

    groups = F.filter(F.array(*map(group, range(3))), lambda g: g.isNotNull())
    end = F.when(F.col("o_custkey") % 10 == 7, "").otherwise(F.concat(F.lit("IEA*"), F.size(groups).cast("string"), F.when(F.col("o_custkey") % 10 == 5, "*000000999~").otherwise("*000000101~")))
    return files.select("file_id", F.concat(F.lit(ISA + "~"), F.array_join(groups, "~"), F.lit("~"), end).alias("text"))


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x12.claims(interchanges(spark, sf_dir))


def _codes(claims: DataFrame) -> DataFrame:
    """The codes of both lists of each claim, from one reading."""
    told = lambda name, codes: F.transform(F.coalesce(codes, F.array()), lambda x: F.struct(F.lit(name).alias("list"), x["code"].alias("code"), x["qualifier"].alias("qualifier")))
    # outer: a plain inline would first filter claims by the size of their codes
    rows = claims.select("claim_id", F.inline_outer(F.concat(told("diagnosis", F.col("diagnosis_codes")), told("other", F.col("other_codes")))))
    return rows.where("list is not null")


#: The files' claims, lines and sets as the check's SQL sees them; g: claims of the files without an envelope error.
_SQL = f"""with x as (select *, claim_key % 3 as kind, (claim_key // 3) % 2 as st, concat(o_custkey, '-', claim_key // {RUN}) as file_id from v_claim),
li as (select *, row_number() over (partition by claim_key order by line_number, l_partkey, l_suppkey, date_of_service, l_quantity, l_extendedprice) as k from v_lines),
lc as (select claim_key, count(*) as n_lines, count(*) filter (k % 2 = 0) as n_even, count(tooth_number) as n_tooth from li group by 1),
z as (select x.*, coalesce(n_lines, 0) as n_lines, case when kind = 1 then coalesce(n_lines - n_even, 0) else coalesce(n_lines, 0) end as n_472, case when kind = 2 then coalesce(n_tooth, 0) else 0 end as n_too,
      cast(authorization_number is not null as int) as n_ref, cast(exists (select 1 from v_dx d where d.claim_key = x.claim_key) as int) + cast(kind = 1 as int) as n_hi,
      case when kind = 1 then 2 when claim_key % 5 = 0 then 1 else 0 end as n_dtp, cast(claim_key % 2 = 1 and npi is not null as int) as n_82, cast(claim_key % 2 = 1 and taxonomy is not null as int) as n_pe from x left join lc using (claim_key)),
s as (select file_id, o_custkey, kind, st, cast(kind <> 2 as int) as n_per, cast(max(taxonomy) is not null as int) as n_bi, cast(max(date_of_birth) is not null as int) as n_dmg, cast(st as int) as dep,
      sum(n_ref) as n_ref, sum(n_hi) as n_hi, sum(n_lines) as n_lines, sum(n_472 + n_dtp) as n_dtp, sum(n_too) as n_too, sum(n_82) as n_82, sum(n_pe) as n_pe, count(*) as n_clm from z group by 1, 2, 3, 4),
t as (select *, 16 + n_per + n_bi + n_dmg + 4 * dep + n_clm + n_ref + n_hi + 2 * n_lines + n_dtp + n_too + n_82 + n_pe as n from s),
g as (select * from x where o_custkey % 10 not in (3, 5, 7)) """
_VIEWS = ("v_claim", "v_lines", "v_dx")
_REASONS = """select file_id, case o_custkey % 10 when 3 then concat('SE segment count is ', arg_min(n, kind * 2 + st) + 1, ' but transaction set 000', min(kind * 2 + st) + 1, ' has ', arg_min(n, kind * 2 + st), ' segments')
    when 5 then 'Interchange control number mismatch' else 'Incomplete transmission: the last segment is not IEA' end as reason from t where o_custkey % 10 in (3, 5, 7) group by file_id, o_custkey"""
#: How many segments of each kind a set holds, beside those of files and groups.
_PER_SET = {
    "ST": "1", "BHT": "1", "SBR": "1", "SE": "1", "PER": "n_per", "HL": "2 + dep", "PAT": "dep", "N3": "2", "N4": "2", "PRV": "n_bi + n_pe", "NM1": "5 + dep + n_82", "DMG": "n_dmg + dep", "CLM": "n_clm",
    "REF": "1 + n_ref", "HI": "n_hi", "LX": "n_lines", "DTP": "n_dtp", "TOO": "n_too", "SV1": "case when kind = 0 then n_lines else 0 end", "SV2": "case when kind = 1 then n_lines else 0 end", "SV3": "case when kind = 2 then n_lines else 0 end",
}
_COUNTS = " union all ".join([
    *(f"select '{k}' as seg_id, sum({n}) as n from t" for k, n in _PER_SET.items()), "select 'ISA', count(distinct file_id) from t", "select 'IEA', count(distinct file_id) from t where o_custkey % 10 <> 7",
    *(f"select '{k}', count(distinct file_id || '/' || kind) from t" for k in ("GS", "GE")),
])
_AMOUNT = "case when claim_amount <> 'abc' then rtrim(rtrim(claim_amount, '0'), '.') end"
_FROM = "replace(statement_from_date, '-', '')"
_TO = "replace(statement_to_date, '-', '')"
_BIRTH = "replace(date_of_birth, '-', '')"


def register_queries(add) -> None:
    sql = lambda body: cte(_SQL + body, *_VIEWS)
    col = F.col
    add("SRC2", lambda s, d: x12.segments(interchanges(s, d)).groupBy("seg_id").agg(F.count("*").alias("n")), sql(f"select seg_id, cast(sum(n) as bigint) as n from ({_COUNTS}) group by 1 having sum(n) > 0"))
    add("X1", lambda s, d: x12.envelope_errors(interchanges(s, d)), sql(_REASONS))
    add("X2", lambda s, d: x12.numbered(x12.segments(interchanges(s, d))).groupBy("file_id").agg(F.max("ts_no").alias("n_sets")), sql("select file_id, count(*) as n_sets from s group by 1"))
    add("X3", lambda s, d: read(s, d).select("file_id", F.col("ts_no").cast("long").alias("ts_no"), "claim_id", "subscriber.member_id"),
        sql(", n as (select file_id, kind, st, row_number() over (partition by file_id order by kind, st) as ts_no from s) select file_id, ts_no, claim_id, concat('M', o_custkey) as member_id from g join n using (file_id, kind, st)"))
    add("X4", lambda s, d: x12.claim_names(read(s, d)).select("name"), sql("select case when count(*) over (partition by file_id, kind, st) = 1 then concat(file_id, '.json') else concat(file_id, '_', claim_id, '.json') end as name from g"))
    add("X5", lambda s, d: read(s, d).groupBy("transaction_type").agg(F.count("*").alias("n")), sql("select case kind when 0 then '837P' when 1 then '837I' else '837D' end as transaction_type, count(*) as n from g group by 1"))
    add("X6", lambda s, d: read(s, d).select(
        "claim_id", col("submitter.name").alias("submitter"), "submitter.id", "submitter.contact_name", "submitter.contact_phone", col("receiver.name").alias("receiver"), "interchange.control_number", "interchange.sender_id", "interchange.usage_indicator",
        "functional_group.sender_code", "functional_group.version", col("billing_provider.name").alias("clinic"), "billing_provider.npi", "billing_provider.taxonomy", "billing_provider.tax_id", "billing_provider.address.street", "billing_provider.address.zip",
    ), sql("""select claim_id, concat('SUBMITTER ', st) as submitter, concat('S', st) as id, case when kind <> 2 then concat('DESK ', kind) end as contact_name, case when kind <> 2 then concat('555', o_custkey) end as contact_phone, 'PAYER' as receiver,
        '000000101' as control_number, 'TESTSUBMIT01' as sender_id, 'T' as usage_indicator, concat('TESTSUBMIT0', kind) as sender_code, case kind when 0 then '005010X222A1' when 1 then '005010X223A2' else '005010X224A2' end as version,
        concat('CLINIC ', o_custkey) as clinic, npi, taxonomy, cast(o_custkey as string) as tax_id, concat(o_custkey, ' MAIN ST') as street, '62701' as zip from g"""))
    add("X7", lambda s, d: read(s, d).select(
        "claim_id", col("patient.name.first").alias("first"), "patient.date_of_birth", "patient.gender", "payer.payer_id", col("subscriber.date_of_birth").alias("subscriber_birth"), "subscriber.relationship_code", "subscriber.group_number",
        "subscriber.payer_responsibility", "subscriber.address.street", "subscriber.address.city", col("rendering_provider.npi").alias("rendering"), "rendering_provider.taxonomy_code",
    ), sql(f"""select claim_id, case when st = 1 then 'KIM' else 'ALEX' end as first, case when st = 1 then '20010203' else {_BIRTH} end as date_of_birth, case when st = 1 then 'M' when date_of_birth is not null then 'F' end as gender, concat('P', kind) as payer_id,
        {_BIRTH} as subscriber_birth, case when st = 0 then '18' end as relationship_code, concat('G', o_custkey) as group_number, 'P' as payer_responsibility, concat(o_custkey, ' ELM ST') as street, concat('CITY ', kind) as city,
        case when claim_key % 2 = 1 then npi end as rendering, case when claim_key % 2 = 1 then taxonomy end as taxonomy_code from g"""))
    add("X8", lambda s, d: read(s, d).select("claim_id", "claim_details.statement_from_date", "claim_details.statement_to_date", "claim_details.admission_date"),
        sql(f"select claim_id, case when kind = 1 then {_FROM} end as statement_from_date, case when kind = 1 and {_TO} <> {_FROM} then {_TO} end as statement_to_date, case when kind = 1 or claim_key % 5 = 0 then {_FROM} end as admission_date from g"))
    add("X9", lambda s, d: _codes(read(s, d)),
        sql("select claim_id, 'diagnosis' as list, code, 'ABK' as qualifier from g join v_dx using (claim_key) union all select claim_id, 'other', 'A1', 'BE' from g where kind = 1"))
    add("X10", lambda s, d: read(s, d).select("claim_id", "claim_details.place_of_service", "claim_details.facility_type_code", "claim_details.frequency_code"),
        sql("select claim_id, case when kind <> 1 then place_of_service end as place_of_service, case when kind = 1 then coalesce(facility_type_code, '13') end as facility_type_code, case claim_key % 4 when 0 then '7' when 1 then '8' else '1' end as frequency_code from g"))
    # outer: a plain inline would first filter claims by the size of their lines, and so tell the lines twice
    add("X11", lambda s, d: read(s, d).select("claim_id", F.inline_outer("service_lines")).where("line_number is not null").select("claim_id", "line_number", *x12.LINE[1:-1], "tooth_info.tooth_number"), sql(f"""select claim_id, cast(k as int) as line_number,
        case when kind = 1 and k % 2 = 0 then {_FROM} else date_of_service end as date_of_service, cast(null as string) as date_of_service_end, case when kind = 1 then null when kind = 2 or k % 3 = 0 then g.place_of_service else l.place_of_service end as place_of_service,
        procedure_code, case when kind = 2 then 'AD' else 'HC' end as procedure_qualifier, charge_amount, units, case when kind <> 2 then 'UN' end as unit_type, case when kind = 0 then '1' end as diagnosis_pointer,
        case when kind = 1 then concat('0', k + 300) end as revenue_code, case when kind = 2 then tooth_number end as tooth_number from g join li l using (claim_key)"""))
    add("X12", lambda s, d: read(s, d).select("claim_id", "financial.claim_amount", "claim_totals.total_charges", "authorization.authorization_number"), sql(f"select claim_id, {_AMOUNT} as claim_amount, {_AMOUNT} as total_charges, authorization_number from g"))
    add("X13", lambda s, d: x12.rejected(interchanges(s, d)).groupBy("reason").agg(F.count("*").alias("n")), sql(f", y as ({_REASONS}) select reason, count(*) as n from y group by 1"))
