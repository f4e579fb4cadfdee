"""X12 837 interchanges as tables: segments, envelope errors, and nested claims.

Everything is windows and grouping keyed by file, so work spreads over files. A segment
row has its number in the file, its id and its elements (element 0 is the id).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Qualifiers of diagnosis codes, and version parts that tell the claim type.
DIAGNOSIS = ("ABK", "ABJ", "ABF", "ABN", "APR", "BK", "BJ", "BF", "BN", "PR")
TYPES = (("837P", ("X098", "X222")), ("837I", ("X096", "X223")), ("837D", ("X097", "X224")))

BLANK = " \t\n\x0b\f\r"


def element(k: int) -> Column:
    return tx.blank_to_null(F.get("elements", F.lit(k)))


def delimited(files: DataFrame) -> DataFrame:
    """files(file_id, text) with the delimiters of each, and what is wrong with its first segment."""
    clean = F.regexp_replace("text", "\\A[\\uFEFF\\s]+", "")
    rows = files.select("file_id", clean.alias("text"))
    isa = F.substring("text", 1, 106)
    sep = F.substring("text", 4, 1)
    wrong = (
        F.when(~F.col("text").startswith("ISA"), "An X12 file must start with ISA")
        .when(F.length("text") < 106, "The ISA segment is too short")
        .when(F.length(F.call_function("substring_index", isa, sep, F.lit(16))) != 103, "The ISA segment is not the standard fixed width")
    )
    return rows.select("file_id", "text", sep.alias("element"), F.substring("text", 105, 1).alias("sub"), F.substring("text", 106, 1).alias("term"), wrong.alias("wrong"))


def _quoted(c: str) -> Column:
    """As the delimiter of a split: one character, with a backslash where that has no meaning of its own, is no pattern to compile."""
    return F.when(F.col(c).rlike("[0-9A-Za-z]"), F.col(c)).otherwise(F.concat(F.lit("\\"), F.col(c)))


def _cut(files: DataFrame) -> DataFrame:
    """Files with their segments as texts (``segs``; NULL where they can't be read) and the delimiters as those of a split."""
    rows = delimited(files)
    segs = F.filter(F.transform(F.split("text", _quoted("term")), lambda s: F.ltrim(F.trim(s), F.lit(BLANK))), lambda s: s != "")
    return rows.select("file_id", "element", "sub", "wrong", F.when(F.col("wrong").isNull(), segs).alias("segs"), _quoted("element").alias("element_by"), _quoted("sub").alias("sub_by"))


def _parsed(files: DataFrame) -> DataFrame:
    """Segments of readable files; of each other file one row without a number, with what is wrong."""
    each = _cut(files).select("file_id", "element_by", "sub", "wrong", F.posexplode_outer("segs").alias("at", "raw"))
    each = each.select("file_id", (F.col("at") + 1).alias("seg_no"), F.split("raw", F.col("element_by")).alias("elements"), "sub", "wrong")
    return each.select("file_id", "seg_no", F.get("elements", F.lit(0)).alias("seg_id"), "elements", "sub", "wrong")


def segments(files: DataFrame) -> DataFrame:
    """file_id, seg_no (from 1), seg_id, elements, sub, of readable files."""
    return _parsed(files).where("seg_no is not null").drop("wrong")


def _running(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("seg_no").rowsBetween(Window.unboundedPreceding, 0)


def numbered(segs: DataFrame) -> DataFrame:
    """Running ids: transaction set, open loops by level, claim, and line within the claim; the open interchange, group and party."""
    w = _running("file_id")
    is_ = lambda s: F.col("seg_id") == s
    level = F.when(is_("HL"), F.coalesce(element(3), F.lit("")))
    rows = segs.withColumns({
        "ts_no": F.sum(F.when(is_("ST"), 1).otherwise(0)).over(w),
        "hl20": F.last(F.when(level == "20", F.col("seg_no")), True).over(w),
        "last22": F.last(F.when(level == "22", F.col("seg_no")), True).over(w),
        "last23": F.last(F.when(~level.isin("20", "22"), F.col("seg_no")), True).over(w),
        "clm": F.last(F.when(is_("CLM"), F.col("seg_no")), True).over(w),
        "lx": F.sum(F.when(is_("LX"), 1).otherwise(0)).over(w),
        "stop": F.last(F.when(is_("HL") | is_("SE") | is_("ST"), F.col("seg_no")), True).over(w),
        "isa": F.last(F.when(is_("ISA"), F.col("elements")), True).over(w),
        "gs": F.last(F.when(is_("GS"), F.col("elements")), True).over(w),
        "party": F.last(F.when(is_("NM1"), F.coalesce(element(1), F.lit(""))).when(F.col("seg_id").isin("HL", "CLM", "ST"), ""), True).over(w),
    })
    rows = rows.withColumns({"hl22": F.when(F.col("last22") > F.coalesce("hl20", F.lit(0)), F.col("last22")), "claim_no": F.when(F.col("clm") > F.coalesce("stop", F.lit(0)), F.col("clm"))})
    rows = rows.withColumn("hl23", F.when(F.col("last23") > F.greatest(F.coalesce("hl20", F.lit(0)), F.coalesce("hl22", F.lit(0))), F.col("last23")))
    # told from the file's lines before the claim, so that the order of the file is the only one asked for
    line = F.col("lx") - F.last(F.when(is_("CLM"), F.col("lx")), True).over(w)
    return rows.withColumn("lx_no", F.when(F.col("claim_no").isNotNull() & (line > 0), line)).drop("last22", "last23", "clm", "stop", "lx")


def _id_of(raw: Column) -> Column:
    return F.call_function("substring_index", raw, F.col("element"), F.lit(1))


#: The segments that an interchange is told from.
ENVELOPE = ("ISA", "IEA", "GS", "GE", "ST", "SE")


def _judged(files: DataFrame) -> DataFrame:
    """Files as ``_cut`` makes them, with the first envelope error of each in ``reason``.

    Nothing is shuffled or ordered: the few segments of a file's envelope are gone through once, with what is open kept along.
    """
    rows = _cut(files)
    named = F.filter(F.transform("segs", lambda s, i: F.struct((i + 1).alias("no"), s.alias("raw"))), lambda x: _id_of(x["raw"]).isin(*ENVELOPE))
    rows = rows.withColumn("envelope", F.transform(named, lambda x: F.struct(x["no"].alias("no"), F.split(x["raw"], F.col("element_by")).alias("e"))))
    text, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    start = {f"n_{s}": F.lit(0) for s in ENVELOPE} | {"st_at": number, "sets_before": number, "groups_before": number, "st_id": text, "gs_id": text, "isa_id": text, "error": text}

    def step(held: Column, x: Column) -> Column:
        element = lambda k: tx.blank_to_null(F.get(x["e"], F.lit(k)))
        is_ = lambda s: F.get(x["e"], F.lit(0)) == s
        n = {s: held[f"n_{s}"] + F.when(is_(s), 1).otherwise(0) for s in ENVELOPE}
        open_ = lambda a, b: n[a] - n[b]
        said = lambda k: F.coalesce(element(k).try_cast("int"), F.lit(-1))
        size = x["no"] - held["st_at"] + 1
        error = (
            F.when(is_("ISA") & (open_("ISA", "IEA") > 1), "Incomplete transmission: ISA before the open one is closed")
            .when(is_("GS") & (open_("GS", "GE") > 1), "Incomplete transmission: GS before the open one is closed")
            .when(is_("ST") & (open_("ST", "SE") > 1), "Incomplete transmission: ST before the open one is closed")
            .when(is_("GS") & (open_("ISA", "IEA") < 1), "GS outside an interchange").when(is_("ST") & (open_("GS", "GE") < 1), "ST outside a functional group")
            .when(is_("SE") & (open_("ST", "SE") < 0), "SE without a matching ST").when(is_("GE") & (open_("GS", "GE") < 0), "GE without a matching GS").when(is_("IEA") & (open_("ISA", "IEA") < 0), "IEA without a matching ISA")
            .when(is_("SE") & (said(1) != size), F.concat(F.lit("SE segment count is "), F.coalesce(element(1), F.lit("")), F.lit(" but transaction set "), F.coalesce(held["st_id"], F.lit("")), F.lit(" has "), size.cast("string"), F.lit(" segments")))
            .when(is_("SE") & ~element(2).eqNullSafe(held["st_id"]), "Transaction set control number mismatch")
            .when(is_("GE") & (said(1) != n["ST"] - held["sets_before"]), F.concat(F.lit("GE says "), F.coalesce(element(1), F.lit("")), F.lit(" transaction sets")))
            .when(is_("GE") & ~element(2).eqNullSafe(held["gs_id"]), "Functional group control number mismatch")
            .when(is_("IEA") & (said(1) != n["GS"] - held["groups_before"]), F.concat(F.lit("IEA says "), F.coalesce(element(1), F.lit("")), F.lit(" functional groups")))
            .when(is_("IEA") & ~element(2).eqNullSafe(held["isa_id"]), "Interchange control number mismatch")
        )
        # what the last segment of a kind says; where it says nothing, what one before it said
        last = lambda s, c, name: F.when(is_(s), F.coalesce(c, held[name])).otherwise(held[name])
        then = {f"n_{s}": c for s, c in n.items()} | {
            "st_at": last("ST", x["no"], "st_at"), "sets_before": last("GS", held["n_ST"], "sets_before"), "groups_before": last("ISA", held["n_GS"], "groups_before"),
            "st_id": last("ST", element(2), "st_id"), "gs_id": last("GS", element(6), "gs_id"), "isa_id": last("ISA", element(13), "isa_id"), "error": F.coalesce(held["error"], error),
        }
        return F.struct(*(c.alias(k) for k, c in then.items()))

    found = F.aggregate("envelope", F.struct(*(c.alias(k) for k, c in start.items())), step)["error"]
    # an end without IEA comes before every other error
    ends = F.when(_id_of(F.get("segs", F.size("segs") - 1)) != "IEA", "Incomplete transmission: the last segment is not IEA")
    return rows.select(*(c for c in rows.columns if c not in ("wrong", "envelope")), F.coalesce("wrong", ends, found).alias("reason"))


def envelope_errors(files: DataFrame) -> DataFrame:
    """file_id, reason: the first envelope error of each file that has one."""
    # taken out of an array: a plain filter on it, or on the array's size, would go below and judge the files once more
    return _judged(files).select("file_id", F.explode_outer(F.array("reason")).alias("reason")).where("reason is not null")


def transaction_type(version: Column, styles: Column) -> Column:
    out = None
    for name, parts in TYPES:
        test = version.contains(parts[0]) | version.contains(parts[1])
        out = F.when(test, name) if out is None else out.when(test, name)
    for name, style in (("837P", "SV1"), ("837I", "SV2"), ("837D", "SV3")):
        out = out.when(F.array_contains(styles, style), name)
    return out.otherwise("837")


def _period(kind: Column, value: Column) -> tuple[Column, Column]:
    """Begin and end of a date or a range; a range of one day has no end."""
    two = F.split(value, "-", 2)
    first, second = F.get(two, F.lit(0)), F.get(two, F.lit(1))
    return F.when(kind == "RD8", first).otherwise(value), F.when((kind == "RD8") & (first != second), second)


LINE = (
    "line_number", "date_of_service", "date_of_service_end", "place_of_service", "procedure_code", "procedure_qualifier", "charge_amount", "units", "unit_type", "diagnosis_pointer", "revenue_code", "tooth_info",
)


PARTIES = ("submitter", "contact", "receiver", "clinic", "prv", "tax", "clinic_n3", "clinic_n4", "sbr", "il", "il_n3", "il_n4", "il_dmg", "pr", "qc", "qc_dmg")


def _at(e: Column, k: int) -> Column:
    return tx.blank_to_null(F.get(e, F.lit(k)))


def _is(e: Column, s: str, qualifier: str | None = None) -> Column:
    """Whether a segment, by its elements, is of a kind."""
    named = F.get(e, F.lit(0)) == s
    return named if qualifier is None else named & (_at(e, 1) == qualifier)


def _first(segs: Column, where: Callable[[Column], Column]) -> Column:
    """The first segment of that kind, by its elements."""
    return F.get(F.filter(segs, where), F.lit(0))


def _told(e: Column, *at: int) -> Column:
    return F.when(e.isNotNull(), F.struct(*(_at(e, k).alias(f"e{k}") for k in at)))


def _split_at(segs: str, where: Callable[[Column], Column], starts: str) -> tuple[Column, Callable[[], Column]]:
    """Where such segments stand, as a column that is to be named ``starts``; and the segments from each of them to before the next."""
    found = F.array_compact(F.transform(segs, lambda e, i: F.when(where(e), i + 1)))
    return found, lambda: F.transform(starts, lambda p, k: F.slice(segs, p, F.coalesce(F.get(starts, k + 1), F.size(segs) + 1) - p))


def _line() -> Callable[[Column], Column]:
    """A service line, over its segments' elements: what it is told from first, then its fields."""
    at, sub = _at, F.col("sub_by")

    def fields(x: Column) -> Column:
        sv, code = x["sv"], x["code"]
        style = F.get(sv, F.lit(0))
        begin, end = _period(x["dtp"]["e2"], x["dtp"]["e3"])
        second = style == "SV2"
        pick = lambda one, two, three: F.when(style == "SV1", at(sv, one)).when(second, at(sv, two)).otherwise(at(sv, three) if three else F.lit(None))
        values = (
            x["lx_no"], begin, end, F.when(style == "SV1", at(sv, 5)), F.get(code, F.lit(1)), F.get(code, F.lit(0)), pick(2, 3, 2), pick(4, 5, 6), pick(3, 4, 0),
            F.when(style == "SV1", at(sv, 7)), F.when(second, at(sv, 1)), x["too"],
        )
        return F.struct(*(c.alias(k) for k, c in zip(LINE, values, strict=True)))

    def told(segs: Column, k: Column) -> Column:
        sv = _first(segs, lambda e: F.get(e, F.lit(0)).isin("SV1", "SV2", "SV3"))
        too = _first(segs, lambda e: _is(e, "TOO"))
        tooth = F.when(too.isNotNull(), F.struct(at(too, 1).alias("tooth_code_qualifier"), at(too, 2).alias("tooth_number"), at(too, 3).alias("tooth_surface")))
        return F.struct((k + 1).alias("lx_no"), sv.alias("sv"), _told(_first(segs, lambda e: _is(e, "DTP", "472")), 2, 3).alias("dtp"), tooth.alias("too"))

    def coded(x: Column) -> Column:
        code = F.split(F.when(F.get(x["sv"], F.lit(0)) == "SV2", at(x["sv"], 2)).otherwise(at(x["sv"], 1)), sub)
        return x.withField("code", code)

    return told, coded, fields


#: The segments that tell of an interchange, a group or a party.
NAMING = ("ISA", "GS", "NM1", "PER", "PRV", "REF", "N3", "N4", "SBR", "DMG")
#: What opens a section of a file: a transaction set, a loop, a claim. Until the next of them all belongs to it.
SECTIONS = ("ST", "HL", "CLM")


def _sections(files: DataFrame) -> DataFrame:
    """The sections of the files without an envelope error: file_id, sub_by, seg_no and seg_id of the first segment, and ``els``, each segment's elements.

    A file is split where its row is; what follows are as many rows as it has sections, not segments.
    """
    rows = _judged(files)
    # refused files have none; outer: a plain explode would first filter files by the size of what they are split into, and so split them twice
    rows = rows.withColumn("starts", F.when(F.col("reason").isNull(), F.array_compact(F.transform("segs", lambda s, i: F.when((i == 0) | _id_of(s).isin(*SECTIONS), i + 1)))))
    parts = F.transform("starts", lambda p, k: F.struct(p.alias("seg_no"), F.slice("segs", p, F.coalesce(F.get("starts", k + 1), F.size("segs") + 1) - p).alias("raw")))
    each = rows.select("file_id", "element_by", "sub_by", F.posexplode_outer(parts).alias("at", "x")).where("x is not null")
    each = each.select("file_id", "sub_by", "x.seg_no", F.transform("x.raw", lambda s: F.split(s, F.col("element_by"))).alias("els"))
    return each.withColumn("seg_id", F.get(F.get("els", F.lit(0)), F.lit(0)))


def _parties(sections: DataFrame) -> DataFrame:
    """The claims' sections (``own``: their segments) with the parties of their set and of the open loops: the first of a kind in a loop, told before the claim.

    All stand in windows over the file's sections: the greatest loop that names the kind, the first section in it; it holds
    where that loop is still the open one. Parties are columns, so that those which nobody reads aren't told.
    """
    # most of a claim's segments are its lines', which name nobody
    rows = sections.withColumn("named", F.filter("els", lambda e: F.get(e, F.lit(0)).isin(*NAMING)))
    nm, runs = _split_at("named", lambda e: _is(e, "NM1"), "nm_at")
    rows = rows.withColumn("nm_at", nm).withColumn("runs", runs())
    alone = lambda s, q, *at: _told(_first(F.col("named"), lambda e: _is(e, s, q)), *at)
    # of a party: between its own NM1 and the next
    of = lambda s, party, q, *at: _told(_first(F.flatten(F.filter("runs", lambda r: F.coalesce(_at(F.get(r, F.lit(0)), 1), F.lit("")) == party)), lambda e: _is(e, s, q)), *at)
    last = lambda s: F.try_element_at(F.filter("named", lambda e: _is(e, s)), F.lit(-1))
    said = {
        "submitter": alone("NM1", "41", 3, 9), "contact": alone("PER", "IC", 2, 4), "receiver": alone("NM1", "40", 3, 9),
        "clinic": alone("NM1", "85", 3, 9), "prv": alone("PRV", "BI", 3), "tax": of("REF", "85", "EI", 2), "clinic_n3": of("N3", "85", None, 1), "clinic_n4": of("N4", "85", None, 1, 2, 3),
        "sbr": alone("SBR", None, 1, 2, 3), "il": alone("NM1", "IL", 3, 4, 5, 9), "il_n3": of("N3", "IL", None, 1), "il_n4": of("N4", "IL", None, 1, 2, 3), "il_dmg": of("DMG", "IL", None, 2, 3), "pr": alone("NM1", "PR", 3, 9),
        "qc": alone("NM1", "QC", 3, 4, 5), "qc_dmg": of("DMG", "QC", None, 2, 3),
    }
    level = F.when(F.col("seg_id") == "HL", F.coalesce(_at(F.get("els", F.lit(0)), 3), F.lit("")))
    claim = F.col("seg_id") == "CLM"
    rows = rows.select(
        "file_id", "sub_by", "seg_no", "seg_id", F.when(claim, F.col("seg_no")).alias("claim_no"), F.when(claim, F.col("els")).alias("own"), level.alias("level"), last("ISA").alias("isa"), last("GS").alias("gs"), *(c.alias(k) for k, c in said.items()),
    ).sortWithinPartitions("file_id", "seg_no")
    w, before = _running("file_id"), Window.partitionBy("file_id").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "ts_no": F.sum(F.when(F.col("seg_id") == "ST", 1).otherwise(0)).over(w),
        "hl20": F.last(F.when(F.col("level") == "20", F.col("seg_no")), True).over(w),
        "last22": F.last(F.when(F.col("level") == "22", F.col("seg_no")), True).over(w),
        "last23": F.last(F.when(~F.col("level").isin("20", "22"), F.col("seg_no")), True).over(w),
    })
    rows = rows.withColumn("hl22", F.when(F.col("last22") > F.coalesce("hl20", F.lit(0)), F.col("last22")))
    rows = rows.withColumn("hl23", F.when(F.col("last23") > F.greatest(F.coalesce("hl20", F.lit(0)), F.coalesce("hl22", F.lit(0))), F.col("last23")))
    ts = F.struct("ts_no")
    bill, sub, dep = (F.struct("ts_no", F.coalesce(*cs, F.lit(0)).alias("loop")) for cs in (("hl20",), ("hl22", "hl20"), ("hl23", "hl22", "hl20")))
    own = F.col("hl22").isNotNull() & F.col("hl23").isNull()
    loops = dict.fromkeys(("submitter", "contact", "receiver"), ts) | dict.fromkeys(("clinic", "prv", "tax", "clinic_n3", "clinic_n4"), bill) | dict.fromkeys(("sbr", "il", "il_n3", "il_n4", "il_dmg", "pr"), sub) | dict.fromkeys(("qc", "qc_dmg"), dep)

    def first(name: str) -> Column:
        where = F.col(name).isNotNull() & own if name == "sbr" else F.col(name).isNotNull()
        told = F.max(F.when(where, F.struct(loops[name].alias("loop"), (-F.col("seg_no")).alias("place"), F.col(name).alias("is")))).over(before)
        return F.when(told["loop"] == loops[name], told["is"])

    rows = rows.withColumns({name: first(name) for name in said} | {k: F.last(k, True).over(before) for k in ("isa", "gs")})
    return rows.where("claim_no is not null").select("file_id", "ts_no", "claim_no", "sub_by", "own", "isa", "gs", *said)


def claims(files: DataFrame) -> DataFrame:
    """Nested claims of the files without an envelope error, in the contract's shape and normalised.

    A file is a bounded unit: it is judged and split where it is, its sections are ordered once, and each claim is told
    from its own segments alone.
    """
    keys = ["file_id", "ts_no", "claim_no"]
    rows = _parties(_sections(files))
    # a transaction set's end is the claim's as well
    end = F.array_position(F.transform("own", lambda e: F.get(e, F.lit(0))), "SE")
    rows = rows.withColumn("own", F.slice("own", 1, F.when(end > 0, (end - 1).cast("int")).otherwise(F.size("own"))))
    lx, runs = _split_at("own", lambda e: _is(e, "LX"), "lx_at")
    rows = rows.withColumn("lx_at", lx)
    # what a claim says itself stands before its first line
    rows = rows.withColumns({"head": F.slice("own", 1, F.coalesce(F.get("lx_at", F.lit(0)) - 1, F.size("own"))), "runs": runs(), "elements": F.get("own", F.lit(0))})
    told, coded, fields = _line()
    mine = lambda s, q, *at: _told(_first(F.col("head"), lambda e: _is(e, s, q)), *at)
    version = F.coalesce(F.get("gs", F.lit(8)), F.lit(""))
    styles = F.transform("runs", lambda r: F.get(_first(r, lambda e: F.get(e, F.lit(0)).isin("SV1", "SV2", "SV3")), F.lit(0)))
    whole = rows.select(
        *keys, "isa", "gs", "sub_by", "elements", *PARTIES,
        mine("REF", "G1", 2).alias("g1"), mine("DTP", "434", 2, 3).alias("d434"), mine("DTP", "435", 3).alias("d435"), mine("NM1", "82", 3, 4, 5, 9).alias("nm82"), mine("PRV", "PE", 3).alias("pe"),
        F.flatten(F.transform(F.filter("head", lambda e: _is(e, "HI")), lambda e: F.transform(F.slice(e, 2, 12), lambda c: F.split(c, F.col("sub_by"))))).alias("codes"),
        # told from lines only where the version doesn't
        transaction_type(version, styles).alias("transaction_type"), F.transform(F.transform(F.transform("runs", told), coded), fields).alias("lines"),
    )
    whole = whole.withColumn("place", F.split(_at(F.col("elements"), 5), F.col("sub_by")))
    element = lambda k: _at(F.col("elements"), k)
    place, kind = F.col("place"), F.col("transaction_type")
    begin, end = _period(F.col("d434.e2"), F.col("d434.e3"))
    where_ = F.when(kind != "837I", tx.blank_to_null(F.get(place, F.lit(0))))
    filled = F.transform(F.when(F.size("lines") > 0, F.col("lines")), lambda x: x.withField("place_of_service", F.coalesce(x["place_of_service"], where_)).withField("date_of_service", F.coalesce(x["date_of_service"], begin)))
    code = lambda keep: F.transform(F.filter("codes", keep), lambda c: F.struct(F.get(c, F.lit(1)).alias("code"), F.get(c, F.lit(0)).alias("qualifier")))
    named = lambda **fields: F.struct(*((F.col(c) if isinstance(c, str) else c).alias(k) for k, c in fields.items()))
    isa, gs = (lambda k, c=c: tx.blank_to_null(F.trim(F.get(c, F.lit(k)))) for c in ("isa", "gs"))
    address = lambda n3, n4: named(street=f"{n3}.e1", city=f"{n4}.e1", state=f"{n4}.e2", zip=f"{n4}.e3")
    # without a patient's loop the patient is the subscriber
    patient = lambda k, own="": F.when(F.col("qc").isNotNull(), F.col(f"qc{own}.e{k}")).otherwise(F.col(f"il{own}.e{k}"))
    amount = tx.number_text(tx.money_prefix(element(2)))
    return whole.select(
        *keys, element(1).alias("claim_id"), "transaction_type",
        named(place_of_service=where_, facility_type_code=F.when(kind == "837I", tx.blank_to_null(F.get(place, F.lit(0)))), frequency_code=tx.blank_to_null(F.get(place, F.lit(2))), statement_from_date=begin, statement_to_date=end, admission_date=F.substring("d435.e3", 1, 8)).alias("claim_details"),
        named(claim_amount=amount).alias("financial"), named(total_charges=amount).alias("claim_totals"), named(authorization_number="g1.e2").alias("authorization"),
        named(name="clinic.e3", npi="clinic.e9", tax_id="tax.e2", taxonomy="prv.e3").alias("provider"),
        named(name="clinic.e3", npi="clinic.e9", tax_id="tax.e2", taxonomy="prv.e3", address=address("clinic_n3", "clinic_n4")).alias("billing_provider"),
        named(npi="nm82.e9", taxonomy_code="pe.e3", last_name="nm82.e3", first_name="nm82.e4", middle_name="nm82.e5").alias("rendering_provider"),
        named(name=named(first=patient(4), middle=patient(5), last=patient(3)), date_of_birth=patient(2, "_dmg"), gender=patient(3, "_dmg")).alias("patient"),
        named(member_id="il.e9", last_name="il.e3", first_name="il.e4", middle_name="il.e5", date_of_birth="il_dmg.e2", gender="il_dmg.e3", relationship_code="sbr.e2", group_number="sbr.e3", payer_responsibility="sbr.e1", address=address("il_n3", "il_n4")).alias("subscriber"),
        named(name="pr.e3", payer_id="pr.e9").alias("payer"), named(name="submitter.e3", id="submitter.e9", contact_name="contact.e2", contact_phone="contact.e4").alias("submitter"), named(name="receiver.e3", id="receiver.e9").alias("receiver"),
        named(control_number=isa(13), sender_id=isa(6), receiver_id=isa(8), date=isa(9), time=isa(10), version=isa(12), usage_indicator=isa(15)).alias("interchange"),
        named(functional_id_code=gs(1), sender_code=gs(2), receiver_code=gs(3), version=gs(8)).alias("functional_group"),
        code(lambda c: F.get(c, F.lit(0)).isin(*DIAGNOSIS)).alias("diagnosis_codes"), code(lambda c: ~F.get(c, F.lit(0)).isin(*DIAGNOSIS)).alias("other_codes"), filled.alias("service_lines"),
    )


def rejected(files: DataFrame) -> DataFrame:
    """file_id, reason: envelope errors, and readable files without a claim."""
    n = F.coalesce(F.size(F.filter("segs", lambda s: _id_of(s) == "CLM")), F.lit(0))
    said = F.coalesce("reason", F.when(n == 0, "No claims found in the file"))
    return _judged(files).select("file_id", F.explode_outer(F.array(said)).alias("reason")).where("reason is not null")


def claim_names(claims_: DataFrame) -> DataFrame:
    """A name per claim: its file's, with the claim's id where the set has several."""
    n = F.count("*").over(Window.partitionBy("file_id", "ts_no"))
    return claims_.withColumn("name", F.when(n == 1, F.concat("file_id", F.lit(".json"))).otherwise(F.concat("file_id", F.lit("_"), "claim_id", F.lit(".json"))))
