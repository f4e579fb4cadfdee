"""Scalar functions over claim text: numbers, dates, provider numbers. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"\A\s*-?\d+(\.\d+)?([eE][+-]?\d+)?\z"
#: Fixed value: the issuer prefix that goes before a provider number in its check sum.
NPI_PREFIX = "80840"


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def without_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^\\uFEFF", "")


def to_number(text: Column) -> Column:
    """A whole finite number, or NULL. Blanks may lead, not trail."""
    number = F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def number_text(number: Column) -> Column:
    """Canonical text of a double: whole numbers without a point, others without trailing zeros."""
    whole = (number == F.floor(number)) & (F.abs(number) < F.lit(9.2e18))
    decimal = F.rtrim(F.rtrim(number.try_cast("decimal(38,10)").cast("string"), F.lit("0")), F.lit("."))
    return F.when(whole, number.try_cast("bigint").cast("string")).otherwise(F.coalesce(decimal, number.cast("string")))


def to_day(text: Column) -> Column:
    """A calendar day in one of three spellings, blanks around it allowed."""
    t = F.trim(text)
    return F.coalesce(F.try_to_date(t, "yyyy-MM-dd"), F.try_to_date(t, "yyyyMMdd"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("date"))


def to_service_day(text: Column) -> Column:
    """The provider check's spelling: no blanks, no time of day."""
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "yyyyMMdd"))


def to_registry_day(text: Column) -> Column:
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "MM/dd/yyyy"))


def money_prefix(text: Column) -> Column:
    """The number that a text begins with."""
    return F.nullif(F.regexp_extract(text, r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?", 0), F.lit("")).try_cast("double")


def is_npi_format(text: Column) -> Column:
    return text.rlike(r"\A[0-9]{10}\z")


def is_valid_npi(text: Column) -> Column:
    return is_npi_format(text) & F.call_function("luhn_check", F.concat(F.lit(NPI_PREFIX), text))


def age_on(birth: Column, day: Column) -> Column:
    """Whole years, by month and day."""
    before = F.when(F.date_format(day, "MMdd") < F.date_format(birth, "MMdd"), 1).otherwise(0)
    return F.year(day) - F.year(birth) - before


def is_weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def provider_name(entity_type: Column, organisation: Column, last: Column, first: Column) -> Column:
    """An organisation's name, or "last, first"; blank names have a default."""
    person = F.btrim(F.concat(F.coalesce(last, F.lit("")), F.lit(", "), F.coalesce(first, F.lit(""))), F.lit(", "))
    name = F.when(entity_type == 2, F.coalesce(blank_to_null(organisation), F.lit(""))).otherwise(person)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("Unknown Provider"))


def entity_type(code: Column) -> Column:
    return F.when(code == "2", 2).otherwise(1)


def threshold_label(threshold: Column) -> Column:
    return F.when(threshold == 0.35, "0_35").when(threshold == 0.80, "0_80").when(threshold == 0.93, "0_93").otherwise("custom")


def fingerprint(*parts: Column) -> Column:
    """A digest equal for equal documents: fields in a fixed order, missing ones kept apart from empty ones."""
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)
