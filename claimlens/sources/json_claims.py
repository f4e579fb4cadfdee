"""JSON claims as tables: files to entries, entries to the typed claim contract, and what is refused.

A document stays a VARIANT until it is projected. The projection is led by SHAPE, the
contract's own fields with the place of each in a converted document; so one table says what
the contract is, where a field comes from, and which paths rules may name. A document that is
in the contract already keeps its values, so projecting twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

#: The claim contract, and where a converted document holds each field. None: nowhere.
#: A name in capitals stands for an object that SOURCES finds; ``*`` marks lists.
SHAPE = {
    "claim_id": "claim.claim_id",
    "transaction_type": "transaction_type",
    "claim_details": {
        "place_of_service": "claim.place_of_service", "facility_type_code": "claim.facility_type_code", "frequency_code": "claim.frequency_code",
        "statement_from_date": "claim.dates.statement_from", "statement_to_date": "claim.dates.statement_to", "admission_date": "claim.dates.admission_date",
    },
    "financial": {"claim_amount": "claim.total_charge_amount"},
    "claim_totals": {"total_charges": "claim.total_charge_amount"},
    "authorization": {"authorization_number": "claim.prior_authorization"},
    "provider": {"name": "billing_provider.name", "npi": "billing_provider.npi", "tax_id": "billing_provider.tax_id", "taxonomy": "billing_provider.taxonomy_code", "tenure_days": None},
    "billing_provider": {
        "name": "billing_provider.name", "npi": "billing_provider.npi", "tax_id": "billing_provider.tax_id", "taxonomy": "billing_provider.taxonomy_code",
        "address": {"street": "billing_provider.address.street", "city": "billing_provider.address.city", "state": "billing_provider.address.state", "zip": "billing_provider.address.zip"},
    },
    "rendering_provider": {
        "npi": "claim.rendering_provider.npi", "taxonomy_code": "claim.rendering_provider.taxonomy_code", "last_name": "claim.rendering_provider.last_name",
        "first_name": "claim.rendering_provider.first_name", "middle_name": "claim.rendering_provider.middle_name",
    },
    "patient": {"name": {"first": "PATIENT.first_name", "middle": "PATIENT.middle_name", "last": "PATIENT.last_name"}, "date_of_birth": "PATIENT.date_of_birth", "gender": "PATIENT.gender"},
    "subscriber": {
        "member_id": "claim.subscriber.member_id", "last_name": "claim.subscriber.last_name", "first_name": "claim.subscriber.first_name", "middle_name": "claim.subscriber.middle_name",
        "date_of_birth": "claim.subscriber.date_of_birth", "gender": "claim.subscriber.gender", "relationship_code": "claim.subscriber.relationship_code",
        "group_number": "claim.subscriber.group_number", "payer_responsibility": "claim.subscriber.payer_responsibility",
        "address": {"street": "claim.subscriber.address.street", "city": "claim.subscriber.address.city", "state": "claim.subscriber.address.state", "zip": "claim.subscriber.address.zip"},
    },
    "payer": {"name": "claim.payer.name", "payer_id": "claim.payer.payer_id"},
    "submitter": {"name": "submitter.name", "id": "submitter.id", "contact_name": "submitter.contact_name", "contact_phone": "submitter.contact_phone"},
    "receiver": {"name": "receiver.name", "id": "receiver.id"},
    "interchange": {
        "control_number": "interchange.control_number", "sender_id": "interchange.sender_id", "receiver_id": "interchange.receiver_id", "date": "interchange.date",
        "time": "interchange.time", "version": "interchange.version", "usage_indicator": "interchange.usage_indicator",
    },
    "functional_group": {
        "functional_id_code": "functional_group.functional_id_code", "sender_code": "functional_group.sender_code", "receiver_code": "functional_group.receiver_code", "version": "functional_group.version",
    },
}
#: The lists of the contract, each with its place and its items' fields; ``first|other``: the first that is there.
LISTS = {
    "diagnosis_codes": ("claim.diagnosis_codes", {"code": "code", "qualifier": "qualifier"}),
    "other_codes": ("claim.other_codes", {"code": "code", "qualifier": "qualifier"}),
    "service_lines": ("claim.service_lines", {
        "line_number": "line_number", "date_of_service": "service_date|date_of_service", "date_of_service_end": "service_date_end|date_of_service_end", "place_of_service": "place_of_service",
        "procedure_code": "procedure_code", "procedure_qualifier": "procedure_qualifier", "charge_amount": "charge_amount", "units": "units", "unit_type": "unit_type",
        "diagnosis_pointer": "diagnosis_pointer", "revenue_code": "revenue_code",
        "tooth_info": {"tooth_code_qualifier": "tooth_info.tooth_code_qualifier", "tooth_number": "tooth_info.tooth_number", "tooth_surface": "tooth_info.tooth_surface"},
    }),
}
#: Fields that are worked out from a claim; rules may name them, documents don't hold them.
DERIVED = ("claim_totals.service_line_total",)
MONEY = "claim.total_charge_amount"


def leaves(shape: dict, above: str = "") -> list[str]:
    out = []
    for name, held in shape.items():
        out += leaves(held, f"{above}{name}.") if isinstance(held, dict) else [above + name]
    return out


def _leaf_places(shape: dict) -> list[str]:
    return [p for held in shape.values() for p in (_leaf_places(held) if isinstance(held, dict) else [held])]


def contract_paths() -> list[str]:
    """Every leaf of the contract, ``*`` for the index of a list."""
    return [*leaves(SHAPE), *(f"{name}.*.{x}" for name, (_, fields) in LISTS.items() for x in leaves(fields)), *DERIVED]


def part(doc: Column, path: str, kind: str = "string") -> Column:
    """What a document holds at a path; NULL where it isn't there, is null or isn't of that kind."""
    return F.try_variant_get(doc, f"$.{path}", kind)


def there(doc: Column, path: str) -> Column:
    """Whether the path is there, also with a null."""
    return part(doc, path, "variant").isNotNull()


def is_object(doc: Column) -> Column:
    """Told by a look at its fields; a VARIANT's schema would be worked out of the whole document, as text."""
    return F.try_variant_get(doc, "$", "map<string,variant>").isNotNull()


def items_of(doc: Column) -> Column:
    """The items of a list; NULL for anything else."""
    return F.try_variant_get(doc, "$", "array<variant>")


def once(rows: DataFrame, *kept: str, **columns: Column) -> DataFrame:
    """Rows with columns that are computed once, however often what follows names them: a generator isn't merged into it."""
    return rows.select(*kept, F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def entries(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries that are claims (file_id, pos from 1, doc) and refusals (file_id, pos, reason) of files(file_id, text).

    A file is one claim, a list, or an object with a list under ``claims``. A refusal without a
    pos refuses the whole file; its entries aren't told apart then.
    """
    rows = once(files, "file_id", doc=F.try_parse_json("text"))
    rows = once(rows, "file_id", "doc", is_object=is_object(F.col("doc")), inner=part(F.col("doc"), "claims", "variant"))
    wrapped = F.col("is_object") & F.col("inner").isNotNull()
    rows = once(rows, "file_id", "doc", "is_object", wrapped=wrapped, held=items_of(F.when(wrapped, F.col("inner")).otherwise(F.col("doc"))))
    listed = F.col("held").isNotNull()
    whole = (
        F.when(F.col("doc").isNull(), "not valid JSON")
        .when(F.col("is_object") & there(F.col("doc"), "rulesText"), "an engine test request (rules and a list of claims), not a claims file")
        .when(F.col("wrapped") & ~listed, '"claims" must be a list of claims')
    )
    rows = once(rows, "file_id", whole=whole, listed=listed, items=F.coalesce("held", F.array("doc")))
    # an item that is null comes as no VARIANT at all
    why = lambda x: F.when(~is_object(x), "not a claim").when(~there(x, "claim_id") & ~is_object(part(x, "claim", "variant")), "no claim found (expected a claim_id or claim field)")
    rows = once(rows, "file_id", "whole", "listed", "items", whys=F.when(F.col("whole").isNull(), F.transform("items", why)))
    whole = (
        F.when(F.col("before").isNotNull(), F.col("before"))
        .when(F.col("listed") & (F.size("items") == 0), "the list of claims is empty")
        .when(~F.col("listed"), F.col("whys")[0])
        .when(F.forall("whys", lambda w: w.isNotNull()), F.concat(F.lit("none of the "), F.size("items").cast("string"), F.lit(" entries is a claim")))
    )
    rows = once(rows.withColumnRenamed("whole", "before"), "file_id", "items", "whys", whole=whole)
    # outer: a file that isn't refused has items; a plain posexplode would first filter by their number
    each = rows.where("whole is null").select("file_id", F.posexplode_outer(F.arrays_zip("items", "whys")).alias("pos", "x")).select("file_id", (F.col("pos") + 1).alias("pos"), F.col("x.items").alias("doc"), F.col("x.whys").alias("reason"))
    refused = rows.where("whole is not null").select("file_id", F.lit(None).cast("int").alias("pos"), F.col("whole").alias("reason"))
    return each.where("reason is null").drop("reason"), refused.unionByName(each.where("reason is not null").drop("doc"))


def _projected(shape: dict, leaf) -> Column:
    return F.struct(*((_projected(held, leaf_below(leaf, name)) if isinstance(held, dict) else leaf(name, held)).alias(name) for name, held in shape.items()))


def leaf_below(leaf, above: str):
    return lambda name, place: leaf(f"{above}.{name}", place)


def _item_type(paths: list[str]) -> str:
    """The type of a list's items that hold texts at these paths."""
    tree: dict = {}
    for path in paths:
        *above, name = path.split(".")
        at = tree
        for x in above:
            at = at.setdefault(x, {})
        at[name] = "string"
    told = lambda x: x if isinstance(x, str) else f"struct<{','.join(f'{k}:{told(v)}' for k, v in x.items())}>"
    return told(tree)


def _at(x: Column, path: str) -> Column:
    for name in path.split("."):
        x = x[name]
    return x


def normalised(claims: DataFrame) -> DataFrame:
    """Claims(file_id, pos, doc) with every field of the contract as a typed column beside ``doc``.

    Converted documents are flattened: blank texts become NULL, amounts are read from what
    their text begins with, a patient who is missing is the subscriber, and a line without a
    place of service has the claim's. Documents in the contract keep their values.
    """
    doc, own, patient = F.col("doc"), F.col("_own"), F.col("_patient")
    held_patient = part(doc, "claim.patient", "variant")
    person = F.when(held_patient.isNull() | F.is_variant_null(held_patient), part(doc, "claim.subscriber", "variant")).otherwise(held_patient)

    def leaf(name: str, place: str | None) -> Column:
        if place is None:
            return F.when(own, part(doc, name))
        if place == MONEY:
            held = tx.number_text(tx.money_prefix(part(doc, place)))
        elif place.startswith("PATIENT."):
            held = part(patient, place.removeprefix("PATIENT."))
        else:
            held = part(doc, place)
        return F.when(own, part(doc, name)).otherwise(F.when(F.trim(held) != "", held))

    filled = lambda held: F.when(F.trim(held) != "", held)

    def listed(name: str, place: str, fields: dict) -> Column:
        # a list is read once, as items of the fields that are asked for, not once for each field of each item
        places = [p for at in _leaf_places(fields) for p in at.split("|")]

        def own_item(x: Column) -> Column:
            return _projected(fields, lambda field, at: _at(x, field))

        def converted_item(x: Column) -> Column:
            def inner(field: str, at: str) -> Column:
                held = filled(F.coalesce(*(_at(x, p) for p in at.split("|"))))
                return F.coalesce(held, F.col("_place")) if (name, field) == ("service_lines", "place_of_service") else held

            return _projected(fields, inner)

        mine, other = (f"array<{_item_type(paths)}>" for paths in (leaves(fields), places))
        return F.when(own, F.transform(part(doc, name, mine), own_item)).otherwise(F.coalesce(F.transform(part(doc, place, other), converted_item), F.array()))

    columns = [(_projected(held, leaf_below(leaf, name)) if isinstance(held, dict) else leaf(name, held)).alias(name) for name, held in SHAPE.items()]
    claims = once(claims, "file_id", "pos", "doc", _own=there(doc, "claim_id"), _patient=person, _place=filled(part(doc, "claim.place_of_service")))
    return claims.select("file_id", "pos", *columns, *(listed(name, *held).alias(name) for name, held in LISTS.items()), "doc")


def json_claims(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Normalised claims and refusals of the JSON files below a path; file_id is a file's path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_id"), F.col("value").alias("text"))
    good, bad = entries(files)
    return normalised(good), bad
