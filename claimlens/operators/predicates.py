"""Three-valued predicates over claims, with the reasons for what is unknown.

A predicate is a pair of columns: its truth (NULL: unknown) and, where unknown, the
ordered distinct texts that say which data were missing. SQL's own three-valued AND, OR
and NOT give the truth; reasons are only built where the truth is NULL. Beside them it
keeps what it says as a tree (see ``conditions``), so that rules can be compared.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx



def _none() -> Column:
    return F.expr("cast(array() as array<string>)")


@dataclass(frozen=True)
class Field:
    """A scalar of the claim: the path shown in reasons, and its canonical text."""

    path: str
    value: Column
    #: the path in trees, where items are told apart by their quantifier
    name: str = ""
    #: the value parsed as a "number" or "day", where that is made once for all rules
    parsed: Callable[[str], Column] | None = None

    def number(self) -> Column:
        return self.parsed("number") if self.parsed else PARSERS["number"](self.value)

    def day(self) -> Column:
        return self.parsed("day") if self.parsed else PARSERS["day"](self.value)


PARSERS = {"number": tx.to_number, "day": tx.to_day, "raw": lambda x: x}


class Facts:
    """What rules read of a claim, each parsed once: fields of the claim as columns, those of items within each item.

    Fields note here what is read of them while rules are built; ``columns`` then makes it all,
    in one projection below the rules.
    """

    def __init__(self):
        self.fields: dict[str, Column] = {}
        self.items: dict[str, tuple[Column, dict[str, tuple[str, str]]]] = {}

    def field(self, path: str, value: Column, kind: str) -> Column:
        name = f"_{kind}_{path.replace('.', '_')}"
        if name not in self.fields:
            self.fields[name] = PARSERS[kind](value)
        return F.col(name)

    def collection(self, path: str, value: Column) -> Column:
        self.items.setdefault(f"_items_{path}", (value, {}))
        return F.col(f"_items_{path}")

    def part(self, path: str, item: Column, name: str, kind: str) -> Column:
        part = f"{kind}_{name.replace('.', '_')}"
        self.items[f"_items_{path}"][1].setdefault(part, (name, kind))
        return item[part]

    def columns(self) -> dict[str, Column]:
        def made(parts: dict[str, tuple[str, str]]) -> Callable[[Column], Column]:
            return lambda x: F.struct(*(PARSERS[kind](_inside(x, name)).alias(part) for part, (name, kind) in parts.items()))

        # items of which nothing is read are only counted
        return self.fields | {name: F.transform(value, made(parts) if parts else (lambda x: F.lit(True))) for name, (value, parts) in self.items.items()}


def _inside(value: Column, path: str) -> Column:
    for part in path.split("."):
        value = value[part]
    return value


@dataclass(frozen=True)
class Pred:
    truth: Column
    #: the reasons, or what makes them when they are asked for
    why: Column | Callable[[], Column]
    tree: tuple = ("true",)

    @property
    def reasons(self) -> Column:
        return self.why() if callable(self.why) else self.why

    def __and__(self, other: Pred) -> Pred:
        return _joined("and", self.truth & other.truth, self, other)

    def __or__(self, other: Pred) -> Pred:
        return _joined("or", self.truth | other.truth, self, other)

    def __invert__(self) -> Pred:
        return Pred(~self.truth, self.why, ("not", self.tree))


def _joined(kind: str, truth: Column, *parts: Pred) -> Pred:
    def why() -> Column:
        return F.when(truth.isNull(), F.array_distinct(F.concat(*(p.reasons for p in parts)))).otherwise(_none())

    return Pred(truth, why, (kind, *(p.tree for p in parts)))


def _named(a: Field) -> str:
    return a.name or a.path


def _said(kind: str, a: Field, op: str | None = None, b: object = None, high: float | None = None) -> tuple:
    """A leaf's tree: kind, op, field, low, high, text."""
    if isinstance(b, Field):
        return (kind, op, _named(a), None, None, f"${_named(b)}") if kind != "cmp" else ("fields", op, _named(a), None, None, _named(b))
    if isinstance(b, int | float) and not isinstance(b, bool):
        return kind, op, _named(a), float(b), None if high is None else float(high), None
    return kind, op, _named(a), None, None, None if b is None else str(b)


def _leaf(said: tuple, truth: Column, *problems: tuple[Column, str, str]) -> Pred:
    """problems: (the parsed value, the path, what is wrong where it is NULL though present)."""
    def why() -> Column:
        texts = [F.when(raw.isNull(), F.lit(f"{path} missing")).when(parsed.isNull(), F.lit(f"{path} {wrong}")) for raw, parsed, path, wrong in problems]
        return F.when(truth.isNull(), F.array_distinct(F.array_compact(F.array(*texts)))).otherwise(_none())

    return Pred(truth, why, said)


def always(value: bool) -> Pred:
    return Pred(F.lit(value), _none, ("true" if value else "false",))


def equal_text(a: Field, b: str | Field) -> Pred:
    """Text equality; between two fields too."""
    if isinstance(b, Field):
        return _leaf(_said("cmp", a, "=", b), a.value == b.value, (a.value, a.value, a.path, ""), (b.value, b.value, b.path, ""))
    return _leaf(_said("cmp", a, "=", b), a.value == F.lit(b), (a.value, a.value, a.path, ""))


def _symbol(op: Callable) -> str:
    """How an operator is written, told from what it says of plain numbers."""
    return {(True, False, False): "<", (True, True, False): "<=", (False, True, False): "=", (False, False, True): ">", (False, True, True): ">=", (True, False, True): "!="}[op(0, 1), op(1, 1), op(1, 0)]


def compare(a: Field, op: Callable[[Column, Column], Column], b: float | Field) -> Pred:
    """Numeric comparison; what is not a number is unknown."""
    wrong = "is not a number"
    said = _said("cmp", a, _symbol(op), b)
    if isinstance(b, Field):
        return _leaf(said, op(a.number(), b.number()), (a.value, a.number(), a.path, wrong), (b.value, b.number(), b.path, wrong))
    return _leaf(said, op(a.number(), F.lit(float(b))), (a.value, a.number(), a.path, wrong))


def greater(a: Field, b: float | Field) -> Pred:
    return compare(a, lambda x, y: x > y, b)


def less(a: Field, b: float | Field) -> Pred:
    return compare(a, lambda x, y: x < y, b)


def at_most(a: Field, b: float | Field) -> Pred:
    return compare(a, lambda x, y: x <= y, b)


def at_least(a: Field, b: float | Field) -> Pred:
    return compare(a, lambda x, y: x >= y, b)


def equal_number(a: Field, b: float) -> Pred:
    return compare(a, lambda x, y: x == y, b)


def between(a: Field, low: float, high: float) -> Pred:
    return _leaf(_said("between", a, None, low, high), a.number().between(F.lit(float(low)), F.lit(float(high))), (a.value, a.number(), a.path, "is not a number"))


def is_null(a: Field) -> Pred:
    return Pred(a.value.isNull(), _none, _said("null", a))


def contains(a: Field, part: str) -> Pred:
    return _leaf(_said("contains", a, None, part), a.value.contains(part), (a.value, a.value, a.path, ""))


def starts_with(a: Field, prefix: str) -> Pred:
    return _leaf(_said("starts_with", a, None, prefix), a.value.startswith(prefix), (a.value, a.value, a.path, ""))


def in_list(a: Field, values: list[str]) -> Pred:
    return _leaf(_said("in_list", a, None, "\u0003".join(values)), a.value.isin(values), (a.value, a.value, a.path, ""))


#: The members of bracket classes, ASCII alone.
CLASSES = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": r"\x21-\x7E", "lower": "a-z",
    "print": r"\x20-\x7E", "punct": r"\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}


def _char(c: str) -> str:
    """A literal character in Java's dialect."""
    return c if c.isalnum() and c.isascii() else "".join(f"\\x{{{ord(x):X}}}" for x in c)


def _bracket(posix: str, at: int) -> tuple[str, int]:
    """The class that a bracket expression stands for, and where it ends. at: after its ``[``."""
    out, first = "[", True
    if posix[at : at + 1] == "^":
        out, at = "[^", at + 1
    while True:
        if at >= len(posix):
            raise ValueError(f"a bracket isn't closed: {posix}")
        if posix[at] == "]" and not first:
            return out + "]", at + 1
        first = False
        if posix[at : at + 2] in ("[.", "[="):
            raise ValueError(f"collating elements aren't known: {posix}")
        if posix[at : at + 2] == "[:":
            end = posix.find(":]", at)
            name = posix[at + 2 : end]
            if end < 0 or name not in CLASSES:
                raise ValueError(f"not a class: {posix[at:]}")
            out, at = out + CLASSES[name], end + 2
        elif posix[at + 1 : at + 2] == "-" and posix[at + 2 : at + 3] not in ("", "]"):
            if posix[at] > posix[at + 2]:
                raise ValueError(f"a range runs backwards: {posix}")
            out, at = out + f"{_char(posix[at])}-{_char(posix[at + 2])}", at + 3
        else:
            out, at = out + _char(posix[at]), at + 1


def java_pattern(posix: str) -> str:
    """An extended POSIX search pattern in Java's dialect; what it doesn't know is a ValueError.

    Anchors mean the whole value wherever they stand, a dot any character, bracket classes ASCII;
    a backslash takes the meaning from a special character.
    """
    out: list[str] = []  # of the groups open, what is written so far; the last is the one at hand
    stack: list[list[str]] = []
    last, repeated, at = False, False, 0  # whether something can be repeated, and is already
    while at < len(posix):
        c = posix[at]
        at += 1
        if c == "[":
            text, at = _bracket(posix, at)
            out.append(text)
            last, repeated = True, False
        elif c == "(":
            if posix[at : at + 1] == "?":
                raise ValueError(f"not an extended POSIX pattern: {posix}")
            stack.append(out)
            out, last, repeated = [], False, False
        elif c == ")" and stack:
            inner, out = "".join(out), stack.pop()
            out.append(f"(?:{inner})")
            last, repeated = True, False
        elif c == "|":
            out.append("|")
            last = repeated = False
        elif c in "^$":
            out.append(r"\A" if c == "^" else r"\z")
            last, repeated = True, False
        elif c in "*+?" or (c == "{" and last):
            if c == "{":
                end = posix.find("}", at)
                bounds = posix[at:end].split(",") if end > 0 else []
                if not bounds or len(bounds) > 2 or not bounds[0].isdigit() or not (bounds[-1].isdigit() or (len(bounds) == 2 and not bounds[1])):
                    raise ValueError(f"not a repetition: {posix}")
                c, at = posix[at - 1 : end + 1], end + 1
            if not last:
                raise ValueError(f"nothing to repeat: {posix}")
            # two repetitions in a row are no other kind of repetition here
            out[-1] = f"(?:{out[-1]}){c}" if repeated else out[-1] + c
            repeated = True
        elif c == "\\":
            if at == len(posix) or posix[at].isalnum():
                raise ValueError(f"a backslash without meaning: {posix}")
            out.append(_char(posix[at]))
            last, repeated, at = True, False, at + 1
        else:
            out.append(r"[\s\S]" if c == "." else _char(c))
            last, repeated = True, False
    if stack:
        raise ValueError(f"a parenthesis isn't closed: {posix}")
    return "".join(out)


def matches(a: Field, posix: str) -> Pred:
    return _leaf(_said("matches", a, None, posix), a.value.rlike(java_pattern(posix)), (a.value, a.value, a.path, ""))


def date_before(a: Field, b: str | Field) -> Pred:
    wrong = "is not a valid date"
    if isinstance(b, Field):
        return _leaf(_said("date_before", a, None, b), a.day() < b.day(), (a.value, a.day(), a.path, wrong), (b.value, b.day(), b.path, wrong))
    return _leaf(_said("date_before", a, None, b), a.day() < F.lit(b).cast("date"), (a.value, a.day(), a.path, wrong))


def future_date(a: Field, as_of: Column) -> Pred:
    return _leaf(_said("future_date", a), a.day() > as_of, (a.value, a.day(), a.path, "is not a valid date"))


def weekend(a: Field) -> Pred:
    return _leaf(_said("weekend", a), tx.is_weekend(a.day()), (a.value, a.day(), a.path, "is not a valid date"))


def npi_format(a: Field) -> Pred:
    return _leaf(_said("npi_format", a), tx.is_npi_format(a.value), (a.value, a.value, a.path, ""))


def npi_valid(a: Field) -> Pred:
    return _leaf(_said("npi_valid", a), tx.is_valid_npi(a.value), (a.value, a.value, a.path, ""))


def age_between(birth: Field, low: int, high: int, as_of: Column) -> Pred:
    return _leaf(_said("age_between", birth, None, low, high), tx.age_on(birth.day(), as_of).between(low, high), (birth.value, birth.day(), birth.path, "is not a valid date"))


@dataclass(frozen=True)
class Items:
    """A collection of the claim; ``item(x)(name)`` is a scalar of one element."""

    path: str
    value: Column
    facts: Facts | None = None

    def part(self, item: Column, name: str) -> Column:
        return self.facts.part(self.path, item, name, "raw") if self.facts else _inside(item, name)

    def field(self, item: Column, name: str) -> Field:
        parsed = (lambda kind: self.facts.part(self.path, item, name, kind)) if self.facts else None
        return Field(f"{self.path}[].{name}", self.part(item, name), f"{self.path}#{item.__dict__.get('_quantifier', 0)}.{name}", parsed)

    def at(self, index: int, name: str) -> Field:
        return Field(f"{self.path}.{index}.{name}", self.part(F.get(self.value, F.lit(index)), name))


def _over(kind: str, items: Items, truth: Column, body: Callable[[Column], Pred]) -> Pred:
    filled = F.coalesce(F.size(items.value), F.lit(0)) > 0
    truth = F.when(filled, truth)

    def why() -> Column:
        inner = F.array_distinct(F.flatten(F.transform(items.value, lambda x: body(x).reasons)))
        empty = F.array(F.lit(f"{items.path} missing or empty"))
        return F.when(truth.isNull(), F.when(filled, inner).otherwise(empty)).otherwise(_none())

    return Pred(truth, why, (kind, items.path, _tree_of(body)))


#: How many quantifiers stand around what is being written down as a tree.
_DEPTH = [0]


def _tree_of(body: Callable[[Column], Pred]) -> tuple:
    """What a body says of an item, with the item known by its quantifier's number."""
    item = F.col("_item")
    item.__dict__["_quantifier"] = _DEPTH[0]
    _DEPTH[0] += 1
    try:
        return body(item).tree
    finally:
        _DEPTH[0] -= 1


def exists(items: Items, body: Callable[[Column], Pred]) -> Pred:
    """Any item; unknown over an empty or missing collection. The body may read items of quantifiers around it."""
    return _over("exists", items, F.exists(items.value, lambda x: body(x).truth), body)


def for_all(items: Items, body: Callable[[Column], Pred]) -> Pred:
    return _over("forall", items, F.forall(items.value, lambda x: body(x).truth), body)


def count(items: Items, op: Callable[[Column, Column], Column], n: int) -> Pred:
    """Always definite; a missing collection counts 0."""
    return Pred(op(F.coalesce(F.size(items.value), F.lit(0)), F.lit(n)), _none, ("count", _symbol(op), items.path, float(n)))


def has_code(items: Items, name: str, code: str, absent: str) -> Pred:
    """Whether any item has the code; unknown only where there are no items."""
    return has_any(code, absent, codes_of(items, name))


def codes_of(items: Items, name: str) -> Column:
    """The codes of a collection's items; NULL where there are no items."""
    return F.when(F.size(items.value) > 0, F.array_compact(F.transform(items.value, lambda x: items.part(x, name))))


def has_any(code: str, absent: str, *places: Column) -> Pred:
    """Whether a code stands in any of several places, each an array of codes or NULL where the claim hasn't that place.

    Found anywhere: true; some place there, but not found: false; no place there: unknown.
    """
    there = F.coalesce(*places).isNotNull()
    found = F.array_contains(F.flatten(F.array(*(F.coalesce(x, F.array().cast("array<string>")) for x in places))), code)
    truth = F.when(there, found)
    return Pred(truth, lambda: F.when(truth.isNull(), F.array(F.lit(absent))).otherwise(_none()), ("has_code", None, absent, None, None, code))
