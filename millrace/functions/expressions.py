"""Predicates: a small tree with one place for the null rules, built in Python or read from JSON, compiled to Columns.

    p = field("price")
    (p > 20) & ~field("name").lower().startswith("a") | field("category").is_in(["x", "y"])

Null rules: equality is null-safe, so ``!=`` and a negated ``is_in`` keep rows with null; ranges and string tests, negated or
not, drop them. Negation is pushed to the leaves. Compiled predicates use built-in functions only, so they reach the scan;
an ``opaque`` Python function is the exception.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, StructType

ORDERED = {"gt": "le", "ge": "lt", "lt": "ge", "le": "gt"}
SWAPPED = {"gt": "lt", "ge": "le", "lt": "gt", "le": "ge", "eq": "eq", "ne": "ne"}
TEXT = ("starts_with", "ends_with", "contains")


class Expr:
    """A predicate."""

    def __and__(self, other: Expr) -> Expr:
        return all_of([self, other])

    def __or__(self, other: Expr) -> Expr:
        if TRUE in (self, other):
            return TRUE
        return Logic("or", (self, other))

    def __invert__(self) -> Expr:
        return negate(self)

    def __bool__(self) -> bool:
        raise TypeError("combine predicates with &, | and ~")


@dataclass(frozen=True)
class Always(Expr):
    pass


TRUE = Always()


@dataclass(frozen=True)
class Logic(Expr):
    kind: str  # and, or
    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class Param:
    """A value that is given when the predicate is used."""

    name: str


@dataclass(frozen=True)
class Field:
    """A property path, perhaps under lower, upper or length. Its operators build predicates."""

    path: tuple[str, ...]
    apply: str | None = None

    def __getattr__(self, name: str) -> Field:
        if name.startswith("__"):
            raise AttributeError(name)
        return replace(self, path=(*self.path, name))

    def __getitem__(self, name: str) -> Field:
        return replace(self, path=(*self.path, name))

    def lower(self) -> Field:
        return replace(self, apply="lower")

    def upper(self) -> Field:
        return replace(self, apply="upper")

    def length(self) -> Field:
        return replace(self, apply="length")

    def __eq__(self, other: object) -> Expr:  # type: ignore[override]
        return Compare("eq", self, other)

    def __ne__(self, other: object) -> Expr:  # type: ignore[override]
        return Compare("ne", self, other)

    def __gt__(self, other: object) -> Expr:
        return Compare("gt", self, other)

    def __ge__(self, other: object) -> Expr:
        return Compare("ge", self, other)

    def __lt__(self, other: object) -> Expr:
        return Compare("lt", self, other)

    def __le__(self, other: object) -> Expr:
        return Compare("le", self, other)

    def startswith(self, text: object) -> Expr:
        return Compare("starts_with", self, text)

    def endswith(self, text: object) -> Expr:
        return Compare("ends_with", self, text)

    def contains(self, part: object) -> Expr:
        """A substring of a string, or an element of an array."""
        return Compare("contains", self, part)

    def is_in(self, values: object) -> Expr:
        return Compare("in", self, values)

    def is_null(self) -> Expr:
        return Compare("eq", self, None)

    def is_true(self) -> Expr:
        """The property as a condition: true, or a length over 0."""
        return Compare("gt", self, 0) if self.apply == "length" else Compare("eq", self, True)

    __hash__ = object.__hash__

    def same(self, other: object) -> bool:
        return isinstance(other, Field) and (self.path, self.apply) == (other.path, other.apply)


@dataclass(frozen=True, eq=False)
class Compare(Expr):
    op: str  # eq ne gt ge lt le starts_with ends_with contains in
    left: Field
    right: Any
    negated: bool = False


@dataclass(frozen=True, eq=False)
class Opaque(Expr):
    """A Python function of some fields' values; evaluated row by row, never pushed down."""

    function: Callable[..., bool]
    fields: tuple[str, ...]
    negated: bool = False


def field(path: str) -> Field:
    return Field(tuple(path.split(".")))


def param(name: str) -> Param:
    return Param(name)


def opaque(function: Callable[..., bool], *fields: str) -> Expr:
    return Opaque(function, fields)


def all_of(parts: Sequence[Expr]) -> Expr:
    """Conjunction; tautologies vanish, none at all is one."""
    rest = [p for p in parts if p is not TRUE]
    return reduce(lambda a, b: Logic("and", (a, b)), rest) if rest else TRUE


def negate(e: Expr) -> Expr:
    if isinstance(e, Logic):
        return Logic("or" if e.kind == "and" else "and", tuple(negate(p) for p in e.parts))
    if isinstance(e, Compare):
        if e.op in ("eq", "ne") and not e.negated:
            return replace(e, op="ne" if e.op == "eq" else "eq")
        if e.op in ORDERED:
            return replace(e, op=ORDERED[e.op])
        return replace(e, negated=not e.negated)
    if isinstance(e, Opaque):
        return replace(e, negated=not e.negated)
    raise ValueError("a tautology can't be negated")


def has_opaque(e: Expr) -> bool:
    return isinstance(e, Opaque) or isinstance(e, Logic) and any(map(has_opaque, e.parts))


def fields_of(e: Expr) -> set[str]:
    if isinstance(e, Logic):
        return set().union(*map(fields_of, e.parts))
    if isinstance(e, Compare):
        return {".".join(x.path) for x in (e.left, e.right) if isinstance(x, Field)}
    return set(e.fields) if isinstance(e, Opaque) else set()


class Compiler:
    """Predicates to Columns against a struct of columns, which may be nested under a prefix (a joined side)."""

    def __init__(self, schema: StructType, params: Mapping[str, Any] | None = None, prefix: str = "", transforms: Mapping[str, Any] | None = None) -> None:
        self.schema, self.params, self.prefix, self.transforms = schema, params or {}, prefix, transforms or {}

    def type_of(self, path: Sequence[str]) -> DataType:
        kind: DataType = self.schema
        for name in path:
            if not isinstance(kind, StructType) or name not in kind.fieldNames():
                raise KeyError(f"no property {'.'.join(path)}")
            kind = kind[name].dataType
        return kind

    def column(self, f: Field) -> Column:
        kind = self.type_of(f.path)
        c = F.col(".".join(f"`{x}`" for x in ([self.prefix] if self.prefix else []) + list(f.path)))
        if f.apply == "length":
            return F.size(c) if isinstance(kind, ArrayType) else F.length(c)
        return {"lower": F.lower, "upper": F.upper}[f.apply](c) if f.apply else c

    def value(self, v: Any, like: Field, element: bool = False) -> Column:
        if isinstance(v, Field):
            return self.column(v)
        if isinstance(v, Param):
            v = self.params[v.name]
        kind = self.type_of(like.path)
        if element and isinstance(kind, ArrayType):
            kind = kind.elementType
        to = self.transforms.get(".".join(like.path))
        if to is not None and v is not None:
            return to(F.lit(v))
        if like.apply or v is None:
            return F.lit(v)
        if isinstance(v, str) and kind.typeName() in ("timestamp", "timestamp_ntz", "date"):
            return F.lit(v).cast(kind)
        if isinstance(v, bool) != isinstance(kind, BooleanType):
            return F.lit(v)
        if isinstance(v, dt.datetime) and kind.typeName() == "timestamp_ntz":
            return F.lit(v.replace(tzinfo=None).isoformat(" ")).cast(kind)
        return F.lit(v) if isinstance(v, (int, float)) else F.lit(v).cast(kind)

    def compile(self, e: Expr) -> Column:
        if e is TRUE:
            return F.lit(True)
        if isinstance(e, Logic):
            parts = [self.compile(p) for p in e.parts]
            return reduce((lambda a, b: a & b) if e.kind == "and" else (lambda a, b: a | b), parts)
        if isinstance(e, Opaque):
            call = F.udf(lambda *a, f=e.function: bool(f(*a)), "boolean", useArrow=True)(*[self.column(field(x)) for x in e.fields])
            return ~call if e.negated else call
        assert isinstance(e, Compare)
        transform = self.transforms.get(".".join(e.left.path))
        if transform is not None and getattr(transform, "comparable", None) == "equality" and e.op not in ("eq", "ne", "in"):
            raise ValueError(f"{'.'.join(e.left.path)} is stored transformed and can be tested for equality only")
        left = self.column(e.left)
        if e.op == "in":
            values = self.params[e.right.name] if isinstance(e.right, Param) else e.right
            some = [v for v in values if v is not None]
            found = F.coalesce(left.isin([self.value(v, e.left) for v in some]), F.lit(False)) if some else F.lit(False)
            if len(some) < len(list(values)):
                found = found | left.isNull()
            return ~found if e.negated else left.isin([self.value(v, e.left) for v in some]) if some and len(some) == len(list(values)) else found
        right = self.value(e.right, e.left, element=e.op == "contains")
        if e.op in ("eq", "ne"):
            given = self.params[e.right.name] if isinstance(e.right, Param) else e.right
            if given is None:
                return left.isNull() if e.op == "eq" else left.isNotNull()
            if e.op == "eq":
                return left.eqNullSafe(right) if isinstance(e.right, Field) else left == right
            return ~left.eqNullSafe(right)
        if e.op in ORDERED:
            return {"gt": left > right, "ge": left >= right, "lt": left < right, "le": left <= right}[e.op]
        if e.op == "contains" and isinstance(self.type_of(e.left.path), ArrayType):
            test = F.array_contains(left, right)
        else:
            test = {"starts_with": left.startswith, "ends_with": left.endswith, "contains": left.contains}[e.op](right)
        return ~test if e.negated else test


# JSON: literals that JSON lacks carry a tag.
def _pack(v: Any) -> Any:
    if isinstance(v, dt.datetime):
        return {"$date": v.isoformat()}
    if isinstance(v, float) and not math.isfinite(v):
        return {"$number": "NaN" if math.isnan(v) else "Infinity" if v > 0 else "-Infinity"}
    if isinstance(v, (list, tuple)):
        return {"$array": [_pack(x) for x in v]}
    if isinstance(v, Field):
        return {"property": ".".join(v.path), "apply": v.apply}
    if isinstance(v, Param):
        return {"$param": v.name}
    return v


def _unpack(v: Any) -> Any:
    if isinstance(v, dict):
        if "$date" in v:
            return dt.datetime.fromisoformat(v["$date"])
        if "$number" in v:
            return float(v["$number"])
        if "$array" in v:
            return [_unpack(x) for x in v["$array"]]
        if "$param" in v:
            return Param(v["$param"])
        if "property" in v:
            return Field(tuple(v["property"].split(".")), v.get("apply"))
        raise ValueError(f"an unknown literal: {v}")
    return v


def to_json(e: Expr) -> dict[str, Any]:
    if e is TRUE:
        return {"kind": "always"}
    if isinstance(e, Logic):
        return {"kind": e.kind, "parts": [to_json(p) for p in e.parts]}
    if isinstance(e, Compare):
        return {"kind": "compare", "op": e.op, "left": _pack(e.left), "right": _pack(e.right), "negated": e.negated}
    raise ValueError("an opaque function has no JSON form")


def from_json(d: Mapping[str, Any], known: StructType | None = None) -> Expr:
    """Back from JSON; unknown kinds, operators and (given a schema) properties are errors, never ignored."""
    kind = d.get("kind")
    if kind == "always":
        return TRUE
    if kind in ("and", "or"):
        return Logic(kind, tuple(from_json(p, known) for p in d["parts"]))
    if kind == "compare" and d["op"] in (*SWAPPED, *TEXT, "in"):
        e = Compare(d["op"], _unpack(d["left"]), _unpack(d["right"]), bool(d.get("negated")))
        if known is not None:
            for path in fields_of(e):
                Compiler(known).type_of(path.split("."))
        return e
    raise ValueError(f"an unknown predicate: {kind}")
