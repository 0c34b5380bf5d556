"""Schemas: named, typed properties with modifiers, and the set-based operations that follow from them.

    products = define("products", id=string().key().identity(), name=string().searchable(), price=number().default(0.0))

A schema turns stored rows into entities (``read``) and back (``write``), fills defaults, identities and computed columns
(``enrich``), and gives comparison, hash and merge of entities as column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Transform:
    """A stored form: ``to`` for writing, ``back`` for reading. ``comparable`` says what filters may do on it."""

    to: Callable[[Column], Column]
    back: Callable[[Column], Column]
    comparable: str | None = None  # "equality", or None: any test

    def __call__(self, c: Column) -> Column:
        return self.to(c)


@dataclass(frozen=True)
class Property:
    dtype: T.DataType
    name: str = ""
    is_key: bool = False
    is_identity: bool = False
    is_nullable: bool = False
    is_distinct: bool = False
    is_readonly: bool = False
    is_searchable: bool = False
    is_tracked: bool = False
    default_value: Any = None
    has_default: bool = False
    storage: str | None = None
    encode: Callable[[Column], Column] | None = None
    decode: Callable[[Column], Column] | None = None
    transform: Transform | None = None
    compute: Callable[[Mapping[str, Column]], Column] | None = None
    indexes: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    references: str | None = None
    literals: tuple[Any, ...] = ()
    max_length: int | None = None
    dimensions: int | None = None
    children: tuple[Property, ...] = field(default=())

    def key(self) -> Property:
        if not isinstance(self.dtype, (T.StringType, T.DoubleType, T.LongType, T.IntegerType)):
            raise ValueError("keys are strings or numbers")
        return replace(self, is_key=True)

    def identity(self) -> Property:
        return replace(self, is_identity=True)

    def nullable(self) -> Property:
        return replace(self, is_nullable=True)

    optional = nullable

    def default(self, value: Any) -> Property:
        """A value, a Column, or a function without arguments that gives one."""
        return replace(self, default_value=value, has_default=True)

    def distinct(self) -> Property:
        return replace(self, is_distinct=True)

    def index(self, *names: str) -> Property:
        return replace(self, indexes=names or ("",))

    def stored_as(self, name: str) -> Property:
        return replace(self, storage=name)

    def serialize(self, f: Callable[[Column], Column]) -> Property:
        return replace(self, encode=f)

    def deserialize(self, f: Callable[[Column], Column]) -> Property:
        return replace(self, decode=f)

    def transformed(self, t: Transform) -> Property:
        return replace(self, transform=t)

    def readonly(self) -> Property:
        return replace(self, is_readonly=True)

    def searchable(self) -> Property:
        if not isinstance(self.dtype, T.StringType):
            raise ValueError("only strings are searchable")
        return replace(self, is_searchable=True)

    def foreign_key(self, target: str) -> Property:
        return replace(self, references=target)

    def tag(self, *names: str) -> Property:
        return replace(self, tags=(*self.tags, *names))

    def tracked(self) -> Property:
        return replace(self, is_tracked=True)

    @property
    def stored(self) -> str:
        return self.storage or self.name

    @property
    def is_stored(self) -> bool:
        return self.compute is None or self.is_tracked


def string(*literals: str, max_length: int | None = None) -> Property:
    return Property(T.StringType(), literals=literals, max_length=max_length)


def number(kind: str = "double") -> Property:
    return Property({"double": T.DoubleType(), "long": T.LongType(), "int": T.IntegerType()}[kind])


def boolean() -> Property:
    return Property(T.BooleanType())


def date() -> Property:
    return Property(T.TimestampType())


def array(of: Property) -> Property:
    return Property(T.ArrayType(of.dtype))


def obj(**properties: Property) -> Property:
    children = tuple(replace(p, name=n) for n, p in properties.items())
    return Property(T.StructType([T.StructField(c.name, c.dtype) for c in children]), children=children)


def vector(dimensions: int) -> Property:
    return Property(T.ArrayType(T.DoubleType()), dimensions=dimensions)


def file() -> Property:
    """A reference to content that is kept elsewhere."""
    names = [("key", T.StringType()), ("size", T.LongType()), ("content_type", T.StringType()), ("checksum", T.StringType()), ("file_name", T.StringType())]
    return Property(T.StructType([T.StructField(n, t) for n, t in names]))


def computed(dtype: str, f: Callable[[Mapping[str, Column]], Column]) -> Property:
    """Derived from other properties at read; stored only if tracked."""
    return Property(T._parse_datatype_string(dtype), compute=f)


@dataclass(frozen=True)
class Schema:
    name: str
    properties: tuple[Property, ...]

    def __getitem__(self, name: str) -> Property:
        for p in self.properties:
            if p.name == name:
                return p
        raise KeyError(f"{self.name} has no property {name}")

    @property
    def keys(self) -> list[str]:
        return [p.name for p in self.properties if p.is_key]

    @property
    def columns(self) -> list[str]:
        return [p.name for p in self.properties]

    @property
    def stored(self) -> list[Property]:
        return [p for p in self.properties if p.is_stored]

    @property
    def searchable(self) -> list[str]:
        return [p.name for p in self.properties if p.is_searchable]

    @property
    def transforms(self) -> dict[str, Transform]:
        return {p.name: p.transform for p in self.properties if p.transform}

    def modify(self, **more: Property) -> Schema:
        """With properties added or replaced."""
        kept = [p for p in self.properties if p.name not in more]
        return Schema(self.name, (*kept, *(replace(p, name=n) for n, p in more.items())))

    def struct(self) -> T.StructType:
        """The entity's type; modifiers are in the fields' metadata."""
        fields = []
        for p in self.properties:
            notes = {k: v for k, v in {"key": p.is_key, "searchable": p.is_searchable, "dimensions": p.dimensions, "storage": p.storage, "tags": list(p.tags)}.items() if v}
            fields.append(T.StructField(p.name, p.dtype, True, notes))
        return T.StructType(fields)

    def storage_struct(self) -> T.StructType:
        return T.StructType([T.StructField(p.stored, p.dtype) for p in self.stored])

    def _computed(self, df: DataFrame, tracked: bool) -> DataFrame:
        for p in self.properties:
            if p.compute is not None and (tracked or not p.is_tracked):
                df = df.withColumn(p.name, p.compute({c: F.col(f"`{c}`") for c in df.columns}).cast(p.dtype))
        return df

    def read(self, stored: DataFrame) -> DataFrame:
        """Stored rows as entities: renames, codecs, transforms, then computed columns. Columns that are missing are null."""
        def one(p: Property) -> Column:
            if p.stored not in stored.columns:
                return F.lit(None).cast(p.dtype).alias(p.name)
            c = F.col(f"`{p.stored}`")
            c = p.transform.back(c) if p.transform else p.decode(c) if p.decode else c
            return c.alias(p.name)

        return self._computed(stored.select(*[one(p) for p in self.stored]), tracked=False).select(*self.columns)

    def write(self, entities: DataFrame) -> DataFrame:
        def one(p: Property) -> Column:
            c = F.col(f"`{p.name}`") if p.name in entities.columns else F.lit(None).cast(p.dtype)
            c = p.transform.to(c) if p.transform else p.encode(c) if p.encode else c
            return c.alias(p.stored)

        return entities.select(*[one(p) for p in self.stored])

    def enrich(self, entities: DataFrame, start: int | dict[str, int] = 0) -> DataFrame:
        """Missing columns added, defaults for null, store-assigned identities (uuid, or numbers after ``start``, which may be by property), computed columns."""
        df = entities
        for p in self.properties:
            if p.name not in df.columns:
                df = df.withColumn(p.name, F.lit(None).cast(p.dtype))
            if p.has_default:
                value = p.default_value() if callable(p.default_value) else p.default_value
                df = df.withColumn(p.name, F.coalesce(F.col(f"`{p.name}`"), (value if isinstance(value, Column) else F.lit(value)).cast(p.dtype)))
            if p.is_identity:
                if isinstance(p.dtype, T.StringType):
                    df = df.withColumn(p.name, F.coalesce(F.col(f"`{p.name}`"), F.expr("uuid()")))
                else:
                    df = _numbered(df, p.name, p.dtype, start.get(p.name, 0) if isinstance(start, dict) else start)
        return self._computed(df, tracked=True).select(*self.columns)

    def strip(self, entities: DataFrame) -> DataFrame:
        """Without identities, keys and what is derived."""
        return entities.drop(*[p.name for p in self.properties if p.is_key or p.is_identity or p.compute is not None])

    def content(self, prefix: str = "") -> Column:
        """All mapped properties as one struct, which ``eqNullSafe`` compares."""
        return F.struct(*[F.col(f"{prefix}`{p.name}`").alias(p.name) for p in self.stored])

    def hash(self, prefix: str = "") -> Column:
        return F.sha2(F.to_json(self.content(prefix), {"ignoreNullFields": "false"}), 256)

    def merge(self, old: DataFrame, changes: DataFrame) -> DataFrame:
        """``old`` with the columns of ``changes``, nulls included, by key; then defaults."""
        own = [c for c in changes.columns if c not in self.keys]
        new = changes.select(*self.keys, *[F.col(f"`{c}`").alias(f"__{c}") for c in own], F.lit(True).alias("__hit"))
        joined = old.join(new, self.keys, "left")
        merged = joined.select(*[F.when(F.col("__hit"), F.col(f"`__{c}`")).otherwise(F.col(f"`{c}`")).alias(c) if c in own else F.col(f"`{c}`") for c in self.columns])
        return self.enrich(merged)

    def problems(self, entities: DataFrame) -> DataFrame:
        """``problem`` and ``rows`` for each rule that rows break: null keys, required nulls, literals, lengths, dimensions, repeated keys."""
        tests: list[tuple[str, Column]] = []
        for p in self.properties:
            c = F.col(f"`{p.name}`")
            if p.is_key or not (p.is_nullable or p.has_default or p.is_identity or p.compute is not None):
                tests.append((f"{p.name} is null", c.isNull()))
            if p.literals:
                tests.append((f"{p.name} has an unknown value", ~c.isin(list(p.literals))))
            if p.max_length:
                tests.append((f"{p.name} is too long", F.length(c) > p.max_length))
            if p.dimensions:
                tests.append((f"{p.name} has a wrong width", F.size(c) != p.dimensions))
        found = [entities.where(t).agg(F.count("*").alias("rows")).select(F.lit(n).alias("problem"), "rows") for n, t in tests]
        unique = [self.keys] if self.keys else []
        unique += [[p.name] for p in self.properties if p.is_distinct]
        for names in unique:
            again = entities.where(F.col(f"`{names[0]}`").isNotNull()).groupBy(*names).count().where("count > 1")
            found.append(again.agg(F.count("*").alias("rows")).select(F.lit(f"{', '.join(names)} is not unique").alias("problem"), "rows"))
        out = found[0]
        for x in found[1:]:
            out = out.union(x)
        return out.where("rows > 0")

    def json_schema(self) -> dict[str, Any]:
        def one(t: T.DataType) -> dict[str, Any]:
            if isinstance(t, T.StructType):
                return {"type": "object", "properties": {f.name: one(f.dataType) for f in t.fields}}
            if isinstance(t, T.ArrayType):
                return {"type": "array", "items": one(t.elementType)}
            if isinstance(t, T.StringType):
                return {"type": "string"}
            if isinstance(t, T.BooleanType):
                return {"type": "boolean"}
            if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
                return {"type": "string", "format": "date-time"}
            return {"type": "integer"} if isinstance(t, (T.IntegerType, T.LongType)) else {"type": "number"}

        properties = {}
        for p in self.properties:
            properties[p.name] = one(p.dtype) | ({"enum": list(p.literals)} if p.literals else {}) | ({"maxLength": p.max_length} if p.max_length else {})
        required = [p.name for p in self.properties if not (p.is_nullable or p.has_default or p.compute is not None)]
        return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": self.name, "type": "object", "properties": properties, "required": required}


def _numbered(df: DataFrame, name: str, dtype: T.DataType, start: int) -> DataFrame:
    """Nulls in ``name`` get the numbers after ``start``: ranks in hash groups, shifted by the groups before, so no task ranks all."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    missing = df.where(F.col(f"`{name}`").isNull()).withColumn("__g", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c != name]), F.lit(parts)))
    sizes = missing.groupBy("__g").agg(F.count("*").alias("__n"))
    before = sizes.select("__g", (F.sum("__n").over(Window.orderBy("__g")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__g").orderBy(*[F.to_json(F.struct(*[c for c in df.columns if c != name]))]))
    ranked = missing.withColumn("__r", own).join(F.broadcast(before), "__g")
    numbered = ranked.withColumn(name, (F.lit(start) + F.col("__before") + F.col("__r")).cast(dtype)).select(*df.columns)
    return df.where(F.col(f"`{name}`").isNotNull()).unionByName(numbered)


def define(name: str, /, **properties: Property) -> Schema:
    return Schema(name, tuple(replace(p, name=n) for n, p in properties.items()))


def of_frame(name: str, df: DataFrame, *keys: str) -> Schema:
    """The schema of an existing table, its types as they are."""
    return Schema(name, tuple(Property(f.dataType, name=f.name, is_key=f.name in keys, is_nullable=f.name not in keys) for f in df.schema.fields))
