"""Fluent queries: immutable, lazy, applied in the order they are written.

A query is a DataFrame and the sort keys that hold so far. A sort puts its key before the earlier ones, so the last sort is
the primary one and earlier sorts break its ties; skip and take apply the keys there and then, with the collection's key
columns after them, so that a window is the same on every run. Filters, projections and sorts stay Catalyst expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType

from millrace.functions import expressions as E


#: Dimensions of a vector up to which its sums are written out.
WRITTEN_OUT = 96


def _window(rows: DataFrame, skip: int, take: int) -> DataFrame:
    """Ordered rows from ``skip`` on, ``take`` of them: each partition gives its first ones only, however many rows there are."""
    return rows.limit(skip + take).offset(skip)


@dataclass(frozen=True)
class Query:
    df: DataFrame
    keys: tuple[str, ...] = ()
    order: tuple[Column, ...] = ()
    steps: tuple[dict[str, Any], ...] = ()
    transforms: Mapping[str, Any] = field(default_factory=dict)
    dimensions: Mapping[str, int] = field(default_factory=dict)
    skipped: tuple[DataFrame, int] | None = None

    # -- building ---------------------------------------------------------------------------------------------------

    def _next(self, step: dict[str, Any], **changes: Any) -> Query:
        return replace(self, steps=(*self.steps, step), **({"skipped": None} | changes))

    def column(self, what: str | E.Field | Column) -> Column:
        if isinstance(what, Column):
            return what
        f = E.field(what) if isinstance(what, str) else what
        return E.Compiler(self.df.schema).column(f)

    def where(self, predicate: E.Expr | Column, params: Mapping[str, Any] | None = None) -> Query:
        """Keep the rows for which the predicate is true. ``params`` give the values of its parameters."""
        if isinstance(predicate, Column):
            return self._next({"kind": "filter", "column": True}, df=self.df.where(predicate))
        if predicate is E.TRUE:
            return self
        condition = E.Compiler(self.df.schema, params, transforms=self.transforms).compile(predicate)
        return self._next({"kind": "filter", "predicate": predicate, "params": dict(params or {})}, df=self.df.where(condition))

    def map(self, *columns: str | Column, **named: str | E.Field | Column) -> Query:
        """Project to columns, renamed or computed ones as keywords. Sort keys that hold are kept alongside until they are used."""
        ordered = self._ordered() if self.order else self
        picked = [self.column(c) if isinstance(c, Column) else self.column(c).alias(c.split(".")[-1]) for c in columns]
        picked += [self.column(c).alias(n) for n, c in named.items()]
        names = {*(c.split(".")[-1] for c in columns if isinstance(c, str)), *named}
        keys = self.keys if set(self.keys) <= names else ()
        # a projection after the sort keeps its order
        return replace(ordered, df=ordered.df.select(*picked), keys=keys, order=(), skipped=None, steps=(*self.steps, {"kind": "map", "columns": [c for c in columns if isinstance(c, str)], "named": {n: c for n, c in named.items() if isinstance(c, str)}}))

    def sort(self, by: str | E.Field | Column, descending: bool = False) -> Query:
        """Nulls first ascending, last descending."""
        c = self.column(by)
        key = c.desc_nulls_last() if descending else c.asc_nulls_first()
        return self._next({"kind": "sort", "by": by if isinstance(by, str) else None, "descending": descending}, order=(key, *self.order))

    def sort_descending(self, by: str | E.Field | Column) -> Query:
        return self.sort(by, descending=True)

    def _ordered(self) -> Query:
        if not self.order:
            return self
        return replace(self, df=self.df.orderBy(*self.order, *[F.col(f"`{k}`") for k in self.keys]))

    def skip(self, n: int) -> Query:
        """Without effect for n of 0 or less. A take that follows at once makes one top-n of both."""
        if n <= 0:
            return self
        rows, before = self.skipped or (self._ordered().df, 0)
        return self._next({"kind": "skip", "n": n}, df=rows.offset(before + n), skipped=(rows, before + n))

    def take(self, n: int) -> Query:
        """Without effect for n of 0 or less."""
        if n <= 0:
            return self
        return self._next({"kind": "take", "n": n}, df=_window(*self.skipped, n) if self.skipped else self._ordered().df.limit(n))

    def nearest(self, prop: str, vector: Sequence[float], k: int) -> Query:
        """The k rows with the least cosine distance; null, zero and wrongly long vectors come last. See ``cosine_distance``."""
        kind = E.Compiler(self.df.schema).type_of(prop.split("."))
        if not isinstance(kind, ArrayType) or not isinstance(kind.elementType, NumericType):
            raise TypeError(f"{prop} is no vector")
        if self.dimensions.get(prop, len(vector)) != len(vector):
            raise ValueError(f"{prop} has {self.dimensions[prop]} dimensions, the query {len(vector)}")
        step = {"kind": "nearest", "property": prop, "vector": list(map(float, vector)), "k": k}
        if k <= 0:
            return self._next(step, df=self.df.limit(0), order=())
        distance = cosine_distance(prop, vector)
        ties = [F.col(f"`{x}`") for x in self.keys]
        return self._next(step, df=self.df.orderBy(distance, *self.order, *ties).limit(k), order=(distance.asc(), *self.order))

    def apply(self, composer: Composer) -> Query:
        return composer.apply(self)

    def join(self, inner: Query, outer_key: str, inner_key: str) -> Any:
        from millrace.operators.join import join

        return join(self, inner, outer_key, inner_key, "inner")

    def left_join(self, inner: Query, outer_key: str, inner_key: str) -> Any:
        from millrace.operators.join import join

        return join(self, inner, outer_key, inner_key, "left")

    # -- terminals: as DataFrames, and as Python values ----------------------------------------------------------------

    def to_df(self) -> DataFrame:
        return self._ordered().df

    def collect(self) -> list[Row]:
        return self.to_df().collect()

    def _single(self) -> str:
        if len(self.df.columns) != 1:
            raise ValueError("map to one property first")
        return self.df.columns[0]

    def count_df(self, name: str = "count") -> DataFrame:
        return self.df.agg(F.count("*").alias(name))

    def count(self) -> int:
        return self.count_df().first()[0]

    def sum_df(self, name: str = "sum") -> DataFrame:
        c = self._single()
        if not isinstance(self.df.schema[c].dataType, NumericType):
            raise TypeError(f"{c} is no number")
        return self.df.agg(F.sum(F.col(f"`{c}`")).alias(name))

    def sum(self) -> Any:
        return self._present(self.sum_df())

    def min_df(self, name: str = "min") -> DataFrame:
        return self.df.agg(F.min(F.col(f"`{self._single()}`")).alias(name))

    def max_df(self, name: str = "max") -> DataFrame:
        return self.df.agg(F.max(F.col(f"`{self._single()}`")).alias(name))

    def min(self) -> Any:
        return self._present(self.min_df())

    def max(self) -> Any:
        return self._present(self.max_df())

    @staticmethod
    def _present(df: DataFrame) -> Any:
        value = df.first()[0]
        if value is None:
            raise LookupError("no items found")
        return value

    def distinct(self) -> DataFrame:
        """The different values of one property; null is none."""
        c = self._single()
        return self.df.where(F.col(f"`{c}`").isNotNull()).distinct()

    def some_df(self, predicate: E.Expr | Column | None = None, name: str = "some") -> DataFrame:
        found = (self.where(predicate) if predicate is not None else self).df.limit(1)
        return found.agg((F.count("*") > 0).alias(name))

    def some(self, predicate: E.Expr | Column | None = None) -> bool:
        return self.some_df(predicate).first()[0]

    def every_df(self, predicate: E.Expr, name: str = "every") -> DataFrame:
        holds = E.Compiler(self.df.schema, transforms=self.transforms).compile(predicate)
        return self.df.where(~F.coalesce(holds, F.lit(False))).limit(1).agg((F.count("*") == 0).alias(name))

    def every(self, predicate: E.Expr) -> bool:
        return self.every_df(predicate).first()[0]

    def first_or_none(self, predicate: E.Expr | Column | None = None) -> Row | None:
        return (self.where(predicate) if predicate is not None else self).take(1).to_df().first()

    def first(self, predicate: E.Expr | Column | None = None) -> Row:
        row = self.first_or_none(predicate)
        if row is None:
            raise LookupError("no items found")
        return row

    def to_group(self, by: str) -> DataFrame:
        """``key`` as string and ``rows``, the group's rows. For large groups use ``grouped``, which collects nothing."""
        rows = F.collect_list(F.struct(*[F.col(f"`{c}`") for c in self.df.columns]))
        return self.df.groupBy(self.column(by).cast("string").alias("key")).agg(rows.alias("rows"))

    def grouped(self, by: str) -> Any:
        return self.df.groupBy(self.column(by).cast("string").alias("key"))

    def explain(self) -> tuple[DataFrame, Any]:
        from millrace.plans.explain import explain

        df = self.to_df()
        return df, explain(df, self.steps)


def cosine_distance(prop: str, vector: Sequence[float]) -> Column:
    """1 - cosine; infinite where the vector is null, holds a null, has another width or no length.

    Up to ``WRITTEN_OUT`` dimensions the sums are written out and parsed as one expression: they stay in generated code, where
    higher-order functions would not. Wider vectors take those, with the same order of additions; their code doesn't grow.
    """
    given = [float(x) for x in vector]
    norm = sum(x * x for x in given) ** 0.5
    if not norm:
        return F.lit(float("inf"))
    name = ".".join(f"`{x}`" for x in prop.split("."))
    if len(given) > WRITTEN_OUT:
        values = f"array({', '.join(f'{x!r}D' for x in given)})"
        dot, square = (f"aggregate(zip_with({name}, {other}, (x, y) -> double(x) * double(y)), 0D, (a, x) -> a + x)" for other in (values, name))
        return F.expr(f"coalesce(case when size({name}) = {len(given)} and {square} > 0 then 1 - {dot} / (sqrt({square}) * {norm!r}D) end, double('infinity'))")
    part = [f"double(get({name}, {i}))" for i in range(len(given))]
    dot = " + ".join(f"{p} * {x!r}D" for p, x in zip(part, given, strict=True))
    square = " + ".join(f"{p} * {p}" for p in part)
    fits = f"size({name}) = {len(given)} and ({square}) > 0"
    return F.expr(f"coalesce(case when {fits} then 1 - ({dot}) / (sqrt({square}) * {norm!r}D) end, double('infinity'))")


@dataclass(frozen=True)
class Composer:
    """A reusable piece of a query: what is chained on it is applied to a query later. Paging: skip before take, each once."""

    calls: tuple[tuple[str, tuple, tuple], ...] = ()

    def _add(self, name: str, *args: Any, **named: Any) -> Composer:
        if name in ("skip", "take") and any(c[0] == "take" or c[0] == name for c in self.calls):
            raise ValueError(f"{name} can't follow take or itself")
        return Composer((*self.calls, (name, args, tuple(named.items()))))

    def where(self, *a: Any, **n: Any) -> Composer:
        return self._add("where", *a, **n)

    def map(self, *a: Any, **n: Any) -> Composer:
        return self._add("map", *a, **n)

    def sort(self, *a: Any, **n: Any) -> Composer:
        return self._add("sort", *a, **n)

    def sort_descending(self, *a: Any) -> Composer:
        return self._add("sort_descending", *a)

    def skip(self, n: int) -> Composer:
        return self._add("skip", n)

    def take(self, n: int) -> Composer:
        return self._add("take", n)

    def apply(self, query: Query) -> Query:
        for name, args, named in self.calls:
            query = getattr(query, name)(*args, **dict(named))
        return query


def query(df: DataFrame, *keys: str, scopes: Sequence[E.Expr | Column | Callable[[DataFrame], Column]] = ()) -> Query:
    """A query over a DataFrame whose rows are told apart by ``keys``; ``scopes`` are filters that always hold, applied first."""
    q = Query(df, tuple(keys))
    for s in scopes:
        q = q.where(s(df) if callable(s) and not isinstance(s, (Column, E.Expr)) else s)
    return q
