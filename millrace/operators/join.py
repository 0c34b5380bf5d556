"""Equi-joins of two queries. The result's rows are pairs: a struct ``outer`` and a struct ``inner``, null where unmatched.

What was chained on either side before the join holds for that side alone: scopes and filters of the inner side decide what
counts as a match, a window on the outer side limits its rows. Keys that are null or NaN match nothing.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, FloatType, NumericType, StringType, StructType

from millrace.functions import expressions as E
from millrace.operators.query import Query, _window


@dataclass(frozen=True)
class JoinQuery:
    df: DataFrame
    keys: tuple[str, ...] = ()
    order: tuple[Column, ...] = ()
    skipped: tuple[DataFrame, int] | None = None

    def _column(self, path: str | Column) -> Column:
        return F.col(path) if isinstance(path, str) else path

    def where(self, predicate: E.Expr | Column, params: Mapping[str, Any] | None = None) -> JoinQuery:
        """A test of the pair: paths begin with ``outer.`` or ``inner.``; two sides may be compared with each other."""
        condition = predicate if isinstance(predicate, Column) else E.Compiler(self.df.schema, params).compile(predicate)
        return replace(self, df=self.df.where(condition), skipped=None)

    def sort(self, by: str | Column, descending: bool = False) -> JoinQuery:
        c = self._column(by)
        return replace(self, order=(c.desc_nulls_last() if descending else c.asc_nulls_first(), *self.order), skipped=None)

    def sort_descending(self, by: str | Column) -> JoinQuery:
        return self.sort(by, descending=True)

    def to_df(self) -> DataFrame:
        return self.df.orderBy(*self.order, *[F.col(k) for k in self.keys]) if self.order else self.df

    def skip(self, n: int) -> JoinQuery:
        if n <= 0:
            return self
        rows, before = self.skipped or (self.to_df(), 0)
        return replace(self, df=rows.offset(before + n), skipped=(rows, before + n))

    def take(self, n: int) -> JoinQuery:
        if n <= 0:
            return self
        return replace(self, df=_window(*self.skipped, n) if self.skipped else self.to_df().limit(n), skipped=None)

    def map(self, **named: str | Column) -> DataFrame:
        return self.to_df().select(*[self._column(c).alias(n) for n, c in named.items()])

    def collect(self) -> list[Row]:
        return self.to_df().collect()

    def count_df(self, name: str = "count") -> DataFrame:
        return self.df.agg(F.count("*").alias(name))

    def count(self) -> int:
        return self.count_df().first()[0]

    def first_or_none(self) -> Row | None:
        return self.take(1).to_df().first()

    def first(self) -> Row:
        row = self.first_or_none()
        if row is None:
            raise LookupError("no items found")
        return row

    def explain(self) -> tuple[DataFrame, Any]:
        from millrace.plans.explain import explain

        df = self.to_df()
        return df, explain(df, ({"kind": "join"},))


def key_type(schema: StructType, path: str) -> DataType:
    kind = E.Compiler(schema).type_of(path.split("."))
    if isinstance(kind, BooleanType) or not isinstance(kind, (StringType, NumericType)):
        raise TypeError(f"{path} is neither string nor number and can't be joined on")
    return kind


def join(outer: Query, inner: Query, outer_key: str, inner_key: str, kind: str) -> JoinQuery:
    left, right = key_type(outer.df.schema, outer_key), key_type(inner.df.schema, inner_key)
    a, b = outer.to_df() if outer.order else outer.df, inner.df
    ka, kb = E.Compiler(a.schema).column(E.field(outer_key)), E.Compiler(b.schema).column(E.field(inner_key))
    if isinstance(left, StringType) != isinstance(right, StringType):  # one side's keys are kept as text
        ka, kb = ka.cast("string"), kb.cast("string")
    elif left != right:
        ka, kb = (x.cast("double") if isinstance(left, (FloatType, DoubleType)) or isinstance(right, (FloatType, DoubleType)) else x.cast("long") for x in (ka, kb))
    number = not isinstance(left, StringType) and not isinstance(right, StringType) and any(isinstance(t, (FloatType, DoubleType)) for t in (left, right))
    pairs_a = a.select(F.struct(*[F.col(f"`{c}`") for c in a.columns]).alias("outer"), ka.alias("__ka"))
    pairs_b = b.select(F.struct(*[F.col(f"`{c}`") for c in b.columns]).alias("inner"), kb.alias("__kb"))
    on = F.col("__ka") == F.col("__kb")
    if number:  # Spark holds NaN equal to NaN
        on = on & ~F.isnan(F.col("__ka").cast("double"))
    joined = pairs_a.join(pairs_b, on, kind).drop("__ka", "__kb")
    keys = tuple(f"outer.{k}" for k in outer.keys) + tuple(f"inner.{k}" for k in inner.keys)
    return JoinQuery(joined, keys)
