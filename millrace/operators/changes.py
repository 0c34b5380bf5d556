"""Differences of tables by key, materialised views, audit rows and version checks, as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row for each key: the last in the given order."""
    w = Window.partitionBy(*keys).orderBy(*[(F.col(o) if isinstance(o, str) else o).desc() for o in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What leads from ``old`` to ``new``: ``_op`` (add, update, remove) and the row: the new one, for removals the old one.

    Rows that are the same are left out. The key columns are compared as they are, never joined into one string.
    """
    columns = new.columns
    a = old.select(*[F.col(f"`{k}`").alias(f"__a{i}") for i, k in enumerate(keys)], F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__old"))
    b = new.select(*[F.col(f"`{k}`").alias(f"__b{i}") for i, k in enumerate(keys)], F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__new"))
    on = [F.col(f"__a{i}") == F.col(f"__b{i}") for i in range(len(keys))]
    both = a.join(b, on, "full_outer")
    op = F.when(F.col("__old").isNull(), "add").when(F.col("__new").isNull(), "remove").when(~F.col("__old").eqNullSafe(F.col("__new")), "update")
    row = F.coalesce("__new", "__old")
    return both.withColumn("_op", op).where("_op is not null").select("_op", *[row.getField(c).alias(c) for c in columns])


def apply_diff(old: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` after the changes of a ``diff``."""
    gone = changes.select(*keys).distinct()
    return old.join(gone, list(keys), "left_anti").select(*old.columns).unionByName(changes.where("_op <> 'remove'").select(*old.columns))


def mirror(stored: DataFrame, derived: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ()) -> DataFrame:
    """A mirroring view's changes: the stored rows become the derivation, last of each key; rows it no longer has go.

    Without an ``order`` the last is the last of the derivation's rows as they come.
    """
    if order:
        return diff(stored, latest(derived, keys, order), keys)
    numbered = derived.withColumn("__place", F.monotonically_increasing_id())
    return diff(stored, latest(numbered, keys, ["__place"]).drop("__place"), keys)


def version_key(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """A key from a row's content."""
    names = list(columns or df.columns)
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"}), 256)


def accumulate(stored: DataFrame, derived: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """An accumulating view's new rows: versions whose content key isn't stored yet. Nothing is ever removed."""
    fresh = derived.withColumn(key, version_key(derived, columns)).dropDuplicates([key])
    return fresh.join(stored.select(key), key, "left_anti").select(*[c for c in fresh.columns])


def soft_delete(rows: DataFrame, doomed: DataFrame, keys: Sequence[str], prop: str, stamp: Column) -> DataFrame:
    """``rows`` with ``prop`` stamped where the key is in ``doomed``; rows stamped before keep their stamp."""
    marked = doomed.select(*keys).distinct().withColumn("__doomed", F.lit(True))
    joined = rows.join(marked, list(keys), "left")
    value = F.when(F.col("__doomed") & F.col(f"`{prop}`").isNull(), stamp).otherwise(F.col(f"`{prop}`"))
    return joined.withColumn(prop, value).select(*rows.columns)


def audit_rows(changes: DataFrame, keys: Sequence[str], at: Column) -> DataFrame:
    """A row for each change: its place by kind (removals, updates, additions), key and content as JSON, one time for all."""
    place = F.when(F.col("_op") == "remove", 0).when(F.col("_op") == "update", 1).otherwise(2)
    names = [c for c in changes.columns if c != "_op"]
    return changes.select(place.alias("place"), F.col("_op").alias("op"), F.to_json(F.struct(*keys)).alias("entity_key"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"}).alias("content"), at.alias("at"))


def conflicts(stored: DataFrame, updates: DataFrame, keys: Sequence[str], version: str = "__version") -> DataFrame:
    """The keys of updates made from another version than the stored one. Updates without a version are not checked."""
    seen = updates.select(*keys, F.col(f"`{version}`").alias("__seen")).where("__seen is not null")
    return seen.join(stored.select(*keys, version), list(keys)).where(F.col("__seen") != F.col(f"`{version}`")).select(*keys, "__seen", version)
