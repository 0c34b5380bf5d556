"""A store of collections on plain parquet: staged changes, one atomic commit, versions, soft deletion and audit.

Each commit writes new folders for the collections it changes, then publishes one numbered manifest that names the current
folder of every collection. Readers see the old or the new state, never a mix; a failed commit leaves only folders that nothing names.
The manifest goes through Hadoop's file system API, so the root may be on any store that Spark reads.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import expressions as E
from millrace.operators import changes as C
from millrace.operators.query import Query
from millrace.schema import Schema

VERSION = "__version"


class ConcurrencyError(RuntimeError):
    """Rows were updated from versions that are no longer current; nothing was applied."""

    def __init__(self, collection: str, keys: list[Any]) -> None:
        super().__init__(f"{collection}: {len(keys)} rows were changed meanwhile: {keys[:10]}")
        self.keys = keys


@dataclass(frozen=True)
class Collection:
    schema: Schema
    scopes: tuple[E.Expr | Column, ...] = ()
    soft_delete: str | None = None
    audit: str | None = None
    versioned: bool = False

    def scope(self, predicate: E.Expr | Column) -> Collection:
        return replace(self, scopes=(*self.scopes, predicate))


@dataclass
class _Staged:
    adds: list[DataFrame] = field(default_factory=list)
    updates: list[DataFrame] = field(default_factory=list)
    removes: list[DataFrame] = field(default_factory=list)


class Files:
    """A few operations of Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root, self.conf, self.gateway = spark._jvm, root.rstrip("/"), spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.conf)

    def path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def latest(self, name: str) -> tuple[int, str | None]:
        """The greatest number that was published under the name, and its text; 0 and none if there is none."""
        found = self.fs.globStatus(self.path(f"{name}-*.json")) or []
        numbers = [int(f.getPath().getName()[len(name) + 1 : -5]) for f in found]
        return (max(numbers), self.read(f"{name}-{max(numbers):012d}.json")) if numbers else (0, None)

    def publish(self, name: str, number: int, text: str) -> bool:
        """Write the text whole under a number that nobody has published; false if someone was first.

        The file is written apart and then renamed to where nothing may be yet, which file systems do in one step: readers see
        all of it or the one before, whatever fails in between.
        """
        part, target = self.path(f".{name}.{uuid.uuid4().hex}"), self.path(f"{name}-{number:012d}.json")
        stream = self.fs.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        hadoop = self.jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(target.getFileSystem(self.conf).getUri(), self.conf)
        options = self.gateway.new_array(getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename").valueOf("NONE")
        try:
            context.rename(part, target, options)
        except Py4JJavaError as e:
            self.fs.delete(part, False)
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True


class DataStore:
    def __init__(self, spark: SparkSession, root: str, *collections: Collection) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.collections = {c.schema.name: c for c in collections}
        self.files = Files(spark, self.root)
        self.staged: dict[str, _Staged] = {}
        self.listeners: list[Callable[[dict[str, DataFrame]], None]] = []

    # -- reading -----------------------------------------------------------------------------------------------------

    def _manifest(self) -> dict[str, Any]:
        # the newest of the numbered manifests counts
        text = self.files.latest("manifest")[1]
        return json.loads(text) if text else {"commit": 0, "folders": {}}

    def stored(self, name: str) -> DataFrame:
        c = self.collections[name]
        folder = self._manifest()["folders"].get(name)
        struct = c.schema.storage_struct()
        if c.versioned:
            struct = struct.add(VERSION, "long")
        return self.spark.read.schema(struct).parquet(f"{self.root}/{folder}") if folder else self.spark.createDataFrame([], struct)

    def entities(self, name: str, versions: bool = False) -> DataFrame:
        c, rows = self.collections[name], self.stored(name)
        found = c.schema.read(rows)
        if not (versions and c.versioned):
            return found
        seen = rows.select(*[F.col(f"`{c.schema[k].stored}`").alias(k) for k in c.schema.keys], VERSION)
        return found.join(seen, c.schema.keys)

    def query(self, name: str, versions: bool = False) -> Query:
        """The collection's rows under its scopes; soft-deleted rows are hidden."""
        c = self.collections[name]
        q = Query(self.entities(name, versions), tuple(c.schema.keys), transforms={}, dimensions={p.name: p.dimensions for p in c.schema.properties if p.dimensions})
        if c.soft_delete:
            q = q.where(F.col(f"`{c.soft_delete}`").isNull())
        for s in c.scopes:
            q = q.where(s)
        return q

    # -- staging -----------------------------------------------------------------------------------------------------

    def _stage(self, name: str) -> _Staged:
        return self.staged.setdefault(name, _Staged())

    def add(self, name: str, rows: DataFrame) -> None:
        self._stage(name).adds.append(rows)

    def update(self, name: str, rows: DataFrame) -> None:
        """Rows with the key columns and those that change; with ``__version`` the update holds for that version only."""
        self._stage(name).updates.append(rows)

    def remove(self, name: str, rows: DataFrame | Query) -> None:
        self._stage(name).removes.append(rows.to_df() if isinstance(rows, Query) else rows)

    def remove_all(self, name: str) -> None:
        self.remove(name, self.query(name))

    def has_changes(self) -> bool:
        return any(x for s in self.staged.values() for part in (s.adds, s.updates, s.removes) for x in [not p.isEmpty() for p in part])

    def preview(self) -> dict[str, DataFrame]:
        """What ``save`` would do to each collection: a ``diff``."""
        return {n: C.diff(self.entities(n), self._after(n, s)[0], self.collections[n].schema.keys) for n, s in self.staged.items()}

    def _after(self, name: str, s: _Staged) -> tuple[DataFrame, DataFrame | None]:
        """The collection's entities after the changes, and their versions."""
        c = self.collections[name]
        schema, keys = c.schema, c.schema.keys
        now = self.entities(name)
        union = lambda parts: None if not parts else parts[0] if len(parts) == 1 else union([parts[0].unionByName(parts[1], allowMissingColumns=True), *parts[2:]])
        adds, updates, removes = union(s.adds), union(s.updates), union(s.removes)
        lists = [x.select(*keys) for x in (updates, removes) if x is not None]
        if len(lists) == 2 and not lists[0].join(lists[1], keys, "left_semi").isEmpty():
            raise ValueError(f"{name}: a row is both updated and removed")
        touched = None
        if updates is not None:
            frozen = [p.name for p in schema.properties if p.is_readonly and p.name in updates.columns]
            if frozen:
                raise ValueError(f"{name}: {', '.join(frozen)} is read-only")
            if c.versioned and VERSION in updates.columns:
                bad = C.conflicts(self.entities(name, versions=True), updates, keys).limit(100).collect()
                if bad:
                    raise ConcurrencyError(name, [tuple(r[k] for k in keys) for r in bad])
            for part in s.updates:  # each with its own columns: a null in one of them is a value
                now = schema.merge(now, part.drop(VERSION))
            touched = updates.select(*keys)
        if removes is not None:
            if c.soft_delete:
                kind = schema[c.soft_delete].dtype.typeName()
                now = C.soft_delete(now, removes, keys, c.soft_delete, F.lit(True) if kind == "boolean" else F.current_timestamp().cast(schema[c.soft_delete].dtype))
                touched = removes.select(*keys) if touched is None else touched.union(removes.select(*keys))
            else:
                now = now.join(removes.select(*keys).distinct(), keys, "left_anti").select(*schema.columns)
        if adds is not None:
            numbers = [p.name for p in schema.properties if p.is_identity and p.dtype.typeName() != "string"]
            most = self.entities(name).agg(*[F.max(F.col(f"`{n}`")) for n in numbers]).first() if numbers else ()
            now = now.unionByName(schema.enrich(adds, {n: int(m or 0) for n, m in zip(numbers, most, strict=True)}))
        return now, touched

    # -- saving ------------------------------------------------------------------------------------------------------

    def save(self) -> dict[str, DataFrame]:
        """Apply all staged changes in one commit; what changed, by collection. On any error nothing is applied."""
        manifest = self._manifest()
        number, folders, done = manifest["commit"] + 1, dict(manifest["folders"]), {}
        at = F.lit(time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime())).cast("timestamp")
        trails: dict[str, list[DataFrame]] = {}
        for name, s in self.staged.items():
            c = self.collections[name]
            before = self.entities(name)
            after, touched = self._after(name, s)
            folder = f"{name}/commit={number}-{uuid.uuid4().hex[:8]}"
            rows = c.schema.write(after)
            if c.versioned:
                keys = [c.schema[k].stored for k in c.schema.keys]
                old = self.stored(name).select(*keys, VERSION)
                rows = rows.join(old, keys, "left")
                if touched is not None:
                    again = touched.distinct().select(*[F.col(k).alias(c.schema[k].stored) for k in c.schema.keys], F.lit(1).alias("__up"))
                    rows = rows.join(again, keys, "left").withColumn(VERSION, F.col(VERSION) + F.coalesce("__up", F.lit(0))).drop("__up")
                rows = rows.withColumn(VERSION, F.coalesce(VERSION, F.lit(1)).cast("bigint"))
            rows.write.parquet(f"{self.root}/{folder}")
            struct = c.schema.storage_struct()
            written = c.schema.read(self.spark.read.schema(struct).parquet(f"{self.root}/{folder}"))
            problems = c.schema.problems(written).collect()
            if problems:
                raise ValueError(f"{name}: " + "; ".join(f"{p.problem} ({p.rows})" for p in problems))
            folders[name] = folder
            done[name] = C.diff(before, written, c.schema.keys)
            if c.audit:
                trails.setdefault(c.audit, []).append(C.audit_rows(done[name], c.schema.keys, at).withColumn("collection", F.lit(name)))
        for audit, parts in trails.items():
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
            old = manifest["folders"].get(audit)
            folder = f"{audit}/commit={number}-{uuid.uuid4().hex[:8]}"
            if old:
                rows = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{old}").unionByName(rows)
            rows.write.parquet(f"{self.root}/{folder}")
            folders[audit] = folder
        if not self.files.publish("manifest", number, json.dumps({"commit": number, "folders": folders})):
            raise ConcurrencyError("store", [number])
        self.staged.clear()
        for listener in self.listeners:
            listener(done)
        return done

    def audit_trail(self, name: str) -> DataFrame:
        folder = self._manifest()["folders"].get(name)
        return self.spark.read.parquet(f"{self.root}/{folder}") if folder else self.spark.createDataFrame([], "place int, op string, entity_key string, content string, at timestamp, collection string")


class View:
    """A derived, stored collection: with a key of its own it mirrors the derivation, without one it accumulates its versions."""

    def __init__(self, store: DataStore, name: str, derive: Callable[[], DataFrame], keys: Sequence[str] = (), content_key: str = "id") -> None:
        self.store, self.name, self.derive, self.keys, self.content_key = store, name, derive, list(keys), content_key
        self.files = store.files

    def read(self) -> DataFrame | None:
        text = self.files.latest(f"view-{self.name}")[1]
        return self.store.spark.read.parquet(f"{self.store.root}/{json.loads(text)['folder']}") if text else None

    def compute(self) -> DataFrame:
        """Refresh; returns the changes."""
        derived, old = self.derive(), self.read()
        if self.keys:
            stored = old if old is not None else derived.limit(0)
            changes = C.mirror(stored, derived, self.keys)
            after = C.apply_diff(stored, changes, self.keys)
        else:
            stored = old if old is not None else derived.withColumn(self.content_key, C.version_key(derived)).limit(0)
            changes = C.accumulate(stored, derived, self.content_key)
            after = stored.unionByName(changes)
        folder = f"view-{self.name}/{uuid.uuid4().hex}"
        after.write.parquet(f"{self.store.root}/{folder}")
        self._publish(folder)
        return changes

    def _publish(self, folder: str) -> None:
        number = self.files.latest(f"view-{self.name}")[0] + 1
        if not self.files.publish(f"view-{self.name}", number, json.dumps({"folder": folder})):
            raise ConcurrencyError(f"view {self.name}", [number])

    def empty(self) -> None:
        old = self.read()
        if old is not None:
            folder = f"view-{self.name}/{uuid.uuid4().hex}"
            old.limit(0).write.parquet(f"{self.store.root}/{folder}")
            self._publish(folder)
