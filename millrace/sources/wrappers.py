"""Wrappers of sources: caching, retries of reads, telemetry, ordered failover with mirrored writes."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame

from millrace.schema import Schema


class Cached:
    """Keeps the DataFrames it has read, the latest ``size`` of them, until a write invalidates their collection."""

    def __init__(self, source: Any, size: int = 100) -> None:
        self.source, self.size, self.kept = source, size, {}

    def read(self, schema: Schema) -> DataFrame:
        if schema.name in self.kept:
            self.kept[schema.name] = self.kept.pop(schema.name)
        else:
            self.kept[schema.name] = self.source.read(schema).persist()
            while len(self.kept) > self.size:
                self.kept.pop(next(iter(self.kept))).unpersist()
        return self.kept[schema.name]

    def write(self, schema: Schema, rows: DataFrame, **options: Any) -> None:
        self.source.write(schema, rows, **options)
        if schema.name in self.kept:
            self.kept.pop(schema.name).unpersist()


class Retried:
    """Tries a read again, by default three times in all; writes are never repeated."""

    def __init__(self, source: Any, attempts: int = 3, pause: float = 0.1) -> None:
        self.source, self.attempts, self.pause = source, attempts, pause

    def read(self, schema: Schema) -> DataFrame:
        for n in range(self.attempts):
            try:
                return self.source.read(schema)
            except Exception:
                if n + 1 == self.attempts:
                    raise
                time.sleep(self.pause * 2**n)
        raise AssertionError

    def write(self, schema: Schema, rows: DataFrame, **options: Any) -> None:
        self.source.write(schema, rows, **options)


class Observed:
    """Tells a listener of every call: operation, collection, seconds, error or None."""

    def __init__(self, source: Any, listener: Callable[[str, str, float, BaseException | None], None]) -> None:
        self.source, self.listener = source, listener

    def _call(self, name: str, schema: Schema, *args: Any, **options: Any) -> Any:
        began = time.monotonic()
        try:
            out = getattr(self.source, name)(schema, *args, **options)
        except BaseException as e:
            self.listener(name, schema.name, time.monotonic() - began, e)
            raise
        self.listener(name, schema.name, time.monotonic() - began, None)
        return out

    def read(self, schema: Schema) -> DataFrame:
        return self._call("read", schema)

    def write(self, schema: Schema, rows: DataFrame, **options: Any) -> None:
        self._call("write", schema, rows, **options)


class Replicated:
    """Reads from the first source that answers; writes to the first, then to the others.

    With ``ack="all"`` a write fails if any mirror fails; with ``"source"`` the mirrors' errors are kept in ``failed``.
    """

    def __init__(self, sources: Sequence[Any], ack: str = "all") -> None:
        self.sources, self.ack, self.failed = list(sources), ack, []

    def read(self, schema: Schema) -> DataFrame:
        for i, s in enumerate(self.sources):
            try:
                return s.read(schema)
            except Exception:
                if i + 1 == len(self.sources):
                    raise
        raise LookupError("no source")

    def write(self, schema: Schema, rows: DataFrame, **options: Any) -> None:
        first, *mirrors = self.sources
        first.write(schema, rows, **options)
        for m in mirrors:
            try:
                m.write(schema, rows, **options)
            except Exception as e:
                if self.ack == "all":
                    raise
                self.failed.append((schema.name, e))
