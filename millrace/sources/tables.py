"""Readers and writers of collections: DataFrames in memory, files, databases over JDBC, HTTP services, binary content."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator, Mapping, Sequence
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from millrace.schema import Schema


class Source(Protocol):
    def read(self, schema: Schema) -> DataFrame: ...


class MemorySource:
    """Rows given in Python, or a DataFrame that is already there."""

    def __init__(self, spark: SparkSession, **collections: DataFrame | Sequence[Mapping[str, Any]]) -> None:
        self.spark, self.collections = spark, dict(collections)

    def read(self, schema: Schema) -> DataFrame:
        rows = self.collections.get(schema.name, [])
        if isinstance(rows, DataFrame):
            return schema.read(rows)
        struct = schema.storage_struct()
        return schema.read(self.spark.createDataFrame([tuple(r.get(n) for n in struct.fieldNames()) for r in rows], struct))


class FileSource:
    """A file or folder for each collection: parquet, JSON lines, JSON arrays, CSV or ORC."""

    def __init__(self, spark: SparkSession, root: str, kind: str = "parquet") -> None:
        self.spark, self.root, self.kind = spark, root.rstrip("/"), kind

    def read(self, schema: Schema) -> DataFrame:
        path = f"{self.root}/{schema.name}.{ 'json' if self.kind == 'json-array' else self.kind}"
        reader = self.spark.read
        if self.kind == "parquet":
            return schema.read(reader.parquet(path))
        reader = reader.schema(schema.storage_struct())
        if self.kind in ("json", "json-array"):
            return schema.read(reader.option("multiLine", self.kind == "json-array").json(path))
        return schema.read(reader.option("header", True).csv(path) if self.kind == "csv" else reader.orc(path))

    def write(self, schema: Schema, entities: DataFrame, mode: str = "overwrite") -> None:
        kind = "json" if self.kind == "json-array" else self.kind
        schema.write(entities).write.mode(mode).format(kind).option("header", kind == "csv").save(f"{self.root}/{schema.name}.{kind}")


class JdbcSource:
    """Tables of a database. With a numeric ``column`` and bounds the table is read in parallel ranges; filters are pushed down."""

    def __init__(self, spark: SparkSession, url: str, properties: Mapping[str, str] | None = None, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16) -> None:
        self.spark, self.url, self.properties, self.column, self.bounds, self.partitions = spark, url, dict(properties or {}), column, bounds, partitions

    def read(self, schema: Schema) -> DataFrame:
        if self.column and self.bounds:
            found = self.spark.read.jdbc(self.url, schema.name, column=self.column, lowerBound=self.bounds[0], upperBound=self.bounds[1], numPartitions=self.partitions, properties=self.properties)
        else:
            found = self.spark.read.jdbc(self.url, schema.name, properties=self.properties)
        return schema.read(found)

    def write(self, schema: Schema, entities: DataFrame, mode: str = "append") -> None:
        schema.write(entities).write.jdbc(self.url, schema.name, mode=mode, properties=self.properties)


class _Pages(InputPartition):
    def __init__(self, skip: int, take: int) -> None:
        self.skip, self.take = skip, take


class _HttpReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str], schema: StructType) -> None:
        self.options, self.schema = options, schema

    def partitions(self) -> Sequence[InputPartition]:
        size, total = int(self.options.get("pagesize", 1000)), self.options.get("total")
        return [_Pages(s, size) for s in range(0, int(total), size)] if total else [_Pages(0, -1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        params = json.loads(self.options.get("params", "{}"))
        if partition.take > 0:
            params |= {"skip": partition.skip, "take": partition.take}
        url = self.options["path"] + ("?" + urllib.parse.urlencode(params) if params else "")
        request = urllib.request.Request(url, headers=json.loads(self.options.get("headers", "{}")))
        with urllib.request.urlopen(request, timeout=float(self.options.get("timeout", 30))) as answer:
            rows = json.load(answer)
        for r in rows:
            yield tuple(r.get(n) for n in self.schema.fieldNames())


class HttpJson(DataSource):
    """``spark.read.format("http_json")``: a JSON array from a URL; ``params`` are sent, ``total`` and ``pagesize`` read pages in parallel."""

    @classmethod
    def name(cls) -> str:
        return "http_json"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _HttpReader(self.options, schema)


class HttpSource:
    """Collections of a REST service; filters are sent as parameters and applied again here, as a service may ignore them."""

    def __init__(self, spark: SparkSession, base: str, headers: Mapping[str, str] | None = None, total: int | None = None) -> None:
        spark.dataSource.register(HttpJson)
        self.spark, self.base, self.headers, self.total = spark, base.rstrip("/"), dict(headers or {}), total

    def read(self, schema: Schema, params: Mapping[str, Any] | None = None) -> DataFrame:
        reader = self.spark.read.format("http_json").schema(schema.storage_struct()).option("headers", json.dumps(self.headers)).option("params", json.dumps(dict(params or {})))
        if self.total is not None:
            reader = reader.option("total", str(self.total))
        return schema.read(reader.load(f"{self.base}/{schema.name}"))


def file_references(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The files under a path as content-addressed references: key, size, content_type, checksum, file_name, and the content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kinds = {"json": "application/json", "txt": "text/plain", "csv": "text/csv", "html": "text/html", "png": "image/png", "jpg": "image/jpeg", "pdf": "application/pdf"}
    end = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    kind = F.coalesce(*[F.when(end == k, v) for k, v in kinds.items()], F.lit("application/octet-stream"))
    checksum = F.sha2("content", 256)
    return files.select(checksum.alias("key"), F.col("length").alias("size"), kind.alias("content_type"), checksum.alias("checksum"), name.alias("file_name"), "content")


def encryption(key: str, deterministic: bool = False) -> Any:
    """A transform that stores a string encrypted with AES-GCM, its mark in front; null and values that bear it pass, and what doesn't bear it is read as it is.

    Only the deterministic form, whose nonce follows from the content, can be tested for equality.
    """
    from millrace.schema import Transform

    mark = "enc:v1:"

    def to(c: Any) -> Any:
        args = [c, F.lit(key), F.lit("GCM"), F.lit("DEFAULT")]
        if deterministic:
            args.append(F.unhex(F.substring(F.sha2(F.concat(F.lit(key), c), 256), 1, 24)))
        return F.when(c.startswith(mark), c).otherwise(F.concat(F.lit(mark), F.base64(F.call_function("aes_encrypt", *args))))

    def back(c: Any) -> Any:
        plain = F.call_function("aes_decrypt", F.unbase64(F.substring(c, len(mark) + 1, 1 << 30)), F.lit(key), F.lit("GCM")).cast("string")
        return F.when(c.startswith(mark), plain).otherwise(c)

    return Transform(to, back, "equality" if deterministic else None)
