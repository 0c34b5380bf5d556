"""Verdicts on urls by a sort-merge range join with prefix rules.

The canonical key of a host is its labels in reverse order, each ended by a dot: ``en.example.org`` is ``org.example.en.``.
The keys of a host and all its subdomains then form one interval, from the host's key up to the same string with a last
character above all others. Rules and urls are dealt to ranges of keys, sorted, and swept once: a stack holds the rules' hosts
whose intervals the sweep is in, which are nested. Each host on the stack carries its rules' paths, sorted, each with a
pointer to the longest other path that is a prefix of it, so that a lookup is one bisection and a walk up that chain.

Of the rules that fit, the one with the longest ``host + path`` wins; among equally long ones the longer host, then the
smaller string; ``block`` wins over ``allow`` where the same rule is given with both verdicts.

Ranges: their boundaries are quantiles of a bounded sample of the urls' keys (they decide on balance only; every url is
swept). A key that fills several ranges is spread over them by a hash of the row, so a host with a third of all rows is not
one task's. A rule is sent to every range that its interval meets: to the ranges it starts in or covers, so a range receives
the rules that start in it and those whose hosts contain its first key, at most one host for each label.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Above every label's characters in a key.
_LAST = "\U0010ffff"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; empty for null or no ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


class _Host:
    """The rules of one host: paths in order, verdicts, and for each path the longest other path that is its prefix."""

    def __init__(self, key: str, host: str) -> None:
        self.key, self.host = key, host
        self.paths: list[str] = []
        self.verdicts: list[str] = []
        self.parents: list[int] = []

    def add(self, path: str, verdict: str) -> None:
        if self.paths and self.paths[-1] == path:
            self.verdicts[-1] = min(self.verdicts[-1], verdict, key=lambda v: v != "block")
            return
        above = len(self.paths) - 1
        while above >= 0 and not path.startswith(self.paths[above]):
            above = self.parents[above]
        self.paths.append(path)
        self.verdicts.append(verdict)
        self.parents.append(above)

    def find(self, path: str) -> int:
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.parents[at]
        return at


def apply_rules(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", sample: int = 4_000) -> DataFrame:
    """All columns of ``urls``, plus ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict``; a null in any of these counts as empty, and a rule with an empty host
    fits no url. Null urls and those without ``://`` have an empty host and path, which no rule fits. Repeated urls and rows
    are judged each; an empty table gives an empty result. Columns of ``urls`` with the names of the four new ones are
    replaced. ``sample`` bounds the rows that set the ranges' boundaries.
    """
    new = ("host", "path", "rule", "verdict")
    kept = [c for c in urls.columns if c not in new]
    parts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = urls.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host_of(F.col(f"`{url}`").cast("string")).alias("host"), path_of(F.col(f"`{url}`").cast("string")).alias("path"))
    keyed = keyed.withColumn("key", host_key(F.col("host")))
    some = [r.key for r in keyed.select("key", F.xxhash64("host", "path").alias("h")).orderBy("h").limit(sample).select("key").collect()]
    some.sort()
    bounds = [some[i * len(some) // parts] for i in range(1, parts)] if some else []

    def deal_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("key")).to_pylist()
            salts = batch.column(batch.schema.get_field_index("salt")).to_pylist()
            out = []
            for k, s in zip(keys, salts, strict=True):
                low, high = bisect_left(bounds, k), bisect_right(bounds, k)
                out.append(low + s % (high - low + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.int32())], names=[*batch.schema.names[:-1], "part"])

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, k in enumerate(batch.column(batch.schema.get_field_index("key")).to_pylist()):
                met = range(bisect_left(bounds, k), bisect_right(bounds, k + _LAST) + 1)
                rows.extend([i] * len(met))
                out.extend(met)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(out, pa.int32())], names=[*batch.schema.names, "part"])

    points = keyed.select("key", "host", "path", F.lit(None).cast("string").alias("said"), "row", F.pmod(F.xxhash64("row"), F.lit(1 << 20)).alias("salt"))
    dealt = points.mapInArrow(deal_urls, points.drop("salt").withColumn("part", F.lit(0)).schema)
    given = rules.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("host", "path", "verdict")]).where("host <> ''")
    low = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")  # as the urls' hosts: A-Z only
    given = given.select(host_key(low).alias("key"), low.alias("host"), "path", F.col("verdict").alias("said"))
    sent = given.mapInArrow(deal_rules, given.withColumn("part", F.lit(0)).schema).withColumn("row", F.lit(None).cast(points.schema["row"].dataType))
    events = dealt.unionByName(sent)
    # with equal keys the rules come first, in the order of their paths
    ordered = events.repartition(parts, "part").sortWithinPartitions("part", "key", F.col("said").isNull(), "path")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[_Host] = []
        part = None
        for batch in batches:
            names = batch.schema.names
            columns = [batch.column(names.index(c)).to_pylist() for c in ("part", "key", "host", "path", "said")]
            taken, fits, verdicts = [], [], []
            for i, (p, key, host, path, said) in enumerate(zip(*columns, strict=True)):
                if p != part:
                    part = p
                    stack.clear()
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if said is not None:
                    if not stack or stack[-1].key != key:
                        stack.append(_Host(key, host))
                    stack[-1].add(path, said)
                    continue
                best, verdict = None, default
                for h in stack:
                    at = h.find(path)
                    if at >= 0:
                        rank = (len(h.host) + len(h.paths[at]), len(h.host))
                        if best is None or rank >= best[0]:
                            best, verdict = (rank, h.host + h.paths[at]), h.verdicts[at]
                taken.append(i)
                fits.append(best and best[1])
                verdicts.append(verdict)
            rows = batch.take(pa.array(taken, pa.int64()))
            columns = [rows.column(names.index(c)) for c in ("row", "host", "path")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fits, pa.string()), pa.array(verdicts, pa.string())], names=["row", "host", "path", "rule", "verdict"])

    schema = points.select("row", "host", "path", F.col("said").alias("rule"), F.lit("").alias("verdict")).schema
    swept = ordered.mapInArrow(sweep, schema)
    return swept.select(*[F.col("row").getField(c).alias(c) for c in kept], *new)
