"""Distributed union-find over edge tables, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``comp``, the smallest node that it is connected to, for every node of the edges ``a``, ``b`` (longs).

    Large stars and small stars alternate: every node hands its larger neighbours, then its smaller ones and itself, to the
    smallest node of its neighbourhood, until nothing moves. The trees become stars in a number of rounds that grows with the
    logarithm of the longest path; each round is two aggregations, combined before the shuffle, and two joins back. Edges may
    be repeated and loop; nulls are left out; no edges give no nodes.
    """
    now = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = given = materialize(now, "edges")
    nodes = materialize(now.select(F.col("u").alias("node")).union(now.select(F.col("v").alias("node"))).distinct(), "nodes")
    now = now.where("u <> v")
    tables = [given, nodes]
    print_of = lambda d: d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = print_of(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(smallest, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(smallest.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u <> v").distinct(), "stars")
        tables.append(now)
        after = print_of(now)
        if after == before:
            break
        before = after
    found = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp"))
    result = materialize(nodes.join(found, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), "components")
    release(*tables)
    return result
