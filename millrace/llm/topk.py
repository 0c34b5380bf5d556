"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, in blocks: queries and candidates are each dealt to groups of bounded size, and
each pair of groups is one cogroup, so no task sees an unbounded set and no pair of rows is ever a row of a table. A round
builds, for each query, a histogram of its scores between bounds that hold its k-th best score; summed over the groups of
candidates, the histogram shows the bin of that score, which becomes the bounds of the next round, until a bin is one integer
wide. A last pass takes the scores above that value, and as many of those equal to it as are missing, smaller ids first.

A group of candidates reports only its bins down to its own k-th best score: the k-th best of all can't be lower. So each
group reports at most k bins a query however many candidates are equal, and at most k ties.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialize

#: Bins of a round's histogram; rows in a group of queries and of candidates.
BINS, QUERY_ROWS, CANDIDATE_ROWS = 1024, 1024, 4096


def quantized(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """``id`` and ``v``, the floor of ``scale`` times each component. Rows without an id or with null or non-finite parts go."""
    v = F.col(f"`{vector}`").cast("array<double>")
    sound = F.col(f"`{key}`").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(sound).select(F.col(f"`{key}`").cast("bigint").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows; shorter ones are filled up with zeros."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    sizes = np.diff(flat.offsets.to_numpy())
    values = flat.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out


def _scores(left: pa.Table, right: pa.Table, width: int, part: int = 256):
    """Slices of the queries with their scores against all candidates of the group; a query's own row scores minus infinity."""
    queries, candidates = _matrix(left["v"], width), _matrix(right["v"], width).T.copy()
    own, ids = left["id"].to_numpy(), right["id"].to_numpy()
    for a in range(0, len(queries), part):
        s = queries[a : a + part] @ candidates
        s[own[a : a + part, None] == ids[None, :]] = -np.inf
        yield a, s


def _counter(width: int, step: int, span: int):
    """For a cogroup: each query's bins down to its own k-th best score there, with the numbers of scores in them."""

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["q", "bin", "n"]
        kinds = [pa.int64(), pa.int64(), pa.int64()]
        parts: list[list[np.ndarray]] = []
        if left.num_rows and right.num_rows:
            q, low, need = (left[c].to_numpy() for c in ("q", "low", "need"))
            for a, s in _scores(left, right, width):
                lo = low[a : a + len(s), None]
                inside = (s >= lo) & (s < lo + span)
                bin_of = np.where(inside, np.floor_divide(np.where(inside, s, lo) - lo, step), -1).astype(np.int64)
                most = int(min(need.max(), s.shape[1]))
                top = np.sort(np.partition(bin_of, s.shape[1] - most, axis=1)[:, -most:], axis=1)[:, ::-1]
                last = top[np.arange(len(s)), np.minimum(need[a : a + len(s)], most) - 1]
                row, column = np.nonzero((bin_of >= np.maximum(last, 0)[:, None]) & inside)
                cell, n = np.unique(row * (BINS + 1) + bin_of[row, column], return_counts=True)
                parts.append([q[a + cell // (BINS + 1)], cell % (BINS + 1), n])
        arrays = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(x, t) for x, t in zip(arrays, kinds, strict=True)], names=names)

    return count


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """Each query's ``k`` best candidates: query_id, rank (from 1), vec_id, score (the integer inner product).

    ``queries`` are some of the rows of ``vectors``, or other rows with the same columns; a candidate with a query's id is its
    own row and no result. Vectors that are null or empty, hold null or non-finite components or have no id take no part.
    Shorter vectors count as filled up with zeros. Ties go to the smaller id. Repeated candidates are results each; a query
    that is repeated as a whole is answered once. With fewer than ``k`` candidates a query gets all of them; an empty table
    gives an empty result. Scores are exact while the sums of the absolute products stay under 2^53.
    """
    spark = vectors.sparkSession
    candidates = materialize(quantized(vectors, key, vector, scale), "candidates")
    asked = materialize(quantized(queries, key, vector, scale).distinct().withColumn("q", F.xxhash64("id", "v")), "queries")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sizes = [d.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first() for d in (candidates, asked)]
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not sizes[0][0] or not sizes[1][0]:
        return spark.createDataFrame([], schema)
    width, bound = max(sizes[0][1], sizes[1][1]), math.floor(sizes[0][2] * sizes[1][2]) + 1
    n_c, n_q = -(-sizes[0][0] // CANDIDATE_ROWS), -(-sizes[1][0] // QUERY_ROWS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = candidates.withColumn("cg", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_c)).cast("int")).withColumn("qg", every(n_q))
    grouped = asked.withColumn("qg", F.pmod("q", F.lit(n_q)).cast("int"))

    def meet(state: DataFrame, run, out: str) -> DataFrame:
        left = state.withColumn("cg", every(n_c))
        return left.groupBy("qg", "cg").cogroup(right.groupBy("qg", "cg")).applyInArrow(run, out)

    # per query: bounds of the k-th best score, and how many results are still to find from the bounds' top down
    state = grouped.withColumns({"low": F.lit(-bound).cast("bigint"), "need": F.lit(k)})
    bins = 2 * bound + 1
    while bins > 0:
        step = -(-bins // BINS)

        sums = meet(state, _counter(width, step, bins), "q bigint, bin bigint, n bigint").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.desc("bin"))
        reached = sums.withColumn("upto", F.sum("n").over(down)).join(state.select("q", "low", "need"), "q")
        # the bin in which the k-th best lies; for a query with fewer candidates none is reached: it takes all there are
        hit = reached.where("upto >= need and upto - n < need").select("q", (F.col("low") + F.col("bin") * step).alias("low1"), (F.col("need") - (F.col("upto") - F.col("n"))).cast("int").alias("need1"))
        moved = state.join(hit, "q", "left").withColumns({"low": F.coalesce("low1", "low"), "need": F.coalesce("need1", "need")})
        state = materialize(moved.select("id", "v", "q", "qg", "low", "need"), "bounds")
        if step == 1:
            break
        bins = step

    def take(left: pa.Table, right: pa.Table) -> pa.Table:
        parts: list[list[np.ndarray]] = []
        if left.num_rows and right.num_rows:
            q, own, low, need, ids = left["q"].to_numpy(), left["id"].to_numpy(), left["low"].to_numpy(), left["need"].to_numpy(), right["id"].to_numpy()
            for a, s in _scores(left, right, width):
                lo, short = low[a : a + len(s), None], need[a : a + len(s)]
                row, column = np.nonzero(s >= lo)
                tied = s[row, column] == lo[row, 0]
                order = np.lexsort((ids[column], ~tied, row))
                row, column, tied = row[order], column[order], tied[order]
                first = np.searchsorted(row, row)  # the ties of a row come first, by id
                keep = ~tied | (np.arange(len(row)) - first < short[row])
                row, column = row[keep], column[keep]
                parts.append([q[a + row], own[a + row], ids[column], s[row, column].astype(np.int64)])
        arrays = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(x, pa.int64()) for x in arrays], names=["q", "query_id", "vec_id", "score"])

    found = meet(state, take, "q bigint, query_id bigint, vec_id bigint, score bigint")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q", "query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
