"""Similarity join of documents on word n-grams by chosen paths.

A document's set holds the hashes of its runs of five words (lower case, split at white space; a shorter text that isn't empty
is one run). Documents are linked at a Jaccard similarity of 0.8. Documents with equal sets are one node with a number of
copies; they are never expanded.

Chosen paths: a set is embedded as ``TOKENS`` min-hash tokens, and a run sends it down every token that a random function of
run, path and token picks. A pair at similarity 0.8 has one picked token in common on average at the first level and 1.6 at
each further one. Sets on the same path share a bucket. Buckets with more than ``SMALL`` sets are split again by further
tokens; small ones are compared within. The common paths of a pair are a branching process: a run brings the pair together
with probability 0.63 at the first level and 0.47 or more at any depth, ``RUNS`` independent runs with 0.9995 or more. What
``LEVELS`` levels have not split (only sets that share nearly all their tokens stay together for so long) is compared in full,
in blocks.

Within a bucket the comparisons go in two steps, so that their number stays near the number of members: each set with the
bucket's set of most copies, exactly; then, after union-find, only the pairs across components, in buckets that are small or
have been split until they are. Candidates pass an estimate from the tokens (0.8 less four deviations) before the texts
themselves are compared. A bucket reports no more candidates than connect the sets that likely pairs connect, fewer than its
members; the sets that candidates connect are then compared exactly, in blocks. Texts are fetched once for the first step, and
for what the second one adds.

The number of links of a node counts all others in its component that are similar enough, exactly, by comparing the
component's sets in blocks of bounded size; a block reports one number per set. This is quadratic in the number of different
texts of a component, as the number of links is: a text is sent to as many places as its component has blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import carried, materialize, release, unpacked
from millrace.llm.graph import components

WORDS, TOKENS, RUNS = 5, 64, 12
#: Sets of a bucket that are compared at once; levels of paths; sets of a block of a component, and their sizes in total.
SMALL, LEVELS, BLOCK, BLOCK_SIZE = 8192, 8, 256, 500_000
#: Tokens picked on average, of those that two sets at the threshold share: at the first level, and at further ones.
PICK, PICK_AGAIN = 1 / (0.8 * TOKENS), 1.6 / (0.8 * TOKENS)
#: Bytes of text that are worked on at once; a longer document is worked on alone.
SLICE = 1 << 20

_ODD = np.random.default_rng(11).integers(0, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(odd: int) -> np.uint64:
    return np.uint64(pow(odd, -1, 1 << 64))


def _slice_sets(words: list[list[str]]) -> list[np.ndarray]:
    data = np.frombuffer((" ".join(" ".join(w) for w in words) + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint64)
    counts = np.array([len(w) for w in words])
    ends = np.flatnonzero(data == 32)
    ends = ends[np.diff(ends, prepend=-1) > 1]  # a text without words leaves a bare space
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
    if len(ends):
        gap = data[starts] == 32
        while gap.any():
            starts = starts + gap
            gap = data[starts] == 32
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(data), _BASE)]))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(data), _inverse(int(_BASE)))]))
    prefix = np.concatenate([[np.uint64(0)], np.cumsum((data + np.uint64(1)) * power[:-1], dtype=np.uint64)])
    word = mixed((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    runs = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        runs = runs * _BASE + word[k : len(word) - WORDS + 1 + k] if len(runs) else runs
    runs = mixed(runs)
    out, at = [], 0
    for n in counts.tolist():
        if n >= WORDS:
            out.append(np.unique(runs[at : at + n - WORDS + 1]))
        elif n:
            whole = np.uint64(n)
            for w in word[at : at + n]:
                whole = mixed(np.array([whole * _BASE + w]))[0]
            out.append(np.array([whole]))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def sets_of(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word runs."""
    out: list[np.ndarray] = []
    part: list[list[str]] = []
    size = 0
    with np.errstate(over="ignore"):
        for t in texts:
            if part and size + len(t) > SLICE:
                out.extend(_slice_sets(part))
                part, size = [], 0
            part.append(t.lower().split())
            size += len(t)
        if part:
            out.extend(_slice_sets(part))
    return out


def tokens_of(items: np.ndarray) -> np.ndarray:
    """The set's min-hash tokens: for each function the least product, its upper half."""
    with np.errstate(over="ignore"):
        least = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
        for a in range(0, len(items), 4096):
            least = np.minimum(least, (items[None, a : a + 4096] * _ODD[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ones, twos, sizes, tokens = [], [], [], []
        with np.errstate(over="ignore"):
            for items in sets_of(batch.column(2).to_pylist()):
                ones.append(int(mixed(items).sum(dtype=np.uint64).astype(np.int64)))
                twos.append(int(mixed(items ^ _BASE).sum(dtype=np.uint64).astype(np.int64)))
                sizes.append(len(items))
                tokens.append(tokens_of(items).tobytes() if len(items) else None)
        columns = [pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(sizes, pa.int32()), pa.array(tokens, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc", "hash", "f1", "f2", "size", "tokens"])


def _choose(seeds: np.ndarray, paths: np.ndarray, tokens: np.ndarray, pick: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows of paths and token vectors: the rows and the new paths of what each row's random function picks."""
    with np.errstate(over="ignore"):
        value = tokens.astype(np.uint64) + (np.arange(TOKENS, dtype=np.uint64) << np.uint64(32))[None, :]
        drawn = mixed(value * _BASE + mixed(paths + seeds)[:, None])
        row, column = np.nonzero(drawn < np.uint64(int(pick * 2**64)))
        return row, mixed(drawn[row, column] + np.uint64(1))


def _first_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        tokens = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, TOKENS)
        for run in range(RUNS):
            row, path = _choose(np.uint64(run), np.full(len(ids), run, np.uint64), tokens, PICK)
            yield pa.RecordBatch.from_arrays([pa.array(path.astype(np.int64)), pa.array(ids[row])], names=["bucket", "id"])


def _next_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(1).to_numpy()
        tokens = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, TOKENS)
        row, path = _choose(np.uint64(RUNS), batch.column(0).to_numpy().astype(np.uint64), tokens, PICK_AGAIN)
        yield pa.RecordBatch.from_arrays([pa.array(path.astype(np.int64)), pa.array(ids[row])], names=["bucket", "id"])


def _least_agreement(threshold: float) -> float:
    return threshold * TOKENS - 4 * (threshold * (1 - threshold) * TOKENS) ** 0.5


def _estimated(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sizes allow the threshold and whose tokens agree as often as it makes likely, less four deviations."""
    own = nodes.select("id", "size", "tokens")
    left = pairs.join(own.select(F.col("id").alias("a"), F.col("size").alias("na"), F.col("tokens").alias("ta")), "a")
    both = left.join(own.select(F.col("id").alias("b"), F.col("size").alias("nb"), F.col("tokens").alias("tb")), "b")
    both = both.where(F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    least = _least_agreement(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ta, tb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, TOKENS) for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((ta == tb).sum(axis=1) >= least))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def _forest(bucket: np.ndarray, comp: np.ndarray, size: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of likely pairs across components that connect all that such pairs connect in each bucket, without circles.

    Rows are sorted by bucket and compared with those 1, 2, ... places on, all buckets at once; pairs that are already
    connected are passed over.
    """
    least = _least_agreement(threshold)
    above = np.arange(len(bucket))
    top = above.copy()
    found: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = int(above[x])
        return x

    for d in range(1, len(bucket)):
        i = np.flatnonzero(bucket[:-d] == bucket[d:])
        if not len(i):
            break
        i = i[(comp[i] != comp[i + d]) & (top[i] != top[i + d]) & (np.minimum(size[i], size[i + d]) >= threshold * np.maximum(size[i], size[i + d]))]
        joined = len(found)
        for part in np.array_split(i, len(i) // 4096 + 1):
            for a in part[(tokens[part] == tokens[part + d]).sum(axis=1) >= least].tolist():
                x, y = root(a), root(a + d)
                if x != y:
                    above[x] = y
                    found.append((a, a + d))
        if len(found) > joined:
            top = above
            while (top != above[top]).any():
                top = above[top]
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _across(members: DataFrame, threshold: float) -> DataFrame:
    """Likely pairs across components within small buckets, ``_forest`` of each. ``members``: bucket, id, comp, size, tokens.

    A bucket that a batch cuts waits for the next one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def compare(rows: pa.Table) -> pa.RecordBatch:
            bucket, ids, comp, size = (rows.column(i).to_numpy() for i in range(4))
            tokens = np.frombuffer(b"".join(rows.column(4).to_pylist()), np.uint32).reshape(-1, TOKENS)
            x, y = _forest(bucket, comp, size, tokens, threshold)
            pairs = [np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])]
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()) for p in pairs], names=["a", "b"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
            bucket = rows.column(0).to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
            held = rows.slice(cut)
            if cut:
                yield compare(rows.slice(0, cut))
        if held is not None and held.num_rows:
            yield compare(held)

    return members.select("bucket", "id", "comp", "size", "tokens").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a bigint, b bigint")


def _halves(large: DataFrame) -> DataFrame:
    """Buckets of any size as pairs of blocks of half a small bucket: every two members meet in one at least."""
    dealt = large.withColumn("nb", F.ceil(F.col("n") / (SMALL // 2)).cast("int")).withColumn("x", F.pmod(F.xxhash64("id"), "nb").cast("int"))
    spread = dealt.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return spread.withColumn("bucket", F.xxhash64("bucket", F.least("x", "y"), F.greatest("x", "y"))).drop("nb", "x", "y")


def _exact(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("xa")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("xb")), "b").select("a", "b", "xa", "xb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for x, y in zip(sets_of(part.column(2).to_pylist()), sets_of(part.column(3).to_pylist()), strict=True):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(shared >= threshold * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def _matrix(left: pa.Table, right: pa.Table, threshold: float) -> np.ndarray:
    """Which sets of two blocks are similar, by products of their incidence matrices, a slice of the words at a time."""
    a, b = sets_of(left["text"].to_pylist()), sets_of(right["text"].to_pylist())
    size_a, size_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    words, place = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row_a, row_b = np.repeat(np.arange(len(a)), size_a), np.repeat(np.arange(len(b)), size_b)
    at_a, at_b = place[: size_a.sum()], place[size_a.sum() :]
    shared = np.zeros((len(a), len(b)), np.float32)
    width = min(8192, len(words))
    for start in range(0, len(words), width):
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        in_a, in_b = (at_a >= start) & (at_a < start + width), (at_b >= start) & (at_b < start + width)
        x[row_a[in_a], at_a[in_a] - start] = 1
        y[row_b[in_b], at_b[in_b] - start] = 1
        shared += x @ y.T
    return shared >= threshold * (size_a[:, None] + size_b[None, :] - shared) - 1e-6


def _block_links(threshold: float):
    """For a cogroup of two blocks of a component: each left set's similar sets on the right, weighted by their copies."""

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            ids = left["id"].to_numpy()
            linked = _matrix(left, right, threshold) & (ids[:, None] != right["id"].to_numpy()[None, :])
            n = linked @ right["copies"].to_numpy()
        return pa.table([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["id", "links"])

    return count


def _block_edges(threshold: float):
    """For a cogroup of two blocks: links enough to join all that are linked, one less than their number at most."""

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            ids, others = left["id"].to_numpy(), right["id"].to_numpy()
            above: dict[int, int] = {}

            def root(x: int) -> int:
                while above.get(x, x) != x:
                    above[x] = above.get(above[x], above[x])
                    x = above[x]
                return x

            row, column = np.nonzero(_matrix(left, right, threshold) & (ids[:, None] != others[None, :]))
            for a, b in zip(ids[row].tolist(), others[column].tolist(), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    above[x] = y
                    found.append((a, b))
        return pa.table([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return join


def _blocks(members: DataFrame, run, out: str, half: bool = False) -> DataFrame:
    """All pairs of blocks of each component, as cogroups. ``members``: comp, n and total (its sets and their sizes), id, text, copies.

    A component of n sets has n / ``BLOCK`` blocks, or as many as its total size takes, to which the sets are dealt by their
    ids; with ``half`` a pair of blocks comes once.
    """
    number = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") / BLOCK_SIZE)).cast("int")
    dealt = members.withColumn("nb", number).withColumn("x", F.pmod("id", "nb").cast("int"))
    left = dealt.select("id", "text", "comp", "x", F.explode(F.sequence(F.col("x") if half else F.lit(0), F.col("nb") - 1)).alias("y"))
    renewed = dealt.select(*[F.col(c).alias(c) for c in ("id", "copies", "text", "comp", "nb", "x")])  # columns of its own
    right = renewed.select("id", "copies", "text", "comp", F.col("x").alias("y"), F.explode(F.sequence(F.lit(0), F.col("x") if half else F.col("nb") - 1)).alias("x"))
    return left.groupBy("comp", "x", "y").cogroup(right.groupBy("comp", "x", "y")).applyInArrow(run, out)


def _classes(docs: DataFrame, key: str, text: str, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows' sketches with the nodes' ids; the nodes with copies, least doc and component; texts of all linked nodes."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("doc"), F.xxhash64(whole).alias("hash"), whole.alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    sketched = rows.mapInArrow(_sketch, f"doc {kind}, hash bigint, f1 bigint, f2 bigint, size int, tokens binary")
    sketched = materialize(sketched.withColumn("id", F.when(F.col("size") > 0, F.xxhash64("f1", "f2", "size"))), "sketches")
    nodes = sketched.where("size > 0").groupBy("id").agg(F.first("size").alias("size"), F.first("tokens").alias("tokens"), F.count("*").alias("copies"), F.min("doc").alias("doc"))
    nodes = materialize(nodes, "nodes")
    paths = materialize(nodes.select("id", "tokens").mapInArrow(_first_paths, "bucket bigint, id bigint"), "paths")
    shared = _shared(paths)
    weighed = shared.join(nodes.select("id", "copies"), "id")
    pivots = weighed.groupBy("bucket").agg(F.max(F.struct("copies", "id")).alias("top")).select("bucket", F.col("top.id").alias("pivot"))
    members = materialize(shared.join(pivots, "bucket").where("id <> pivot"), "members")  # the pivot's own pairs are done with the star
    star = members.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    likely = materialize(_estimated(star, nodes, threshold), "likely")
    texts = _texts(_ends(likely), sketched, rows)
    links = materialize(_exact(likely, texts, threshold), "links")
    united = components(links)
    comps = united.select(F.col("node").alias("id"), "comp")
    done = [paths, shared, members, likely, links, united]
    found = []
    for level in range(LEVELS):
        labelled = members.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        unsettled = labelled.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("bucket")
        rest = labelled.join(unsettled, "bucket", "left_semi").join(nodes.select("id", "size", "tokens"), "id")
        rest = materialize(rest.select("bucket", "id", "n", "comp", "size", "tokens"), "unsettled")
        done.append(rest)
        large = rest.where(F.col("n") > SMALL)
        last = level == LEVELS - 1
        small = rest.where(F.col("n") <= SMALL)
        found.append(materialize(_across(small.unionByName(_halves(large)) if last else small, threshold).distinct(), "candidates"))
        if last or large.isEmpty():
            break
        paths = materialize(large.select("bucket", "id", "tokens").mapInArrow(_next_paths, "bucket bigint, id bigint").distinct(), "paths")
        members = _shared(paths)
        done += [paths, members]
    more = found[0]
    for x in found[1:]:
        more = more.union(x)
    # none is left out for having been refuted above: it may hold together what others connect
    more = materialize(more.distinct(), "candidates")
    done += [*found, more]
    if not more.isEmpty():
        added = _ends(more).join(texts.select("id"), "id", "left_anti")
        texts = texts.union(_texts(added, sketched, rows))
        # sets that candidate pairs connect are compared in blocks: only links come out, a few for each set
        near = components(more)
        sized = near.select(F.col("node").alias("id"), "comp").join(nodes.select("id", "size"), "id")
        sized = sized.join(sized.groupBy("comp").agg(F.count("*").alias("n"), F.sum("size").alias("total")), "comp")
        members = sized.select("id", "comp", "n", "total").join(texts, "id").withColumn("copies", F.lit(1))
        others = materialize(_blocks(members, _block_edges(threshold), "a bigint, b bigint", half=True), "links")
        united = components(links.union(others))
        comps = united.select(F.col("node").alias("id"), "comp")
        done += [others, united, near]
    joined = nodes.select("id", "copies", "doc", "size").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    classes = materialize(joined, "classes")
    release(*done, nodes)
    return sketched, classes, texts


def _shared(paths: DataFrame) -> DataFrame:
    """``bucket``, ``id`` and the bucket's number of sets ``n``, of the buckets with several sets."""
    several = paths.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n")).where("least < most")
    return materialize(paths.join(several.select("bucket", "n"), "bucket").select("bucket", "id", "n"), "members")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()


def similarity_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """``key``, ``class_id`` (the least ``key`` of the component) and ``n_links`` (linked documents, copies among them) for each row.

    Null texts count as empty; empty texts have no set and are linked with nothing, each row a class of its own with its own
    ``key``. A row that is repeated is a copy of itself. Null keys are allowed: a class of null keys only has a null id. An
    empty table gives an empty result. Other columns are left out.
    """
    sketched, joined, texts = _classes(docs, key, text, threshold)
    named = joined.groupBy("comp").agg(F.min("doc").alias("class_id"), F.count("*").alias("n"), F.sum("size").alias("total"))
    result = joined.join(named, "comp")
    linked = result.where("n > 1").join(texts, "id").select("comp", "n", "total", "id", "text", F.col("copies").cast("bigint").alias("copies"))
    blocks = _blocks(linked, _block_links(threshold), "id bigint, links bigint")
    result = result.join(blocks.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    out = sketched.select("doc", "id").join(result.select("id", "class_id", "n_links"), "id", "left")
    class_id = F.when(F.col("id").isNull(), F.col("doc")).otherwise(F.col("class_id"))
    return out.select(F.col("doc").alias(key), class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that are first in their class, in order of ``key`` and text hash; all columns as they are.

    Rows with equal key and text stay once. Rows without words stay all; for nulls see ``similarity_classes``.
    """
    sketched, joined, _ = _classes(docs, key, text, threshold)
    least = sketched.where("id is not null").groupBy("id").agg(F.min(F.struct("doc", "hash")).alias("at"))
    first = least.join(joined.select("id", "comp"), "id").groupBy("comp").agg(F.min("at").alias("at")).select(F.col("at.doc").alias("doc"), F.col("at.hash").alias("hash"))
    empty = sketched.where("id is null").select("doc", "hash").distinct()
    stay = first.withColumn("once", F.lit(True)).union(empty.withColumn("once", F.lit(False)))
    # the caller's columns go along as one, so that no name of theirs can clash with one of these
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("doc"), F.xxhash64(whole).alias("hash"), carried(docs.columns).alias("row"))
    kept = rows.join(stay, rows["doc"].eqNullSafe(stay["doc"]) & (rows["hash"] == stay["hash"])).select(rows["doc"], rows["hash"], "row", "once")
    once = kept.where("once").dropDuplicates(["doc", "hash"])
    return once.union(kept.where("not once")).select(*unpacked("row", docs.columns))


def _texts(ids: DataFrame, sketched: DataFrame, rows: DataFrame) -> DataFrame:
    """``id`` and ``text``, one of the texts with that set, for the given ids."""
    wanted = sketched.join(ids.distinct(), "id", "left_semi").groupBy("id").agg(F.min("hash").alias("hash"))
    found = rows.select("hash", "text").join(wanted, "hash")
    return materialize(found.groupBy("id").agg(F.first("text").alias("text")), "texts")
