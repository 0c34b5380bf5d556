"""Fuzzy deduplication of lines by MinHash, with DataFrame functions only.

A line is compared as it stands, without outer blanks; its set holds the character shingles of ``SHINGLE`` code points at every
position (a shorter line is one shingle). Lines are alike at a Jaccard similarity of 0.8 of these sets. Equal lines share a key
and are one node.

1. Lines are not written: each use splits the texts again. A line is encoded with four bytes a code point, so that the shingle at
   any position is a slice of bytes, found without a walk from the line's start. Shingles are exploded, ``STEP`` of them a row,
   hashed and aggregated to minima under ``BANDS * ROWS`` functions, per line key: equal lines combine before the shuffle, and no
   text is shuffled. The
   functions are the combinations of one, two or three rotations of the 64-bit hash by multiples of 16 bits; their leading bits
   are different sums (modulo 2) of the hash's four independent words, so any two are independent.
2. Banding: lines meet in a bucket for each band of ``ROWS`` minima. Two lines at similarity 0.8 share one of the seven bands of
   two with probability 0.999.
3. A bitmap of ``64 * WORDS`` bits for each line in a bucket: every element of its set flips one bit. Two lines' bitmaps differ
   in no more bits than their sets differ in elements, so a pair whose bitmaps differ in more than the threshold allows to the
   sets is not alike: this passes over pairs without any text and loses none. Sets of some thousand elements and more fill the
   bitmap, and their pairs are left to the next step.
4. Verification: exact Jaccard of the sets of pairs that the bitmaps leave, made of the lines pair by pair. First comes each line
   in a bucket with the bucket's most frequent line, which is linear however large the bucket and links the copies of a line to
   the line itself. Pairs that union-find already joins need no check. Buckets of more than ``BLOCK`` lines then compare all
   their lines with ``PIVOTS`` of them, spread over the bucket by a hash, which joins most of what is alike to anything by
   way of them. The other pairs of a bucket, those across its components, are last compared by their bitmaps, in blocks that
   are spread over tasks. A pair is handed on in one bucket only, the least that its lines share.
5. Union-find gives the components. Of each component the first line in order of document id, text hash and line number stays.

Blank lines are never dropped. A line key has 64 bits; among n different lines about n^2 / 2^65 pairs collide.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import carried, materialize, release, unpacked
from millrace.llm.graph import components

SHINGLE, BANDS, ROWS, BLANKS = 12, 7, 2, " \t\r\u00a0"
#: Lines of a bucket whose bitmaps are compared at once, all with all; lines that a larger bucket compares first; 64-bit words of a bitmap.
BLOCK, PIVOTS, WORDS = 1024, 256, 16
#: Bytes of a code point in ``UNITS``; bits of a word of the table by which lines in no bucket are passed over, and its words at most.
WIDTH, UNITS, WORD, TABLE = 4, "UTF-32", 64, 1 << 18
#: Shingles that are exploded as one row and combined before they reach an aggregate's buffer.
STEP = 2


def folded(line: Column) -> Column:
    """The line without outer blanks; few lines have any, and looking is cheaper than trimming."""
    outer = reduce(lambda a, b: a | b, [x for c in BLANKS for x in (line.startswith(c), line.endswith(c))])
    return F.when(outer, F.trim(line, F.lit(BLANKS))).otherwise(line)


def _starts(units: Column) -> Column:
    """The shingles' places in bytes, from 1; a shorter line has one shingle."""
    return F.sequence(F.lit(1), F.greatest(F.length(units) - (SHINGLE * WIDTH - 1), F.lit(1)), F.lit(WIDTH))


def _hash(units: Column, start: Column) -> Column:
    return F.xxhash64(F.substring(units, start, F.lit(SHINGLE * WIDTH)))


def shingles(*lines: Column) -> Column:
    """The hashes of the lines' shingles, one for each place."""
    # within a lambda, so that a line is encoded once
    units = F.array(*[F.encode(line, UNITS) for line in lines])
    return F.flatten(F.transform(units, lambda units: F.transform(_starts(units), lambda i: _hash(units, i))))


def _with_set(table: DataFrame, *lines: str) -> DataFrame:
    """The columns but the lines, and ``set``, the hashes of all their shingles, each once."""
    # lambdas are not compiled; a generator between them and the rest lets the rest be compiled
    each = F.explode(F.array(shingles(*[F.col(line) for line in lines]))).alias("each")
    rows = table.select(*[c for c in table.columns if c not in lines], each)
    return rows.withColumn("each", F.array_distinct("each")).withColumnRenamed("each", "set")


def document_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc``, ``hash`` (of the text), ``pos``, ``line`` and its key ``lk`` of every line; a blank line's key is its own."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("doc"), F.xxhash64(whole).alias("hash"), F.posexplode(F.split(whole, "\n")).alias("pos", "raw"))
    rows = rows.select("doc", "hash", "pos", folded(F.col("raw")).alias("line"))
    return rows.withColumn("lk", F.when(F.col("line") == "", F.xxhash64("doc", "hash", "pos")).otherwise(F.xxhash64("line")))


def _lower(a: str, b: str) -> Column:
    """The lesser of two columns that are never null; ``least`` compiles to jumps that depend on the values, this to a move."""
    return F.expr(f"if({a} < {b}, {a}, {b})")


def _signatures(lines: DataFrame) -> DataFrame:
    """A row per line key: the minima of its shingles' hashes, and its shingles over all occurrences as a weight."""
    units = F.encode("line", UNITS)
    encoded = lines.select("lk", units.alias("units")).withColumn("last", F.greatest(F.length("units") - (SHINGLE * WIDTH - 1), F.lit(1)))
    rows = encoded.select("lk", "units", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(STEP * WIDTH))).alias("i"))
    k = range(STEP)
    # a row at the line's end repeats its last shingle, which no minimum minds; the weight counts each shingle once
    places = [F.expr(f"if(i + {j * WIDTH} < last, i + {j * WIDTH}, last)") if j else F.col("i") for j in k]
    n = F.expr(f"if(last - i < {STEP * WIDTH}, (last - i) div {WIDTH} + 1, {STEP}L)")
    each = rows.select("lk", n.alias("n"), *[_hash(F.col("units"), place).alias(f"r0_{j}") for j, place in enumerate(places)])
    turned = [F.shiftleft(f"r0_{j}", b).bitwiseOR(F.shiftrightunsigned(f"r0_{j}", 64 - b)).alias(f"r{b // 16}_{j}") for b in (16, 32, 48) for j in k]
    each = each.select("lk", "n", *[f"r0_{j}" for j in k], *turned)
    choices = list(enumerate([c for n in (1, 2, 3) for c in combinations(["r0", "r1", "r2", "r3"], n)][: BANDS * ROWS]))
    each = each.select("lk", "n", *[reduce(lambda a, b: a.bitwiseXOR(b), [F.col(f"{r}_{j}") for r in c]).alias(f"m{i}_{j}") for i, c in choices for j in k])
    left = STEP
    while left > 1:  # the row's values in rounds, each against one of the other half
        half = (left + 1) // 2
        each = each.select("lk", "n", *[(_lower(f"m{i}_{j}", f"m{i}_{j + half}") if j + half < left else F.col(f"m{i}_{j}")).alias(f"m{i}_{j}") for i, _ in choices for j in range(half)])
        left = half
    return each.groupBy("lk").agg(F.sum("n").alias("weight"), *[F.min(f"m{i}_0").alias(f"m{i}") for i, _ in choices])


def _members(signatures: DataFrame) -> DataFrame:
    """``bucket``, ``lk``, and the bucket's ``pivot``, its most frequent line, for the lines that share a band with another line."""
    bands = [F.xxhash64(F.lit(b), *[F.col(f"m{b * ROWS + r}") for r in range(ROWS)]) for b in range(BANDS)]
    buckets = signatures.select("lk", "weight", F.explode(F.array(*bands)).alias("bucket"))
    whole = Window.partitionBy("bucket")
    # most buckets hold one line, so the pivot is sought in the others only
    shared = buckets.withColumn("n", F.count("*").over(whole)).where("n > 1")
    return shared.select("bucket", "lk", F.max(F.struct("weight", "lk")).over(whole)["lk"].alias("pivot"))


def _texts(lines: DataFrame, placed: DataFrame) -> DataFrame:
    """``lk`` and ``line`` of the lines in buckets.

    A table of bits for the keys' low bits, of ``TABLE`` words at most however many lines there are, passes over most lines in no
    bucket before their texts are shuffled; the join does the rest. It is no semi-join, which Spark would move below the table.
    """
    place = F.col("lk").bitwiseAND(F.lit(TABLE * WORD - 1))
    word, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(WORD - 1)).cast("int")
    wanted = placed.select("lk").distinct()
    words = wanted.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    passed = lines.select("lk", "line", word.alias("word"), bit.alias("bit")).join(F.broadcast(words), "word").where(F.getbit("bits", "bit") == 1)
    return passed.select("lk", "line").join(wanted, "lk").groupBy("lk").agg(F.first("line").alias("line"))


def _bitmaps(texts: DataFrame) -> DataFrame:
    """``lk``, the ``size`` of its set and the set's bitmap, ``w0`` and on."""
    rows = _with_set(texts, "line").withColumn("size", F.size("set"))
    rows = rows.select("lk", "set", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(2 * STEP))).alias("i"))
    k = range(2 * STEP)
    # bits that the minima of the bands do not order by; beyond the set's end, a place in no word
    bits = [F.shiftrightunsigned(F.xxhash64(F.get("set", F.col("i") + j)), 7).bitwiseAND(F.lit(64 * WORDS - 1)).cast("int") for j in k]
    places = [F.when(F.col("i") + j < F.col("size"), bit).otherwise(F.lit(-1)).alias(f"place{j}") for j, bit in enumerate(bits)]
    rows = rows.select("lk", F.expr(f"if(size - i < {2 * STEP}, size - i, {2 * STEP})").alias("n"), *places)
    flips = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(f"place{j}").bitwiseAND(F.lit(63))).alias(f"bit{j}") for j in k]
    rows = rows.select("lk", "n", *[F.shiftright(f"place{j}", 6).alias(f"word{j}") for j in k], *flips)
    own = [" ^ ".join(f"if(word{j} = {w}, bit{j}, 0L)" for j in k) for w in range(WORDS)]
    return rows.groupBy("lk").agg(F.sum("n").cast("int").alias("size"), *[F.expr(f"bit_xor({x})").alias(f"w{w}") for w, x in enumerate(own)])


def _side(table: DataFrame, s: str) -> DataFrame:
    """The columns of a table of bitmaps, named for one side of a pair."""
    return table.select(*[F.col(c).alias(f"{s}_{c}") for c in table.columns])


def _possible(threshold: float) -> Column:
    """Whether sizes and bitmaps of the sides ``a`` and ``b`` allow the threshold; it does not pass over a pair that reaches it."""
    a, b = F.col("a_size"), F.col("b_size")
    fits = F.least(a, b) >= threshold * F.greatest(a, b)
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a_w{w}").bitwiseXOR(F.col(f"b_w{w}"))) for w in range(WORDS)])
    return fits & (differ * (1 + threshold) <= (1 - threshold) * (a + b) + 1e-6)


def _exact(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs that are alike; ``sizes`` is the sum of the sizes of a pair's sets, so that the size of their union decides."""
    near = pairs.join(texts.select(F.col("lk").alias("a"), F.col("line").alias("la")), "a").join(texts.select(F.col("lk").alias("b"), F.col("line").alias("lb")), "b")
    return _with_set(near, "la", "lb").where(F.size("set") * (1 + threshold) <= F.col("sizes") + 1e-9).select("a", "b")


def _met(threshold: float) -> Column:
    """Rows of one bucket and two components whose bitmaps allow the threshold, in the least of the buckets that they share."""
    apart = (F.col("a_bucket") == F.col("b_bucket")) & (F.col("a_comp") != F.col("b_comp"))
    return apart & _possible(threshold) & (F.array_min(F.array_intersect("a_keys", "b_keys")) == F.col("a_bucket"))


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("a_lk", "b_lk").alias("a"), F.greatest("a_lk", "b_lk").alias("b"), (F.col("a_size") + F.col("b_size")).alias("sizes"))


def _by_pivots(rest: DataFrame, threshold: float) -> DataFrame:
    """Pairs of a large bucket's lines and its pivots that their bitmaps allow; ``rest`` as for ``_across``.

    The pivots are the lines of the least hashes, the same ones in all buckets that share them as far as these go.
    """
    large = rest.where(F.col("n") > BLOCK)
    # a bound that about PIVOTS of the bucket's hashes lie under
    order = F.shiftrightunsigned(F.xxhash64("lk", F.lit(1)), 32)
    pivots = large.where(order * F.col("n") < F.lit(PIVOTS << 32))
    return _pairs(_side(pivots, "a").join(_side(large, "b"), _met(threshold))).distinct()


def _across(rest: DataFrame, threshold: float) -> DataFrame:
    """Pairs across components of a bucket that their bitmaps allow. ``rest``: bucket, n (its rows here), lk, comp, keys (its buckets), size, bitmap.

    A bucket's rows are dealt to blocks of about ``BLOCK`` lines by their keys, and pairs of blocks are joined, so that the
    comparisons within a large bucket are spread over many tasks. Both sides are one and the same exchange.
    """
    dealt = rest.withColumn("nb", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("x", F.pmod(F.xxhash64("lk"), "nb").cast("int"))
    spread = dealt.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    spread = spread.withColumn("low", F.least("x", "y")).withColumn("high", F.greatest("x", "y")).drop("n", "nb", "y")
    # as columns that can't be null, which the comparisons needn't ask for
    spread = spread.withColumns({c: F.coalesce(c, F.lit(0).cast(kind)) for c, kind in spread.dtypes if c in ("lk", "comp", "size", "x", *(f"w{w}" for w in range(WORDS)))})
    block = (F.col("a_low") == F.col("b_low")) & (F.col("a_high") == F.col("b_high"))
    # blocks of one number meet in full, others in one direction
    once = (F.col("a_x") < F.col("b_x")) | ((F.col("a_x") == F.col("b_x")) & (F.col("a_low") == F.col("a_high")) & (F.col("a_lk") < F.col("b_lk")))
    return _pairs(_side(spread, "a").join(_side(spread, "b"), block & once & _met(threshold)))


def _mixed(placed: DataFrame, comps: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The lines of buckets with several components, but the buckets' most frequent lines, which have been compared with all."""
    labelled = placed.where("lk <> pivot").drop("pivot").join(comps.withColumnRenamed("node", "lk"), "lk", "left").withColumn("comp", F.coalesce("comp", "lk"))
    mixed = labelled.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("n")).where("c0 < c1").select("bucket", "n")
    return labelled.join(mixed, "bucket").join(placed.groupBy("lk").agg(F.collect_list("bucket").alias("keys")), "lk").join(bitmaps, "lk")


def line_classes(lines: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``node`` (a line key) and ``comp`` of the lines that are alike to another, different line; ``lines`` as of ``document_lines``."""
    lines = lines.where("line <> ''")
    placed = materialize(_members(_signatures(lines)), "line-buckets")
    texts = materialize(_texts(lines, placed), "line-texts")
    bitmaps = materialize(_bitmaps(texts), "line-bitmaps")
    star = placed.where("lk <> pivot").select("pivot", "lk").distinct()
    star = star.join(_side(bitmaps, "a"), F.col("pivot") == F.col("a_lk")).join(_side(bitmaps, "b"), F.col("lk") == F.col("b_lk"))
    star = _pairs(star.where(_possible(threshold)))
    edges = materialize(_exact(star, texts, threshold), "line-links")
    comps = components(edges)
    tables = [placed, texts, bitmaps, edges, comps]

    def joined(pairs: DataFrame) -> None:
        """Check the pairs and join the components that they link."""
        nonlocal edges, comps
        more = materialize(_exact(pairs, texts, threshold), "line-links")
        tables.append(more)
        if not more.isEmpty():
            edges = edges.union(more)
            comps = components(edges)
            tables.append(comps)

    rest = materialize(_mixed(placed, comps, bitmaps), "line-rest")
    if not rest.where(F.col("n") > BLOCK).isEmpty():
        joined(_by_pivots(rest, threshold))
        release(rest)
        rest = materialize(_mixed(placed, comps, bitmaps), "line-rest")
    joined(_across(rest, threshold))
    release(rest, *(t for t in tables if t is not comps))
    return comps


def kept_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """``doc``, ``hash`` and ``kept``: the numbers (from 0) of a document's lines that stay, all blank ones among them.

    Documents of which no line stays have no row.
    """
    lines = document_lines(docs, key, text)  # made of the texts at each use: written, they would double the documents
    comps = line_classes(lines, threshold)
    firsts = lines.groupBy("lk").agg(F.min(F.struct("doc", "hash", "pos")).alias("at"))
    labelled = materialize(firsts.join(comps.withColumnRenamed("node", "lk"), "lk", "left").select("at.*", "comp"), "line-firsts")
    least = labelled.where("comp is not null").groupBy("comp").agg(F.min(F.struct("doc", "hash", "pos")).alias("at")).select("at.*")
    kept = labelled.where("comp is null").drop("comp").union(least).groupBy("doc", "hash").agg(F.array_sort(F.collect_list("pos")).alias("kept"))
    kept = materialize(kept, "kept-lines")
    release(comps, labelled)
    return kept


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, with_text: bool = True) -> DataFrame:
    """All columns of ``docs`` with ``text`` cut down to the lines that stay, plus ``n_lines`` and ``n_kept``.

    Lines are counted by line feeds, blank ones stay. Null texts count as empty: one blank line, which stays. Rows with equal
    ``key`` and text are one document: each gets the same lines. Null keys are allowed and sort first. An empty table gives an
    empty result. Without ``with_text`` the text column is left out, ``kept_lines`` holds the numbers of the lines that stay,
    and no text is shuffled for the result. Columns with the new names are replaced.
    """
    kept = kept_lines(docs, key, text, threshold)
    new = ("n_lines", "n_kept", "kept_lines")
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    own = [c for c in docs.columns if c not in (text, *new)]
    # the caller's columns go along as one, so that no name of theirs can clash with one of these
    rows = docs.select(carried(own).alias("row"), F.col(f"`{key}`").alias("doc"), F.xxhash64(whole).alias("hash"), whole.alias("text"))
    feeds = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    rows = rows.withColumn("n_lines", feeds + 1)
    if not with_text:
        rows = rows.drop("text")
    joined = rows.join(kept, rows["doc"].eqNullSafe(kept["doc"]) & (rows["hash"] == kept["hash"]), "left")
    stay = F.coalesce("kept", F.array().cast("array<int>"))
    out = joined.withColumn("stay", stay).withColumn("n_stay", F.size("stay"))
    if with_text:
        out = out.withColumn("all_lines", F.split("text", "\n")).withColumn("stays", F.array_join(F.transform("stay", lambda i: F.get("all_lines", i)), "\n"))
    new_columns = {text: "stays", "n_lines": "n_lines", "n_kept": "n_stay"} if with_text else {"n_lines": "n_lines", "n_kept": "n_stay", "kept_lines": "stay"}
    out = out.select("row", F.struct(*[F.col(c).alias(n) for n, c in new_columns.items()]).alias("new"))
    return out.select(*unpacked("row", own), *unpacked("new", list(new_columns)))
