"""Best-fit packing of documents into token sequences, planned on a histogram of lengths.

Documents are tokenized once, cut into pieces of at most the capacity, and only the pieces' small descriptions are kept. The
number of pieces of each length (a histogram of at most ``capacity`` rows, whatever the corpus) goes to the driver, where
best-fit decreasing runs over counts: whole runs of equal lengths are placed into whole runs of sequences with equal room, so
a plan has entries by lengths, not by documents. Pieces take their slots by joining on length and rank within the length.

Ranks need no sort of the whole and no task with all pieces of one length: pieces of a length are split by a hash into as many
groups as there are shuffle partitions, ranked within, and shifted by the sizes of the groups before.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialize

#: Entries that a plan may have: it is broadcast (40 bytes each).
MOST = 1_000_000
#: Fixed value: the split of byte-level BPE vocabularies whose files name no pattern of their own.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def load_encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to token ids as ``tokenizers`` gives them for a file with ``add_special_tokens=False``.

    No token is added; an added token's string in a text is that token, as there. A plain byte-level BPE whose ids are in the
    order of its merges gives the same ids by ``tiktoken``, several times as fast; texts that are too much for that one's
    pattern (a million blanks in a row) and any other file go to ``tokenizers`` itself.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    vocabulary = model.get("vocab", {})
    if model.get("type") == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer"):
        letters = _byte_letters()
        added = spec.get("added_tokens", [])
        special = {t["content"]: t["id"] for t in added}
        bare = not any(t.get(x) for t in added for x in ("lstrip", "rstrip", "single_word"))
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocabulary["".join(m)] for m in merges]
        plain = {w: i for w, i in vocabulary.items() if w not in special}
        if bare and made == sorted(made) and len(plain) == len(merges) + 256 and all(set(w) <= letters.keys() for w in plain):
            import tiktoken

            ranks = {bytes(letters[c] for c in w): i for w, i in plain.items()}
            encoding = tiktoken.Encoding("plain", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)

            def encode(text: str) -> np.ndarray:
                try:
                    return encoding.encode_to_numpy(text, allowed_special="all")
                except ValueError:
                    return _plainly(path)(text)

            return encode
    return _plainly(path)


@cache
def _plainly(path: str) -> Callable[[str], np.ndarray]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of n ids: whole if it fits, else full pieces after a first, shorter one."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, key: str = "doc_id", text: str = "text", end: int = 0) -> DataFrame:
    """A row for each piece: ``key``, piece, start, length, ids_crc32. Every document ends with the id ``end``."""
    source = docs.select(F.col(f"`{key}`").alias("doc"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    schema = f"doc {source.schema[0].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = load_encoder(tokenizer)
        for batch in batches:
            taken, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = np.append(ids_of(t), end).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
                    taken.append(i)
            columns = [pa.array([r[i] for r in rows], pa.int32() if i == 0 else pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(taken, pa.int64())), *columns], names=["doc", "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(encode, schema).withColumnRenamed("doc", key)


def best_fit_plan(counts: Iterable[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset): pieces of these ranks go to as many sequences in a row.

    Best-fit decreasing: lengths from long to short, each piece into the sequence with the least room that takes it, a new
    one if none does. Equal lengths fill a sequence before the next one is begun, so runs are placed at once.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []  # sorted, those that are not empty
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room left: first sequence and number of sequences
    new = 0

    def put(room: int, first: int, number: int) -> None:
        if room and number:
            if not runs[room]:
                insort(rooms, room)
            runs[room].append((first, number))

    for length, count in sorted(counts, reverse=True):
        rank = 0
        while rank < count:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, number = runs[room].pop()
                if not runs[room]:
                    del rooms[at]
            else:
                room, first = capacity, new
                number = -(-(count - rank) // (capacity // length))
                new += number
            each = room // length
            whole = min(number, (count - rank) // each)
            for slot in range(each if whole else 0):
                plan.append((length, rank, whole, first, capacity - room + slot * length))
                rank += whole
            put(room - each * length, first, whole)
            first, number = first + whole, number - whole
            left = count - rank
            if number and left < each:  # the last sequence of this length takes the rest
                for slot in range(left):
                    plan.append((length, rank, 1, first, capacity - room + slot * length))
                    rank += 1
                used = 1 if left else 0
                put(room - left * length, first, used)
                put(room, first + used, number - used)
    return plan


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: ``key``, piece, start, length, ids_crc32, sequence_id, offset (gapless in a sequence from 0).

    Null texts count as empty, and an empty document is its end id alone. Rows with the same ``key`` are packed each; an empty
    table gives an empty result. Other columns are left out.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = materialize(pieces_of(docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text")), tokenizer, capacity, "doc"), "pieces")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(F.col("doc").cast("string"), "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    sizes = materialize(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "piece-counts")
    counts = [(r.length, r.n) for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()]
    plan = best_fit_plan(counts, capacity)
    if len(plan) > MOST:
        raise RuntimeError(f"a plan of {len(plan)} entries is more than the bound of {MOST}")
    before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc", "piece", "ids_crc32"))
    ranked = salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    slots = spark.createDataFrame(plan, "slot_length bigint, first bigint, pieces bigint, sequence bigint, offset bigint")
    fits = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("pieces"))
    # the plan's size is bounded by the capacity alone: runs of lengths by runs of room
    return ranked.join(F.broadcast(slots), fits).select(F.col("doc").alias(key), "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
