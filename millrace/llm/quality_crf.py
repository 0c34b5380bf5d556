"""Document quality by a linear-chain conditional random field over lines.

Every line of a document is labelled good or bad. The model's node scores use features of the line and of the lines before
and after it; edge scores join the labels of neighbouring lines. Forward-backward gives each line's marginal probability of
being good; weighted by the lines' lengths these add up to the document's quality, which a one-dimensional logistic map,
fitted on the training documents, turns into a probability of label 1.

Labels exist for documents only. Training starts with each line bearing its document's label, then twice lets the model itself
move lines of bad documents to good ones where it finds them so (a bad document keeps its worst line): shared good lines in
bad documents are not learned as bad. Weights come from full-batch gradient ascent on the penalised log-likelihood, with
Adam's step sizes, from a zero start: no randomness.

The training sample is bounded (``sample`` labelled documents, those with the smallest hash of their id and text), so is the driver's memory; the
features are computed on the executors. Scoring is a map over documents, in slices of a few MB.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import carried, unpacked

#: Bytes by kind; the order gives the columns of the counts.
KINDS = ("lower", "upper", "digit", "space", "stop", "pause", "bang", "bar", "mark", "letter", "rest")
#: Bytes of text in a slice of a batch that is worked on at once; a longer document is a slice of its own.
SLICE = 2 << 20


def _classes() -> np.ndarray:
    table = np.full(256, KINDS.index("mark"), np.uint8)
    for kind, chars in {
        "lower": bytes(range(97, 123)), "upper": bytes(range(65, 91)), "digit": b"0123456789", "space": b" \t\r", "stop": b".?",
        "pause": b",;:'\"()-", "bang": b"!", "bar": b"|", "letter": bytes(range(0xC0, 256)), "rest": bytes(range(0x80, 0xC0)),
    }.items():
        table[list(chars)] = KINDS.index(kind)
    return table


_CLASS = _classes()
#: A weight for each byte value, by which words are told apart; white space weighs nothing.
_WEIGHT = np.random.default_rng(7).integers(1, 1 << 40, 256)
_WEIGHT[[9, 10, 13, 32]] = 0
N_OWN = 14


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of all texts, in order: features (own, then those of the line before and after), lengths; lines of each text.

    A text has one line more than it has newlines, so an empty one has one empty line.
    """
    data = "\n".join(texts).encode("utf-8", "replace") + b"\n"
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n_lines = np.array([t.count("\n") + 1 for t in texts], np.int64)
    kinds = _CLASS[raw]
    kinds[ends] = 255
    count = {k: np.add.reduceat((kinds == i).view(np.uint8), starts, dtype=np.int64).astype(float) for i, k in enumerate(KINDS)}
    shift = np.zeros(len(raw), bool)
    shift[1:] = (kinds[1:] != KINDS.index("space")) & ((kinds[:-1] == KINDS.index("space")) | (kinds[:-1] == 255))
    shift[0] = kinds[0] != KINDS.index("space")
    shift[ends] = False
    words = np.add.reduceat(shift.view(np.uint8), starts, dtype=np.int64).astype(float)
    said = np.add.reduceat(_WEIGHT[raw], np.flatnonzero(shift)) if shift.any() else np.zeros(0, np.int64)
    line_of = np.searchsorted(ends, np.flatnonzero(shift))
    same = np.zeros(len(said), bool)
    same[1:] = (said[1:] == said[:-1]) & (line_of[1:] == line_of[:-1])
    repeated = np.bincount(line_of, weights=same, minlength=len(ends))
    chars = (ends - starts) - count["rest"]
    letters = count["lower"] + count["upper"] + count["letter"]
    some, any_words = np.maximum(chars, 1), np.maximum(words, 1)
    lines = data.split(b"\n")[:-1]
    doc = np.repeat(np.arange(len(texts)), n_lines)
    seen: set[tuple[int, bytes]] = set()
    again = np.zeros(len(lines))
    for i, (d, line) in enumerate(zip(doc.tolist(), lines, strict=True)):
        if line:
            key = (d, line)
            if key in seen:
                again[i] = 1
            else:
                seen.add(key)
    last = np.where(ends > starts, kinds[np.maximum(ends - 1, 0)], 255)
    first = np.where(ends > starts, kinds[starts], 255)
    own = np.stack(
        [
            np.log1p(chars) / 5, (chars == 0).astype(float), count["upper"] / np.maximum(letters, 1), count["digit"] / some,
            np.minimum(count["mark"] / any_words, 3), np.minimum(count["bang"] / any_words, 2), np.minimum(count["bar"] / any_words, 2),
            (count["stop"] + count["pause"]) / any_words, np.minimum(letters / any_words, 20) / 10, again,
            (last == KINDS.index("stop")).astype(float), (first == KINDS.index("upper")).astype(float), np.minimum(words, 5) / 5,
            repeated / any_words,
        ], axis=1,
    )
    begin = np.zeros(len(lines), bool)
    begin[np.concatenate([[0], np.cumsum(n_lines)[:-1]])] = True
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = np.where(begin[1:, None], 0, own[:-1])
    after[:-1] = np.where(begin[1:, None], 0, own[1:])
    ones = np.ones((len(own), 1))
    last_line = np.append(begin[1:], True)
    return np.concatenate([own, before, after, ones, begin[:, None], last_line[:, None]], axis=1), chars, n_lines


N_FEATURES = 3 * N_OWN + 3


def _groups(n_lines: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents with similar numbers of lines, and where each one's first line is."""
    first = np.concatenate([[0], np.cumsum(n_lines)[:-1]])
    size = np.ceil(np.log2(np.maximum(n_lines, 1))).astype(int)
    for s in np.unique(size):
        docs = np.flatnonzero(size == s)
        yield docs, first[docs]


def marginals(node: np.ndarray, edge: np.ndarray, n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward: P(good) of each line, expected counts of the label pairs (2 x 2), and the sum of log partition sums.

    ``node`` is each line's score of being good (bad scores 0), ``edge[a, b]`` the score of label b after label a.
    """
    good, pairs, log_z = np.zeros(len(node)), np.zeros((2, 2)), 0.0
    for docs, first in _groups(n_lines):
        n = n_lines[docs]
        width = int(n.max())
        at = np.minimum(np.arange(width)[None, :], n[:, None] - 1) + first[:, None]
        live = np.arange(width)[None, :] < n[:, None]
        score = np.stack([np.zeros_like(at, float), node[at]], axis=-1)
        alpha, beta = np.zeros((len(docs), width, 2)), np.zeros((len(docs), width, 2))
        alpha[:, 0] = score[:, 0]
        for t in range(1, width):
            step = np.logaddexp(alpha[:, t - 1, 0, None] + edge[0], alpha[:, t - 1, 1, None] + edge[1]) + score[:, t]
            alpha[:, t] = np.where(live[:, t, None], step, alpha[:, t - 1])
        for t in range(width - 2, -1, -1):
            ahead = beta[:, t + 1] + score[:, t + 1]
            step = np.logaddexp(edge[:, 0] + ahead[:, 0, None], edge[:, 1] + ahead[:, 1, None])
            beta[:, t] = np.where(live[:, t + 1, None], step, 0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        log_z += float(z.sum())
        both = np.exp(alpha + beta - z[:, None, None])
        good[at[live]] = both[..., 1][live]
        if width > 1:
            joint = np.exp(alpha[:, :-1, :, None] + edge[None, None] + (beta[:, 1:] + score[:, 1:])[:, :, None, :] - z[:, None, None, None])
            pairs += joint[live[:, 1:]].sum(axis=0)
    return good, pairs, log_z


def fit(x: np.ndarray, lengths: np.ndarray, n_lines: np.ndarray, labels: np.ndarray, steps: int = 60, penalty: float = 1e-3) -> dict:
    """The model from the lines' features, the lines of each document and the documents' labels."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    mean[-3:], spread[-3:] = 0, 1
    spread[spread < 1e-6] = 1
    scaled = (x - mean) / spread
    doc = np.repeat(np.arange(len(n_lines)), n_lines)
    y = labels[doc].astype(float)
    inner = np.ones(len(x), bool)
    inner[np.concatenate([[0], np.cumsum(n_lines)[:-1]])] = False
    weights, edge = np.zeros(x.shape[1]), np.zeros((2, 2))
    good = y
    # both kinds of documents weigh the same: each line by the inverse of its kind's share
    for turn in range(3):
        if turn:
            moved = np.where(labels[doc] == 0, good > 0.5, y > 0.5)
            worst = np.full(len(n_lines), np.inf)
            np.minimum.at(worst, doc, good)
            moved[(labels[doc] == 0) & (good <= worst[doc])] = False
            y = moved.astype(float)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:-1][inner[1:]].astype(int), y[1:][inner[1:]].astype(int)), 1)
        grad = [np.zeros_like(weights), np.zeros_like(edge)]
        square = [np.zeros_like(weights), np.zeros_like(edge)]
        for step in range(1, steps + 1):
            good, pairs, _ = marginals(scaled @ weights, edge, n_lines)
            now = [scaled.T @ (y - good) / len(x) - penalty * weights, (seen - pairs) / len(x) - penalty * edge]
            for i, g in enumerate(now):
                grad[i] = 0.9 * grad[i] + 0.1 * g
                square[i] = 0.99 * square[i] + 0.01 * g * g
            rate = [0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8) for m, s in zip(grad, square, strict=True)]
            weights, edge = weights + rate[0], edge + rate[1]
        good = marginals(scaled @ weights, edge, n_lines)[0]
    raw = _pooled(good, lengths, n_lines)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's steps for the logistic map of the pooled log-odds
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        target = np.where(labels == 1, 1 - 1 / (labels.sum() + 2), 1 / (len(labels) - labels.sum() + 2))
        g = np.array([(raw * (target - p)).sum() - 1e-2 * (a - 1), (target - p).sum()])
        h = np.array([[(w * raw * raw).sum() + 1e-2, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-6]])
        a, b = np.array([a, b]) + np.clip(np.linalg.solve(h, g), -1, 1)
    return {"mean": mean.tolist(), "spread": spread.tolist(), "weights": weights.tolist(), "edge": edge.tolist(), "map": [float(a), float(b)]}


def _pooled(good: np.ndarray, lengths: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Log-odds of the length-weighted mean marginal of each document."""
    first = np.concatenate([[0], np.cumsum(n_lines)[:-1]])
    total = np.add.reduceat(lengths, first)
    share = np.add.reduceat(good * lengths, first) / np.maximum(total, 1)
    share = np.clip(share, 1e-3, 1 - 1e-3)
    return np.log(share / (1 - share))


def score_texts(texts: list[str], model: dict) -> np.ndarray:
    """P(label 1) of each text; 0 for one without any character but line ends."""
    x, lengths, n_lines = line_features(texts)
    node = ((x - np.array(model["mean"])) / np.array(model["spread"])) @ np.array(model["weights"])
    good = marginals(node, np.array(model["edge"]), n_lines)[0]
    a, b = model["map"]
    score = 1 / (1 + np.exp(-np.clip(a * _pooled(good, lengths, n_lines) + b, -30, 30)))
    first = np.concatenate([[0], np.cumsum(n_lines)[:-1]])
    return np.where(np.add.reduceat(lengths, first) > 0, score, 0.0)


def _slices(values: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for v in values:
        if part and size + len(v) > SLICE:
            yield part
            part, size = [], 0
        part.append(v)
        size += len(v)
    if part:
        yield part


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 4000) -> dict:
    """Fit on at most ``sample`` labelled documents (``labels``: ``key`` and ``label`` 0 or 1; other values and nulls are left out).

    With no label of one kind there is nothing to tell apart; the model then scores every text with characters 1 (or 0).
    """
    marked = labels.where(F.col(f"`{label}`").isin(0, 1) & F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y"))
    order = F.xxhash64(F.col("k").cast("string"))
    some = marked.groupBy("k").agg(F.max("y").alias("y")).withColumn("h", order).orderBy("h", "k").limit(sample)
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t")).join(F.broadcast(some.select("k", "y")), "k")
    rows = rows.groupBy("k", "y").agg(F.min("t").alias("t")).select("k", "t", "y")  # an id that is repeated counts once

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for i, (t, y) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                x, lengths, _ = line_features([t])
                blob = np.concatenate([x, lengths[:, None]], axis=1).astype(np.float32).tobytes()
                yield pa.RecordBatch.from_arrays([keys.slice(i, 1).cast(pa.string()), pa.array([blob], pa.binary()), pa.array([y], pa.int32())], names=["k", "x", "y"])

    got = rows.mapInArrow(measure, "k string, x binary, y int").collect()
    got.sort(key=lambda r: (r.k, r.x))
    constant = {"mean": [0.0] * N_FEATURES, "spread": [1.0] * N_FEATURES, "weights": [0.0] * N_FEATURES, "edge": [[0.0] * 2] * 2}
    kinds = {r.y for r in got}
    if len(kinds) < 2:
        return constant | {"map": [0.0, 30.0 if kinds != {0} else -30.0]}
    parts = [np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES + 1).astype(float) for r in got]
    every = np.concatenate(parts)
    return fit(every[:, :-1], every[:, -1], np.array([len(p) for p in parts]), np.array([r.y for r in got]))


def score_quality(docs: DataFrame, model: dict, text: str = "text", score: str = "score", keep_text: bool = False) -> DataFrame:
    """All columns of ``docs``, ``text`` as a string only if it is to be kept, plus ``score``: the model's P(label 1) of the whole text.

    Null texts count as empty and score 0. Rows are independent, so repeated rows, null ids and an empty table need no care;
    a column of ``docs`` that is already called like ``score`` is replaced.
    """
    kept = [c for c in docs.columns if c not in (text, score)]
    source = docs.select(carried(kept).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = (source if keep_text else source.drop("text")).withColumn("score", F.lit(0.0)).schema
    packed = json.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = json.loads(packed)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            scores = np.concatenate([score_texts(part, own) for part in _slices(texts)]) if texts else np.zeros(0)
            columns = batch.columns if keep_text else batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=["row", *(["text"] if keep_text else []), "score"])

    found = source.mapInArrow(run, schema).withColumn("new", F.struct(*([F.col("text").alias(text)] if keep_text else []), F.col("score").alias(score)))
    return found.select(*unpacked("row", kept), *unpacked("new", [*([text] if keep_text else []), score]))


def held_out(key: str | Column) -> Column:
    """Documents that labels are never learned from: crc32 of the id as text, modulo 5, is 0."""
    column = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 4000) -> DataFrame:
    """Train on the labels outside the held-out documents, then score every document."""
    return score_quality(docs, train(docs, labels.where(~held_out(key)), key, text, sample=sample), text)
