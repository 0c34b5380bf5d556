"""Mixing documents to target weights of domains with soft membership, with DataFrame functions only.

A labelled table names the domain of some documents. A naive Bayes classifier over words, word beginnings and classes of
symbol density, its features chosen by likelihood ratio, scores every document in every domain; a scale and an offset for each
domain, fitted on labelled documents that the scores were not learned from, turn the scores into posteriors. Then a rate, its
expected number of copies, is fitted to every document such that the expected token totals of the domains, each document
counting towards each domain by its posterior, come close to the target weights of a token budget: least squares over rates
between bounds (0 and 4 by default: no document comes more often than four times), of all solutions the one closest to 1.

Closest is a small weight ``NEAR`` on the rates' squared distance from 1. Then the best rate of a document is 1 less a combination
of its posteriors, cut to the bounds, by one factor for each domain. The factors minimise a convex function of as many variables as
there are domains, whose derivatives are sums over all documents: a damped Newton step is one aggregation. The fit ends when the
gradient is ``EXACT``, and raises an error if it can't get there.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import carried, materialize, unpacked

#: Documents that the classifier is fitted on, features that it keeps, and documents that a feature must be in.
SAMPLE, FEATURES, LEAST = 6000, 512, 8
#: Log likelihood ratio that a feature must have, and documents' worth of the pooled rate in each domain's rate.
SURE, POOLED = 12.0, 30.0
#: Weight of the rates' distance from 1 against the totals', and the gradient that counts as none, as a part of the smallest target.
NEAR, EXACT = 1e-7, 1e-6
#: Part of its target that a domain's total may miss without a warning.
NEARLY = 0.02


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _features(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc``, ``hash`` and a feature in each row; a feature of a document may come in several rows."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("doc"), F.xxhash64(whole).alias("hash"), whole.alias("text"))
    marks = F.regexp_count("text", F.lit(r"[#$%&*|!]+"))
    rows = rows.select("doc", "hash", marks.alias("marks"), F.split(F.lower("text"), r"[^\p{L}]+").alias("words"))
    density = F.concat(F.lit("#"), F.least(F.lit(5), F.floor(F.lit(6) * F.col("marks") / F.greatest(F.size("words"), F.lit(1)))).cast("string"))
    words = rows.select("doc", "hash", F.explode(F.concat("words", F.array(density))).alias("w"))
    # a word and its first five letters
    return words.where("w <> ''").select("doc", "hash", F.explode(F.array(F.col("w"), F.concat(F.lit("^"), F.substring("w", 1, 5)))).alias("f"))


def weights(docs: DataFrame, labelled: DataFrame, domains: list[str], key: str, text: str, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """The features' log probabilities ``w0``, ``w1``, ... by domain (``FEATURES`` rows at most), and the domain of documents left to calibrate on.

    Of the ``sample`` labelled documents with the smallest hash of their id, two thirds give the features, one is left.
    """
    marked = labelled.where(F.col("domain").isin(domains) & F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("doc")).agg(F.min("domain").alias("domain"))
    every_one = marked.withColumn("h", F.xxhash64(F.col("doc").cast("string"))).orderBy("h", "doc").limit(sample)
    some, rest = every_one.where("pmod(h, 3) > 0").drop("h"), every_one.where("pmod(h, 3) = 0").drop("h")
    own = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text")).join(F.broadcast(some.select("doc")), "doc")
    seen = materialize(_features(own, "doc", "text").distinct().join(F.broadcast(some), "doc"), "features")
    counted = seen.groupBy("domain").agg(F.count_distinct("doc", "hash").alias("n"), F.count("*").alias("all")).collect()
    sizes = {r.domain: r.n for r in counted}
    # features of all documents of a domain: their number, not the documents', keeps long documents from looking likelier
    size = {r.domain: r["all"] for r in counted}
    total = sum(size.values())
    table = seen.groupBy("f").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{i}") for i, d in enumerate(domains)])
    n = [F.col(f"n{i}") for i in range(len(domains))]
    every = _sum(n)
    pooled = POOLED * total / max(sum(sizes.values()), 1)
    # the log likelihood ratio of the feature's spread over the domains
    ratio = _sum([F.when(c > 0, c * F.log(c * F.lit(total) / (every * F.lit(max(size.get(d, 0), 1))))).otherwise(0.0) for c, d in zip(n, domains, strict=True)])
    chosen = table.where((every >= LEAST) & (ratio >= SURE)).orderBy(F.desc(ratio), "f").limit(FEATURES)
    found = chosen.select("f", *[F.log((c + every * F.lit(pooled / max(total, 1))) / (size.get(d, 0) + pooled)).alias(f"w{i}") for i, (c, d) in enumerate(zip(n, domains, strict=True))])
    return found, rest


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], key: str, text: str, sample: int = SAMPLE) -> DataFrame:
    """``doc``, ``hash``, ``n`` (words) and ``p0``, ``p1``, ... for every different document."""
    table, rest = weights(docs, labelled, domains, key, text, sample)
    k = range(len(domains))
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    own = docs.select(F.col(f"`{key}`").alias("doc"), F.xxhash64(whole).alias("hash"), F.regexp_count(whole, F.lit(r"\S+")).cast("bigint").alias("n"))
    own = own.groupBy("doc", "hash").agg(F.max("n").alias("n"), F.count("*").alias("rows"))
    hits = _features(docs, key, text).join(F.broadcast(table), "f").groupBy("doc", "hash", "f").agg(*[F.first(f"w{i}").alias(f"w{i}") for i in k])
    sums = hits.groupBy("doc", "hash").agg(*[F.sum(f"w{i}").alias(f"s{i}") for i in k])
    joined = own.alias("o").join(sums.alias("s"), F.expr("o.doc <=> s.doc and o.hash = s.hash"), "left")
    scored = joined.select("o.doc", "o.hash", "n", "rows", *[F.coalesce(f"s{i}", F.lit(0.0)).alias(f"s{i}") for i in k])
    scored = materialize(scored, "scores")
    # one document for each id of the bounded sample
    known = scored.join(F.broadcast(rest), "doc").groupBy("doc", "domain").agg(*[F.min(f"s{i}").alias(f"s{i}") for i in k]).collect()
    scale, offsets = calibrate([([r[f"s{i}"] for i in k], domains.index(r["domain"])) for r in known], len(domains))
    z = [F.lit(scale) * F.col(f"s{i}") + F.lit(offsets[i]) for i in k]
    topped = scored.select("doc", "hash", "n", "rows", *[c.alias(f"z{i}") for i, c in enumerate(z)]).withColumn("top", F.greatest(*[f"z{i}" for i in k]) if len(domains) > 1 else F.col("z0"))
    parts = [F.exp(F.col(f"z{i}") - F.col("top")) for i in k]
    return topped.select("doc", "hash", "n", "rows", *[(p / _sum(parts)).alias(f"p{i}") for i, p in enumerate(parts)])


def calibrate(known: list[tuple[list[float], int]], n: int, steps: int = 150) -> tuple[float, list[float]]:
    """The scale of all scores and the offset of each of ``n`` domains under which the known domains are likeliest.

    Starts from the domains' frequencies, with one more document for each; without known documents that is all there is.
    """
    seen = [1.0] * n
    for _, y in known:
        seen[y] += 1
    scale, offsets = 0.5, [math.log(x / sum(seen)) for x in seen]
    first, second = [0.0] * (n + 1), [0.0] * (n + 1)
    for step in range(1, steps + 1 if known else 1):
        grad = [0.0] * (n + 1)
        for scores, y in known:
            z = [scale * s + b for s, b in zip(scores, offsets, strict=True)]
            top = max(z)
            e = [math.exp(x - top) for x in z]
            total = sum(e)
            for i in range(n):
                d = (i == y) - e[i] / total
                grad[0] += d * scores[i]
                grad[i + 1] += d
        for i, g in enumerate(grad):
            g /= len(known)
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            move = 0.05 * (first[i] / (1 - 0.9**step)) / (math.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
            if i:
                offsets[i - 1] += move
            else:
                scale = max(0.01, scale + move)
    return scale, offsets


def _descend(at: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], start: np.ndarray, goal: float, damping: float, steps: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Minimise a convex function, given by its gradient and curvature, in ``steps`` calls of it at most: the place, the gradient and whether it is done.

    Newton steps, damped by a multiple of the identity that falls while whole steps go well. A step after which the slope along
    it is no longer falling, or has hardly changed, went over a kink, or stopped short of one: then the line is searched
    between the nearest points on both sides, by Newton steps from either, the far one first.
    """
    place = start
    gradient, curve = at(place)
    used = 1
    while True:
        # what doubles can tell of a rate, where factors are large
        if max(abs(gradient)) <= max(goal, 1e-15 * (1 + max(abs(place)))):
            return place, gradient, True
        move = -np.linalg.solve(curve + damping * np.eye(len(place)), gradient)
        fall = -float(gradient @ move)
        below, above, length, tries = (0.0, -fall, float(move @ curve @ move)), None, 1.0, 0
        while True:
            if used == steps:
                return place, gradient, False
            tried = place + length * move
            new = at(tried)
            used += 1
            tries += 1
            slope, bend = float(new[0] @ move), float(move @ new[1] @ move)
            if max(abs(new[0])) <= goal or (slope <= 0.3 * fall and (slope >= -0.9 * fall or length >= 1)):
                break
            if slope > 0:
                above = (length, slope, bend)
            else:
                below = (length, slope, bend)
            length = above[0] - above[1] / above[2]
            if not below[0] < length < above[0]:
                length = below[0] - below[1] / below[2]
            if not below[0] < length < above[0] or tries % 4 == 0:
                length = (below[0] + above[0]) / 2
        place, (gradient, curve) = tried, new
        damping = damping * 3 if tries > 1 else damping / 3


def fit(sums: Callable[[list[float]], tuple[list[float], list[list[float]]]], wanted: list[float], steps: int) -> list[float]:
    """The factors of the best rates; ``wanted`` and the sums are shares of all words.

    For factors, ``sums`` gives the domains' totals at the cut rates, and the sums of the products of posteriors over the
    documents whose rates are between the bounds.

    The first descent, from factors of 0, ends for the tables known. Where few documents are between the bounds it can creep
    from kink to kink; then weights of the rates' distance are gone through that fall to ``NEAR`` by threes, each from where
    the line through the factors of the two before, over the weight's inverse, leads (at an infinite weight they are 0).
    """
    target = np.array(wanted, float)
    nothing = np.zeros(len(wanted))

    def weighted(near: float) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
        def at(factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            totals, free = sums([float(f) for f in factors])
            return near * factors - np.array(totals) + target, np.array(free) + near * np.eye(len(wanted))

        return at

    goal = EXACT * min([w for w in wanted if w > 0], default=1.0)
    factors, gradient, done = _descend(weighted(NEAR), nothing, goal, 1e-2, steps)
    if not done:
        # the factors and the inverse of the weight of the last two stages
        before, last, near = (nothing, 0.0), (nothing, 0.0), 1e-2
        while not done:
            ahead = (1 / near - last[1]) / (last[1] - before[1]) if last[1] > before[1] else 0.0
            factors, gradient, done = _descend(weighted(near), last[0] + ahead * (last[0] - before[0]), goal if near == NEAR else 1e-3 * math.sqrt(near), near / 10, steps)
            if near == NEAR:
                break
            before, last, near, done = last, (factors, 1 / near), max(NEAR, near / 3), False
    if not done:
        raise RuntimeError(f"the rates' fit did not converge, with {steps} steps a descent: gradient {gradient.tolist()}, goal {goal}")
    return factors.tolist()


def mix(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text", anchor: str | None = None,
    headroom: float = 1.0, bounds: tuple[float, float] = (0.0, 4.0), steps: int = 60, sample: int = SAMPLE,
) -> DataFrame:
    """``key``, ``text_hash``, ``n_tokens``, ``p_<domain>`` for each domain, ``rate`` and ``copies`` for each different document.

    ``labelled`` has ``key`` and ``domain``; ``targets`` gives the domains and their weights, which are scaled to a sum of 1.
    The budget is the documents' own number of words, or, with an ``anchor``, what gives that domain ``headroom`` times its
    own words. ``bounds`` are those of the rates; ``steps`` is how many aggregations a descent of the fit may take; where the last one takes more, an error is raised.
    ``copies`` is the rate rounded up or down by a hash of the document, so its expectation is the rate. Totals that no rates
    between the bounds can bring within ``NEARLY`` of their targets are told in a warning, with the shares that are reached.

    Rows with equal ``key`` and text are one document whose words count as often as it has rows; null texts count as empty,
    null keys are allowed. A document without words has no bearing on the totals and follows its posterior (the prior). Labels
    of other domains are left out. An empty table gives an empty result.
    """
    domains = sorted(targets)
    k = range(len(domains))
    share = [targets[d] / sum(targets.values()) for d in domains]
    table = materialize(posteriors(docs, labelled, domains, key, text, sample), "posteriors")
    words = F.col("n") * F.col("rows")
    pairs = [(i, j) for i in k for j in k if i <= j]
    p = [F.col(f"p{i}") for i in k]
    first = table.agg(*[F.sum(words * p[i]).alias(f"t{i}") for i in k], F.sum(words).alias("n")).first()
    n = float(first["n"] or 0)
    own = [float(first[f"t{i}"] or 0) for i in k]
    budget = n
    if anchor is not None and own[domains.index(anchor)] > 0:
        budget = headroom * own[domains.index(anchor)] / share[domains.index(anchor)]
    low, high = float(bounds[0]), float(bounds[1])

    def free_rate(factors: list[float]) -> Column:
        return F.lit(1.0) - _sum([F.lit(f) * c for f, c in zip(factors, p, strict=True)])

    def cut(free: Column) -> Column:
        return F.least(F.lit(high), F.greatest(F.lit(low), free))

    def sums(factors: list[float]) -> tuple[list[float], list[list[float]]]:
        rows = table.select(words.alias("w"), *p, free_rate(factors).alias("free")).withColumn("cut", cut(F.col("free")))
        inside = F.when((F.col("free") > low) & (F.col("free") < high), F.col("w")).otherwise(0)
        now = rows.agg(*[F.sum(F.col("w") * p[i] * F.col("cut")).alias(f"t{i}") for i in k], *[F.sum(inside * p[i] * p[j]).alias(f"a{i}_{j}") for i, j in pairs]).first()
        return [now[f"t{i}"] / n for i in k], [[now[f"a{min(i, j)}_{max(i, j)}"] / n for j in k] for i in k]

    factors = fit(sums, [s * budget / n for s in share], steps) if n else [0.0 for _ in k]
    if n:
        reached = [t * n / budget for t in sums(factors)[0]]
        if any(abs(r - s) > NEARLY * s for r, s in zip(reached, share, strict=True)):
            told = ", ".join(f"{d} {r:.4f} of {s:.4f}" for d, r, s in zip(domains, reached, share, strict=True))
            warnings.warn(f"the domains' totals, as parts of the budget, miss their targets: {told}", stacklevel=2)
    out = table.withColumn("rate", cut(free_rate(factors)))
    uniform = F.pmod(F.xxhash64("hash", F.col("doc").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = (F.floor("rate") + F.when(uniform < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return out.select(F.col("doc").alias(key), F.col("hash").alias("text_hash"), F.col("n").alias("n_tokens"), *[p[i].alias(f"p_{d}") for i, d in enumerate(domains)], "rate", copies.alias("copies"))


def apply_copies(docs: DataFrame, mixed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` says for its ``key`` and text; one without an entry goes."""
    left = docs.select(carried(docs.columns).alias("row"), F.col(f"`{key}`").alias("doc"), F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("hash"))
    right = mixed.where("copies > 0").select(F.col(f"`{key}`").alias("doc"), F.col("text_hash").alias("hash"), "copies")
    joined = left.join(right, left["doc"].eqNullSafe(right["doc"]) & (left["hash"] == right["hash"]))
    return joined.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select(*unpacked("row", docs.columns))


def domains_of_labels(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The domains that the table of labels tells apart: junk (quality 0), toxic, clean."""
    domain = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")
    return labels.select(F.col(f"`{key}`"), domain.alias("domain")).where("domain is not null")
