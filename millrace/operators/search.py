"""Ranked full-text search over a derived index of terms.

The index has a row for each term, field and document: term, field, source_id, frequency. A document's score is the sum of
its frequencies of the query's terms; results go by score, then key. The index is an ordinary table: it can be written,
partitioned by term, updated by difference and checked against the documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import Tokenizer
from millrace.operators.query import Query


def build_index(docs: DataFrame, key: str, fields: Sequence[str], tokenizer: Tokenizer | None = None) -> DataFrame:
    if not fields:
        raise ValueError("no field is searchable")
    t = tokenizer or Tokenizer()
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("text")) for f in fields]))
    texts = docs.select(F.col(f"`{key}`").alias("source_id"), pairs.alias("p")).select("source_id", "p.field", "p.text")
    if t.custom:
        each = texts.select("source_id", "field", F.explode(t.column(F.col("text"))).alias("term"))
    else:  # words are rows before they are tested: in generated code, not in functions of arrays
        words = texts.select("source_id", "field", F.explode(t.raw_words(F.col("text"))).alias("word"))
        each = words.where(t.passes(F.col("word"))).select("source_id", "field", t.cut(F.col("word")).alias("term"))
    return each.groupBy("term", "field", "source_id").agg(F.count("*").alias("frequency"))


def scores(index: DataFrame, text: str, fields: Sequence[str] | None = None, match: str = "any", tokenizer: Tokenizer | None = None, indexed: Sequence[str] | None = None) -> DataFrame:
    """``source_id`` and ``score`` of the documents that hold any, or all, of the text's terms; none for a text without terms."""
    if match not in ("any", "all"):
        raise ValueError("match is any or all")
    if fields and indexed and not set(fields) <= set(indexed):
        raise ValueError("a field is not indexed")
    terms = (tokenizer or Tokenizer()).terms(text)
    hits = index.where(F.col("term").isin(terms) if terms else F.lit(False))
    if fields:
        hits = hits.where(F.col("field").isin(list(fields)))
    # per term first, so that the number of terms is a count and no distinct aggregate
    per_term = hits.groupBy("source_id", "term").agg(F.sum("frequency").alias("f"))
    found = per_term.groupBy("source_id").agg(F.sum("f").alias("score"), F.count("*").alias("terms"))
    if match == "all":
        found = found.where(F.col("terms") == len(terms))
    return found.select("source_id", "score")


def search(docs: Query, index: DataFrame, key: str, text: str, fields: Sequence[str] | None = None, match: str = "any", tokenizer: Tokenizer | None = None, indexed: Sequence[str] | None = None) -> Query:
    """The documents that match, with their ``score``, best first; the documents' own scopes hold. Sorts work in call order."""
    found = scores(index, text, fields, match, tokenizer, indexed)
    joined = docs.df.join(found.withColumnRenamed("source_id", key), key)
    return Query(joined, (key,), (F.col("score").desc(), F.col(f"`{key}`").asc()))


def sort_found(found: Query, *by: tuple[str, bool]) -> Query:
    """Sort search results by several keys (name, descending), the first one primary, in place of the score."""
    keys = tuple(F.col(n).desc_nulls_last() if d else F.col(n).asc_nulls_first() for n, d in by)
    return Query(found.df, found.keys, keys)


def check_index(index: DataFrame, docs: DataFrame, key: str, fields: Sequence[str], tokenizer: Tokenizer | None = None) -> DataFrame:
    """Index rows that are missing, extra or stale (another frequency) against the documents: ``problem`` beside the row."""
    fresh = build_index(docs, key, fields, tokenizer).withColumnRenamed("frequency", "fresh")
    both = index.join(fresh, ["term", "field", "source_id"], "full_outer")
    problem = F.when(F.col("frequency").isNull(), "missing").when(F.col("fresh").isNull(), "extra").when(F.col("frequency") != F.col("fresh"), "stale")
    return both.withColumn("problem", problem).where("problem is not null").select("term", "field", "source_id", "problem")


def update_index(index: DataFrame, old: DataFrame, new: DataFrame, key: str, fields: Sequence[str], tokenizer: Tokenizer | None = None) -> DataFrame:
    """The index after documents changed from ``old`` to ``new`` rows (either may lack a key: added, removed)."""
    touched = old.select(key).union(new.select(key)).distinct().withColumnRenamed(key, "source_id")
    return index.join(touched, "source_id", "left_anti").select("term", "field", "source_id", "frequency").unionByName(build_index(new, key, fields, tokenizer))
