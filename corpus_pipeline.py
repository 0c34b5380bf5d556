"""A training corpus in five stages: quality, lines, near-duplicates, mix, packing. Each takes (spark, docs, sf_dir)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import line_dedup, mixing, ngram_join, packing, quality_crf
from millrace.llm.common import materialize
from millrace.llm.entry import MIX, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field finds bad (a score under 0.3) go."""
    labels = table(spark, sf_dir, "labels").where(~quality_crf.held_out("doc_id"))
    model = quality_crf.train(docs, labels)
    scored = quality_crf.score_quality(docs, model, score="__score", keep_text=True)
    return scored.where("__score >= 0.3").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of lines one stays; documents of which only blank lines are left go."""
    cut = line_dedup.dedup_lines(docs).where(F.length(F.trim(F.translate("text", "\n\t\r", "   "))) > 0)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    return ngram_join.keep_one(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the fitted rates say: clean ones once or more, those over their domain's share now and then."""
    labelled = mixing.domains_of_labels(table(spark, sf_dir, "labels"))
    return mixing.apply_copies(docs, mixing.mix(docs, labelled, **MIX)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece with its place in a sequence of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]
#: Trained and fitted stages have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
