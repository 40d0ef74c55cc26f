"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir) and returns a frame; all but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm import bpe, mixing, simhash, string_kernel, subword
from waybill.llm.common import free_name, held_out, stored, table
from waybill.llm.queries import GOOD_SCORE, VOCABULARY

LANG_SCORE = 0.3  # a text whose best language scores less is no text in a known language


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the quality classifier scores well."""
    model = subword.train(docs.filter(~held_out("doc_id", 4, 2)), table(spark, sf_dir, "labels"))
    score = free_name(docs.columns, "_score")
    scored = subword.score(docs, model, docs.columns, name=score)
    return scored.filter(F.col(score) >= GOOD_SCORE).drop(score)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that was learned."""
    model = string_kernel.train(docs.filter(~held_out("doc_id", 3, 1)))
    lang, score = free_name(docs.columns, "_lang"), free_name(docs.columns, "_score")
    found = string_kernel.predict(docs, model, docs.columns, names=(lang, score))
    known = (F.col(lang) != string_kernel.UNKNOWN) & (F.col(score) >= LANG_SCORE)
    return found.filter(known).drop(lang, score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash group."""
    return simhash.deduplicate(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents, some more than once, so that sources come near their target weights."""
    return mixing.take(docs, F.array("source"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, as digests, with the round trip back to text."""
    return bpe.round_trip_digests(docs, VOCABULARY).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", encoding),
]
# The stages train models and hash in ways that SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with written tables between them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
