"""A corpus pipeline: quality rules, line dedup, n-gram near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs; all but the last return the columns of documents, and carry further
columns along, whatever their names.

Defined results, by stage: null, empty and blank texts fail the quality rules; after that they would stay
through line dedup and near-duplicates, be mixed as texts without tokens and be encoded as no ids. A
null doc_id sorts first in line dedup, is never a near-duplicate, and is an id of its own elsewhere. Rows
that repeat a doc_id are one document to line dedup and near-duplicates, where they stay or go
together; equal rows are taken equally often by mixing. Very long texts are whole texts. An empty table
gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trowel.llm import line_dedup, mixing, ngram_join, piece_codec, quality
from trowel.session import stage_table


#: Weights of languages; domains and sources count alike.
WEIGHTS = {"language": {"en": 4.0, "fr": 2.0, "de": 2.0}}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their own rules and those that their source fails too often; see trowel.llm.quality for nulls and ties."""
    return quality.keep_good(docs, domain="source")


def line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without chunks of lines that occur earlier in the corpus; n_chars follows the text."""
    fixed = line_dedup.drop_repeated_chunks(docs)
    return fixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the lowest, of each group of linked documents; five-word shingles, similarity 0.8."""
    groups = ngram_join.link_components(docs, width=5, percent=80)
    gone = groups.where("component_id <> doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share of the token budget takes them: copies are rows."""
    return mixing.mix(docs, ratio=1.0, max_epochs=2, seed=mixing.SEED, weights=WEIGHTS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return piece_codec.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_chunks),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing_sources),
    ("SentencePiece encoding and decoding", encoding),
]

#: SQL has no PartEnum components over whole tables in reasonable time, and no SentencePiece: tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(spark, stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
