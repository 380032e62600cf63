"""Corpus pipeline: five stages, each on all that the one before it kept.

Nulls, empty and repeated rows are treated as the operators' docstrings say: null texts
are empty texts; without labels no document is toxic; of equal rows one stays after the
near-copy stage; empty tables give empty results.  Columns beside doc_id, text and
n_chars travel through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwell.llm import decontaminate, line_dedup, near_copies, sentencepieces, simhash, toxicity
from stepwell.llm.common import materialise, read
from stepwell.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject; null ids are never labelled."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of runs of three lines or 50 words; a document that loses every line goes.

    The first copy is that of the least doc_id, a null one last.
    """
    out = line_dedup.rewrite(docs, min_words=50)
    emptied = (out[out.columns[-1]] > 0) & ~F.col("text").rlike(line_dedup.INK)
    text = out.filter(~emptied).withColumn("n_chars", F.length("text").cast("long"))
    return text.select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at Jaccard 0.8 of five-word shingles: the least doc_id.

    SimHash fingerprints give the first pairs, a join the links that are out of their reach.
    Rows without an id go if they are linked to one with an id, else they stay.
    """
    return simhash.keep_one(docs, near_copies.near_copies)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece counts and checksums, and the texts decoded from the pieces."""
    out = sentencepieces.encode_decode(docs, tokenizer_file("piece_bpe_32k.model"))
    return out.select("doc_id", "n_pieces", "ids_crc32", F.col("decoded").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: The classifier and the pieces are beyond SQL; tests/llm hold every stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
