"""Corpus pipeline over `documents`.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All stages but the last return the columns of `documents`.

A toxic document goes, one document of each near-duplicate component stays (the one with the smallest doc_id), documents
that hold a benchmark item go, personal data is masked (n_chars follows the text), and what is left is packed into
sequences with its token ids.

Defined cases: null and empty texts pass (one of them stays, as all have fingerprint zero) and are packed as the end id alone;
rows without a doc_id pass the near-duplicate stage; repeated rows are one document there, as are rows that share a doc_id;
texts of any length are read whole; an empty table stays empty; extra columns, whatever their names, are returned as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathlake.llm import decontaminate, packing, pii, simhash, toxicity
from mathlake.llm.common import discard, materialise, table
from mathlake.llm.tokens import SMALL_MEMO


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents among docs; rejects documents with a score of at least the threshold."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component: its smallest doc_id, and one row where doc_ids repeat.

    Components are op3's: three-word shingles, at most 3 bits apart. Copies with more edits than that stay (README).
    """
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold 0.8 of the five-word shingles of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every span; documents stay."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece, with its token ids and its place."""
    return packing.pack(docs, keep_ids=True, memo=SMALL_MEMO)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]
#: Tokenizer, model and pattern scores have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
