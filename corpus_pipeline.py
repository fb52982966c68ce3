"""Corpus pipeline: documents through the stages below, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns of ``documents``; the
last adds ``ids``, ``n_tokens`` and ``decoded``, with underscores before a name that the table has already.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabfid.llm import decontaminate, minhash, pieces, secrets
from tabfid.llm.common import fresh, shared_table, table
from tabfid.llm.quality_rules import quality_filter


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the adaptive cutoffs."""
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near duplicates."""
    return minhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced and n_chars counted anew where one was."""
    (was,) = fresh(docs, "was")
    out = secrets.redacted(docs.withColumn(was, F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col(was))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(
        *docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the ids of their whole texts, their number, and the text decoded from them."""
    names = [n if n not in {c.lower() for c in docs.columns} else fresh(docs, n)[0] for n in ("ids", "n_tokens", "decoded")]
    ids, n_tokens, decoded = names
    out = pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=ids, back=decoded)
    return out.select(*docs.columns, ids, F.size(ids).cast("long").alias(n_tokens), decoded)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("secret_scan", secret_scan), ("sentencepiece", sentencepiece)]

#: Near duplicates, secrets by lexing and SentencePiece have no SQL form; tests hold run() against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
