"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. Stages 1 to 4 return rows of ``docs`` with all its columns: texts that
are predicted toxic go, of equal texts one stays, of near copies one stays, and
a document that holds a benchmark window goes. The last stage returns, per
document, digests of its token ids and of the bytes decoded from them.

Defined results, for every stage: null texts count as empty; rows are kept or
dropped each, whether or not their ids repeat or are null (of equal texts and of
near copies exactly one row stays, also where all of them have no id); an empty
table gives an empty table; other columns pass through, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from notelake.llm import byte_bpe, decontaminate, exact_dedup, simhash, toxicity
from notelake.llm.common import keep

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text is predicted toxic; with no toxic training label, or no label at all, every row stays."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space keeps the longest, of those the smallest id; all empty texts are equal."""
    return exact_dedup.drop_copies(docs, exact_dedup.dedup(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose fingerprints are linked keeps the one of the smallest id; empty texts have fingerprint zero."""
    return simhash.drop_near_copies(docs, simhash.near_groups(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold any benchmark window; an empty benchmark drops none."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; an empty text has no tokens."""
    return byte_bpe.digests(byte_bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("byte_level_bpe", encoding_stage),
]

#: No SQL expresses the learned first stage; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again for the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
