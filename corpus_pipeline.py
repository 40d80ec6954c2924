"""The corpus pipeline: five stages over ``documents``, each one of the library's operators.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it
kept. All but the last return the columns of ``documents``; a stage's result is
written as Parquet in the shared folder and read again as the next one's input.

1. quality: a compression classifier, fitted on the labelled documents, drops what it rejects;
2. near duplicates: of each group of similar documents, one stays;
3. decontamination: documents with a passage of the benchmark go;
4. mixing: documents are repeated or left out until every source has its target weight;
5. token records: texts become length-delimited binary records with an offset index.

Nulls, empty and repeated rows, extra columns and empty tables are handled as the
operators state; an empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loopweave.llm import (compression_quality, decontamination, mixing, near_duplicates,
                           token_records)
from loopweave.session import staged

#: None: a trained compressor, MinHash and drawn roundings have no SQL counterpart.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return compression_quality.keep_good(docs, compression_quality.fit(docs, labels))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.deduplicate(docs, unnamed_stay=False)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_records.tokenized(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near duplicates", near_duplicate_groups),
          ("decontamination", benchmark_decontamination), ("mixing", source_mix),
          ("token records", token_output)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: doc_id, start, n_tokens, ids_crc32 of every record."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
