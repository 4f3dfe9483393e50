"""Training-corpus pipeline: documents through five stages, each written and reread.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; all but the last return the columns of documents.

Cases: null and empty texts have too few words and go in the first stage; null
ids, languages and sources stay, a null source being a source of its own in
mixing; rows that repeat id and text count as one document and one of them
stays; of equal or near texts under several ids the least id stays; texts of any
length are read whole; extra columns are carried through all stages, but a
column ``shard`` is refused by the last; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import decontaminate, mixing, quality, sharding, simhash
from lorekeep.llm.common import table
from lorekeep.scratch import delete, scope, shared_dir

SHARDS = 24


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class: the one of least doc_id."""
    return simhash.simhash_dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents, by Poisson counts at their source's rate, in a global random order."""
    return mixing.mix(docs, "source", alpha=0.5, epochs=1.0, seed=42)


def virtual_slot_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard of each row, by a map that is stored and read back."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing), ("virtual_slot_sharding", virtual_slot_sharding),
]

#: XXH64 fingerprints and the slot map have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/lorekeep/pipeline-{name}-{uuid.uuid4().hex}"
        with scope(spark):  # what a stage stages goes once its rows are written, as do its predecessor's rows
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete(spark, last)
        last = path
    return docs
