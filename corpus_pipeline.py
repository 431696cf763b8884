"""Quality rules, near-duplicates, mix and packing, one after another over ``documents``.

Each stage takes the whole of what the stage before kept, as written Parquet. Rejected documents go and the others
lose the lines above the limits; one document of each near-duplicate group stays, of the smallest id; the mix repeats
or drops documents, and the last stage returns the packed pieces.

Defined cases: a null, empty or wordless text fails the base rules, so it goes in the first stage; a null source is a
source of its own; rows that repeat an id are documents of their own unless their texts are similar; a null id counts
as the largest; columns beside id, text, source and n_chars pass through as they are, whatever their names; long texts
are taken whole; an empty table, or one of nulls only, gives no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scanlake.llm.common import scratch_path
from scanlake.llm.covering import near_copies
from scanlake.llm.mixing import mixed_documents
from scanlake.llm.packing import pack_documents
from scanlake.llm.quality import kept_documents
from scanlake.llm.simhash import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, groups=near_copies)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("simhash near-dedup", near_dedup), ("mixing to target weights", mix), ("best-fit packing", pack)]
#: Shingle hashes and the tokenizer are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(path := scratch_path(spark, f"stage{i}"))
            docs = spark.read.parquet(path)
    return docs
