"""The corpus pipeline: language ID, near-duplicates, benchmark passages, source mix and shards, each over all that is left.

Each stage is written as Parquet in the shared folder and read again; what it needed itself is deleted then, as is the stage
before it. The last stage is lazy, so the one before it and its own tables stay until `common.removed` or the folder's owner
takes them.

Defined cases, by stage: null, empty and wordless texts have no language and go at `language`, as do texts of uncertain
language; without any label all go. Rows without id are kept like others, and learned from. Of rows with near equal texts
(repeated rows and exact copies among them) one stays at `near_duplicates`, the one with the least id. Ties, null ids and null
sources at the later stages are as the operators state. Columns of any name beside doc_id, text, lang and source are carried
through, and those named like the last stage's (size, text_crc32, law, shard, slot) are replaced by it. Empty tables give
empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.llm import decontam, langid, mixing, near, sharding
from harborlight.llm.common import removed, scratch, shared_folder, table

SHARDS = 40


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is certain; learns from the labels of what it gets."""
    learned = docs.where(~F.coalesce(langid.held_out(docs["doc_id"]), F.lit(False)))
    content = langid.dictionaries(learned.select("doc_id", "text", "lang"))
    wrapped = docs.select(F.struct(*docs.columns).alias("_doc"), "text")
    return langid.identified(wrapped, content, ["_doc"]).where("accepted").select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five-word shingles of a Jaccard similarity of 0.8 or more."""
    return near.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark passage."""
    return decontam.cleaned(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds size, text_crc32, law, shard and slot."""
    return sharding.sharded(docs, SHARDS)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shards),
]

#: Hashes of seeds and fingerprints, compression and refined splitters have no SQL; tests compare with brute force.
ORACLE_SQL = None


def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All stages over docs."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            removed(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, table(spark, sf_dir, "documents"), sf_dir)
