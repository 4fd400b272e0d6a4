"""A corpus from raw documents to packed training sequences, in stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps. ``run``
writes every stage's rows as Parquet to the shared folder and reads them again
for the next, so that a lost executor costs one stage at most. What a stage wrote
on its way, and the rows before it, go once its own rows are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import decontaminate, jaccard, lines, packing, quality
from tallyloom.storage import remove, scratch, shared_path


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks that an earlier document has; n_chars follows. Emptied documents go."""
    return lines.distinct_text(docs)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return jaccard.deduplicated(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    packed = packing.pack_documents(docs.select("doc_id", "text"), ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", _quality),
    ("line dedup", _lines),
    ("n-gram Jaccard join", _near_duplicates),
    ("benchmark decontamination", _decontaminate),
    ("best-fit packing", _pack),
]

#: SQL can't express the classifier, the alignment or the tokenizer; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, "stage-" + name.replace(" ", "-"))
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
