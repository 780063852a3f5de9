"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing sources, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents: the first leaves out rejected documents, the second takes repeated
runs of lines out of the texts (a document whose lines all repeat stays with what is left), the third leaves one document of
each group of near-duplicates, the fourth puts files and rows in the order of the mix, the last returns the pieces of the
packed sequences. Sequences are numbered in the order of the mix, up to the documents that are packed together at a time
(1024, and what the ones before left over). An empty table passes through all of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.line_dedup import drop_repeated_lines
from tessera.llm.mixing import in_mixed_order
from tessera.llm.packing import pack_documents
from tessera.llm.quality_rules import drop_low_quality
from tessera.llm.queries import table, vocabulary
from tessera.llm.simhash import drop_near_duplicates
from tessera.llm.spread import as_written, shared_folder
from tessera.session import ship_package


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(docs).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return in_mixed_order(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # tasks read files in any order, so rows go back into the order in which the mixing stage has written them; sequence_id follows it
    written = as_written(docs)
    return pack_documents(in_mixed_order(docs) if written is None else written, vocabulary())


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the stages; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(ship_package(spark), sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
    return docs
