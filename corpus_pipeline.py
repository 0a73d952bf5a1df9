"""The corpus pipeline: documents through five stages, and the registration of the corpus queries.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back as
the next stage's documents. All stages but the last return the columns of ``documents``. Within a stage,
null and empty texts, repeated rows and empty tables behave as the operator's docstring says.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import foliolake
from foliolake.llm import decontamination, line_dedup, near_dedup, quality_rules, spm_sampling
from foliolake.llm.common import shared_folder, table
from foliolake.llm.queries import QUERIES, SQL

# Functions sent to Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(foliolake)


#: Bytes of text that the last stage works on at once. Executors have run four stages before it, so it takes less than op1.
SLICE = 1 << 16
LATTICE = 1 << 17


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return quality_rules.kept_documents(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated runs of three lines, or of fewer with 50 words; one without lines left goes."""
    return line_dedup.deduplicated(docs, words=line_dedup.LONG)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near duplicates (five-word Jaccard of 0.8 or more).

    Candidates come from SimHash fingerprints over vantage points, as in op5, and from MinHash bands.
    """
    return near_dedup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of the documents that are left, with their inclusion scores."""
    return spm_sampling.sampled(docs, slice_bytes=SLICE, lattice_bytes=LATTICE)


STAGES = [
    ("quality rules", quality_rules_stage),
    ("line dedup", line_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("sentencepiece encoding", encoding_stage),
]

#: SQL has no seeded search over a lattice; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; intermediate tables go to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries():
    return QUERIES | {"pipeline": run}


def oracle_sql():
    return SQL | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
