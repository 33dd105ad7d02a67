"""From raw documents to packed sequences: five stages, each one operator over all that its predecessor kept.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and reread as the next one's ``docs``. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from halocline.llm.common import written
from halocline.llm.decontaminate import drop_contaminated
from halocline.llm.exact_dedup import drop_copies
from halocline.llm.packing import pack_documents
from halocline.llm.quality import keep_good, learn_field
from halocline.llm.queries import WORD_VOCABULARY
from halocline.llm.simhash import drop_near_duplicates


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores 0.7 or more."""
    return keep_good(docs, learn_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), threshold=0.7)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at 3 bits or fewer the document with the smallest id."""
    return drop_near_duplicates(docs, shingle=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), shingle=5, threshold=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of up to 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path(WORD_VOCABULARY), max_tokens=2048)


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: The classifier's fit and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder before the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
