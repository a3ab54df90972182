"""A corpus pipeline: quality rules, near-duplicate removal, secret redaction, source mixing and packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; each result is stored and read again before
the next stage. All but the last return the columns of ``documents``. No stage is expressible in SQL as a whole, so there is
no ORACLE_SQL; tests hold run() against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestack.llm.common import table
from lodestack.llm.mixing import apply_mix
from lodestack.llm.neardup import keep_one
from lodestack.llm.packing import pack_documents
from lodestack.llm.quality import keep_good
from lodestack.llm.queries import tokenizer_files
from lodestack.llm.secrets import redact
from lodestack.storage import materialize, ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the fitted thresholds reject go."""
    return keep_good(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    ship(spark)
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and linked credentials are replaced in the texts; no document goes."""
    ship(spark)
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until every source has its target of words."""
    ship(spark)
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place in it."""
    ship(spark)
    return pack_documents(docs, *tokenizer_files())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
