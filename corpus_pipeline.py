"""Training-data pipeline: toxicity, exact dedup, near dedup, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame.  All but
the last return the columns of documents; each works on all rows that its
predecessor kept.  :func:`run` writes every stage's rows as Parquet under the
checkpoint folder and reads them again for the next stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import free_name, prepare, table, tokenizer_path
from tagweave.llm.decontaminate import decontaminate
from tagweave.llm.exact_dedup import drop_copies
from tagweave.llm.jaccard_join import drop_near_duplicates
from tagweave.llm.packing import pack_documents
from tagweave.llm.toxicity import THRESHOLD, crc_fold, fit, score
from tagweave.session import ensure_checkpoint_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below the threshold."""
    model = fit(docs, table(spark, sf_dir, "labels"), crc_fold("doc_id", 3) != 1)
    name = free_name(docs, "__toxicity")
    return score(docs, model, name=name).filter(F.col(name) < THRESHOLD).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of documents linked by Jaccard similarity."""
    return drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", benchmark),
    ("packing", packing),
]

#: Stages 1 and 5 (a fitted model, a tokenizer) have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{base}/{name}"
        kept = stage(spark, docs, sf_dir)
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return docs
