"""The corpus pipeline: quality, near copies, secrets, source mix, and pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the columns
of documents. run() writes each stage's rows as Parquet to the session's shared folder and reads them again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import classifier, mixing, pieces, secrets, simhash
from stratalog.llm.common import fresh
from stratalog.llm.queries_free import PIECES_MODEL
from stratalog.sources.store import remove, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more. It learns from the labelled documents of the folder, held-out ones too."""
    model = classifier.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = fresh(docs, "quality_score")
    return classifier.score_documents(docs, model, name=score).where(F.col(score) >= 0.3).drop(score)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by five words and a similarity of 0.8."""
    return simhash.drop_near_copies(docs)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret that was found replaced by a mark."""
    return secrets.redact_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the sources' target weights takes them."""
    return mixing.mix(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids and exact of every row."""
    encoded = pieces.encode_documents(docs.select("doc_id", "text"), pieces.load(PIECES_MODEL))
    return encoded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "ids", "exact")


STAGES = [("quality", quality), ("near_copies", near_copies), ("no_secrets", no_secrets), ("source_mix", source_mix), ("piece_ids", piece_ids)]
#: The classifier, the sketches and the pieces have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table goes to the shared folder, and is removed when the next one is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
