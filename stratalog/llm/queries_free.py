"""Queries of the operators that run Python on Arrow batches, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import classifier, lattice, licenses, pieces, secrets, simhash
from stratalog.llm.common import table


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def of_kind(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def place(kind):
        return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, secrets.KINDS)), kind), F.lit(0)), F.lit(99))

    rank = F.transform(F.concat("base", "more"), lambda s: F.struct(s["start"].alias("start"), place(s["kind"]).alias("place"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.select("doc_id", *map(of_kind, secrets.KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(rank)).alias("spans"))


#: The vocabulary file; another place is a parameter of the operators.
PIECES_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids of the whole text, and whether they decode to it."""
    found = pieces.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces.load(PIECES_MODEL))
    return found.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "ids", "exact")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    own, base = F.col("found.label"), F.col("places.label")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"),
        F.coalesce(F.greatest(F.array_max("found.confidence"), F.when(F.size("places") > 0, F.lit(1.0))), F.lit(0.0)).alias("score"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifier.train(docs, table(spark, sf_dir, "labels"), where=lambda key: ~classifier.held_out(key))
    scored = classifier.score_documents(docs, model, carry=["doc_id"])
    return scored.select("doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lattice.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumnRenamed("component", "component_id")


QUERIES = {"op2_lattice": op2_lattice, "op6_quality": op6_quality, "op9_licenses": op9_licenses, "op1_sentencepiece": op1_sentencepiece, "op7_simhash": op7_simhash, "op10_secrets": op10_secrets}
SQL: dict[str, str] = {}
