"""A corpus pipeline over ``documents``: stages that keep, cut and pack, each on what the one before kept.

Every stage calls one operator of ``opsloom.llm`` and lets its decision take effect; all but the
last return the columns of their input.  A document that a stage drops is dropped by id
(rows of one id stay as long as one of them does).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm import fmindex, hyperminhash, linejoin, packing, ppm
from opsloom.llm.catalog import held_out
from opsloom.plans.storage import cut_lineage, shared_path

#: Bits a byte that no model of a language needs for its own texts: the cost of a byte that tells nothing.
UNKNOWN_BITS = 8.0


def _without(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """``docs`` without the ids for which no row of ``decided`` (``doc_id, stays``) stays."""
    gone = cut_lineage(decided.groupBy(F.col("doc_id").alias("_id")).agg(F.max("stays").alias("_stays")).where(~F.col("_stays")).select("_id"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]), "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, and texts that the best language's model codes no shorter than unknown bytes."""
    model = ppm.fit(docs.where(~held_out(F.col("doc_id"))))
    found = ppm.identify(docs, model)
    stays = (F.col("lang_pred") != "und") & (F.col("bits_per_byte") < UNKNOWN_BITS)
    return _without(docs, found.select("doc_id", F.coalesce(stays, F.lit(False)).alias("stays")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated lines, and drops documents that lose lines and keep none of which they are the first place."""
    cut = linejoin.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group."""
    found = hyperminhash.near_duplicates(docs)
    return _without(docs, found.select("doc_id", F.col("kept").alias("stays")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark phrase."""
    found = fmindex.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.select("doc_id", (F.size("spans") == 0).alias("stays")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of what is left into windows of 1024."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: Language models and token ids have no SQL; tests compare the rows with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
