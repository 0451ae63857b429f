"""From raw documents to packed training sequences: quality, near duplicates, secrets, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, ngram_join, packing, quality, queries, secret_scan
from tidemark.llm.common import delete_folder, new_folder

#: SQL cannot express the stages; the tests hold them against brute-force versions.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' label model keeps.

    Null and empty texts have no words and go; repeated rows share their fate; long texts are taken whole; all columns pass; an empty table stays empty.
    """
    return quality.kept_rows(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest doc_id.

    Null and empty texts are like no other and stay; of rows that share a doc_id the first by text stays; rows with a null doc_id stay; all columns pass; an empty table stays empty.
    """
    return ngram_join.one_of_each(docs, width=5, percent=80)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced; n_chars follows.

    Null texts stay null with their n_chars; all other columns pass; repeated rows stay; an empty table stays empty.
    """
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(out.schema["n_chars"].dataType))) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: exponential keys scaled by the weights of their quality labels.

    Weights come from labels, as op5's do: stages pass on the columns of documents only, so the quality stage's posterior can't reach this one.
    Null and empty texts have no words and go; a null source is a source of its own; a document's copies are equal rows; an empty table stays empty.
    """
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", "source", "text")
    rows = mixing.quality_weights(rows, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    mixed = mixing.mix(rows, weight=F.col("mix_weight"), weights=queries.MIX_WEIGHTS, max_epochs=queries.MIX_EPOCHS).where("mix_copies > 0")
    return mixed.select("doc", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select("doc.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens.

    Null and empty texts are pieces of one id; repeated rows and null doc_ids are pieces like any other; an empty table gives an empty table.
    """
    return packing.pack_documents(docs, queries.tokenizer_path(), limit=4096, end_id=1)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_join", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("source_mix", mixing_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again; what a stage has read is deleted.

    What stages do with nulls, empty and long texts, repeated rows and empty tables stands with each.
    """
    folder = new_folder(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last is not None:
            delete_folder(spark, last)
        last = path
    return docs
