"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet, in files
of a size worth having, and read again as the next stage's docs. All but the last keep the columns of documents.

Rejected by the quality classifier, a document goes; of rows linked by shingle similarity one with the
smallest doc_id stays, a null counting as the largest (those alone stay too); bytes that repeat an
earlier 100-byte string are cut, code points whole, and documents of which nothing but white space is
left go; contaminated documents go, and from others the words of benchmark windows are cut; the rest is
packed.

Cases, for every stage: a null or empty text is a document like others, scored, linked with nothing,
uncut, and packed as its end id alone (the suffix stage drops what it leaves blank, not what came so);
rows without or with a repeated doc_id are rows of their own; ties keep the smallest doc_id; texts of any
length are taken whole; columns with names that operators use are kept; empty tables give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import fm_decontam, jaccard_join, pattern_packing, quality_rules, suffix_dedup
from seriesloom.llm._arrays import checkpoint_dir, file_count, fresh
from seriesloom.llm.queries import tokenizer_path


def veiled(docs: DataFrame) -> DataFrame:
    """docs with names of our own for all columns but doc_id and text, so that none meets an operator's."""
    return docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")])


def unveiled(df: DataFrame, docs: DataFrame, **replaced: Column) -> DataFrame:
    """df with the columns of docs under their own names, but for replaced ones."""
    return df.select(*[(replaced[c] if c in replaced else F.col(c if c in ("doc_id", "text") else f"__c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def recounted(docs: DataFrame, changed: Column) -> dict[str, Column]:
    """The column n_chars, where docs has one, of texts that a stage has changed."""
    if "n_chars" not in docs.columns:
        return {}
    own = F.col(f"__c{docs.columns.index('n_chars')}")
    return {"n_chars": F.when(changed, F.length("text")).otherwise(own).cast(docs.schema["n_chars"].dataType)}


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return kept.coalesce(file_count(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/keyed-{uuid.uuid4().hex}"  # a key that is drawn anew could name another row
    key = fresh(docs.columns, "__key")
    docs.withColumn(key, F.monotonically_increasing_id()).coalesce(file_count(docs)).write.parquet(folder)
    keyed = spark.read.parquet(folder)
    linked = jaccard_join.link(keyed, id_col=key).select(F.col("doc_id").alias(key), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", key))
    kept = keyed.select(key, "doc_id").join(linked, key).groupBy("component_id").agg(first.alias("x")).select(F.col("x").getField(key).alias(key))
    return keyed.join(kept, key, "left_semi").select(*docs.columns).coalesce(file_count(docs))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.trim(veiled(docs), with_text=True)
    left = cut.where((F.col("n_removed") == 0) | F.col("text").rlike("\\S"))
    return unveiled(left, docs, **recounted(docs, F.col("n_removed") > 0)).coalesce(file_count(docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = fm_decontam.scan(veiled(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), cut=True)
    return unveiled(judged.where(~F.col("contaminated")), docs, **recounted(docs, F.col("n_hit") > 0)).coalesce(file_count(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pattern_packing.pack(docs, tokenizer_path(), end_id=1, capacity=4096)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
