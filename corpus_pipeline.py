"""A training-data pipeline over ``documents``: each stage calls one corpus operator and works on what the one before kept.

In every stage null texts are empty: the first rejects them, as no language can be told. Repeated rows are rows each, until
the second keeps one of each group, the smallest doc_id and of equal rows one. Texts are read whole, however long. Ties are
the operators': the first language by name, the smallest doc_id. Empty tables give empty results. Filtering stages hand on all columns
of their input, whatever they are called; only doc_id, text, lang and n_chars are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import common, decontaminate, langid, neardup, packing, pii
from strata.llm.queries import tokenizer_path

#: A document whose language is undetermined, or less likely than this, is rejected.
LEAST_SCORE = 0.5


def _src(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("src")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language the classifier, learned from the stage's labelled rows, can tell."""
    model = langid.train(docs, F.lit(True))
    scored = langid.identify(docs.select(_src(docs), "text"), model, ["src"])
    return scored.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("src.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group whose five-word shingles have a similarity of at least 0.8; texts without words are linked with none."""
    found = neardup.near_duplicates(docs, shingle=5, percent=80)
    return found.where("first").select("src.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that leak an item of the benchmark."""
    found = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("key").distinct()
    keyed = docs.select(_src(docs), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"))
    return keyed.join(found, "key", "left_anti").select("src.*")


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars follows the text."""
    found = pii.find(docs, docs.columns)
    text = pii.redact(F.col("src.text"), F.col("spans"))
    columns = [{"text": text, "n_chars": F.char_length(text).cast("long")}.get(c, F.col(f"src.`{c}`")).alias(c) for c in docs.columns]
    return found.select(*columns)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 tokens."""
    # executors that have run four stages have less memory to spare, so workers keep fewer words
    return packing.pack_documents(docs, tokenizer_path(), end_id=1, cached_words=50_000)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("packing", best_fit),
]
#: SQL can express neither the classifier nor the packing; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return docs
