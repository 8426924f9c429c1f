"""The corpus operators as registered queries over the driver's tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, langid, lmscore, manifest_sql, merkle, neardup, packing, pii, quarantine, secrets, suffixes, tokens, urls, vectors


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "tokens")
    tokens.write_tokens(_docs(spark, sf_dir), path, tokenizer_path(), end_id=2)
    return tokens.read_documents(spark, path)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(_docs(spark, sf_dir).select("doc_id", "text"), shingle=2, percent=80)
    return found.select(F.col("src.doc_id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "at", "matched", "window")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    held_out = common.crc_mod("doc_id", 3) == 1
    model = langid.train(docs, ~held_out)
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model, ["doc_id", "held_out"])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_docs(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_docs(spark, sf_dir), ["doc_id"])
    counts = [pii.count_kind(F.col("base"), k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS[:4])]
    return found.select(F.col("src.doc_id").alias("doc_id"), *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


#: Fixed values of the contract: verdict, host, path.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_docs(spark, sf_dir), tokenizer_path(), end_id=1)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    held_out = common.crc_mod("doc_id", 7) == 2
    return lmscore.score(docs.select("doc_id", "text", held_out.alias("held_out")), ~held_out, ["doc_id", "held_out"])


def op11_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine.replay(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_docs(spark, sf_dir))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(_docs(spark, sf_dir), ["doc_id"])
    counts = [pii.count_kind(F.col("base"), k).alias(f"n_{kind}") for k, kind in enumerate(secrets.KINDS[:3])]
    base, spans = pii.written(F.col("base"), secrets.KINDS), pii.written(F.col("spans"), secrets.KINDS)
    return found.select(F.col("src.doc_id").alias("doc_id"), *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_output": op1_token_output,
        "op2_minhash": op2_minhash,
        "op3_decontamination": op3_decontamination,
        "op4_language_id": op4_language_id,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_pii": op6_pii,
        "op7_url_filter": op7_url_filter,
        "op8_top_k": op8_top_k,
        "op9_packing": op9_packing,
        "op10_lm_score": op10_lm_score,
        "op11_quarantine": op11_quarantine,
        "op12_merkle": op12_merkle,
        "op13_secrets": op13_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return dict(manifest_sql.SQL)
