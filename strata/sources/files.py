"""File codecs: wide embedding CSV, id lists and JSON lines, read and written in parallel by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_embeddings(df: DataFrame, path: str, name: str, vector: str, width: int) -> None:
    """CSV with the columns filename, z1 .. z``width``, six significant digits. A null vector is written as empty fields."""
    digits = [F.format_string("%.6g", F.get(vector, F.lit(i)).cast("double")) for i in range(width)]
    columns = [F.when(F.col(vector).isNotNull(), d).alias(f"z{i + 1}") for i, d in enumerate(digits)]
    df.select(F.col(name).cast("string").alias("filename"), *columns).write.option("header", True).csv(path)


def read_embeddings(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(filename, v array<float>) of such a CSV; a row with an empty field has a null vector."""
    fields = [f"z{i + 1}" for i in range(width)]
    schema = T.StructType([T.StructField("filename", T.StringType()), *[T.StructField(f, T.FloatType()) for f in fields]])
    rows = spark.read.schema(schema).option("header", True).csv(path)
    vector = F.array(*fields)
    return rows.select("filename", F.when(~F.exists(vector, lambda x: x.isNull()), vector).alias("v"))


def write_ids(df: DataFrame, path: str, name: str) -> None:
    """Text, one id a line; null ids are left out."""
    df.where(F.col(name).isNotNull()).select(F.col(name).cast("string").alias("value")).write.text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id string) of such a list, without blank lines and outer blanks; repeated ids stay."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are written, so columns survive."""
    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines under a stated schema; without one Spark would read the files twice."""
    return spark.read.schema(schema).json(path)
