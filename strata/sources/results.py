"""Results and their provenance, cached tables, frozen outputs, and small tables as Markdown or HTML."""

from __future__ import annotations

import html
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Rows that a report table may have; more belongs in a file.
MOST_SHOWN = 10_000
_SUMMARY = "table string, rows long, config string, revision string, written timestamp"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_result(df: DataFrame, folder: str, name: str, config: str = "", revision: str = "") -> None:
    """Write ``df`` as Parquet to folder/name, and its provenance to folder/summary.

    The summary is partitioned by table, and only this table's partition is replaced, so other tables keep their rows and revisions.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    rows = spark.read.parquet(f"{folder}/{name}").count()
    note = spark.createDataFrame([(name, rows, config, revision)], "table string, rows long, config string, revision string").withColumn("written", F.current_timestamp())
    note.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("table").parquet(f"{folder}/summary")


def read_summary(spark: SparkSession, folder: str) -> DataFrame:
    """(table, rows, config, revision, written), one row a table; empty where nothing was written."""
    if not exists(spark, f"{folder}/summary"):
        return spark.createDataFrame([], _SUMMARY)
    return spark.read.schema(_SUMMARY).parquet(f"{folder}/summary").select("table", "rows", "config", "revision", "written")


def write_once(df: DataFrame, path: str) -> None:
    """Write Parquet to a path that must not exist yet, so that what was frozen stays."""
    try:
        df.write.mode("errorifexists").parquet(path)
    except AnalysisException as e:
        raise FileExistsError(f"{path} is frozen; delete it first to draw it anew") from e


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; made and written first if it is not there."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _cells(df: DataFrame, order: list[str]) -> tuple[list[str], list[list[str]]]:
    rows = df.orderBy(*order).limit(MOST_SHOWN + 1).collect() if order else df.limit(MOST_SHOWN + 1).collect()
    if len(rows) > MOST_SHOWN:
        raise ValueError(f"a report shows {MOST_SHOWN} rows at most")
    show = lambda x: "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x)
    return df.columns, [[show(x) for x in r] for r in rows]


def to_markdown(df: DataFrame, *order: str) -> str:
    """A small table as Markdown, in the order of these columns; nulls are empty, bars are escaped."""
    names, rows = _cells(df, list(order))
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    return "\n".join([line(names), "|" + " --- |" * len(names), *map(line, rows)])


def to_html(title: str, tables: dict[str, DataFrame], order: dict[str, list[str]] | None = None) -> str:
    """A page with a heading and a table for each of the small tables."""
    parts = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        names, rows = _cells(df, (order or {}).get(name, []))
        row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</tr>"
        parts += [f"<h2>{html.escape(name)}</h2><table>", row(names, "th"), *[row(r, "td") for r in rows], "</table>"]
    return "\n".join(parts)


def load_config(path: str, roots: dict[str, str]) -> dict:
    """A YAML file as a dictionary. Values under the keys of ``roots`` that are relative paths are taken from there."""
    import os

    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f) or {}
    for key, root in roots.items():
        if isinstance(found.get(key), str) and not os.path.isabs(found[key]):
            found[key] = os.path.normpath(os.path.join(root, found[key]))
    return found
