"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import null_for_nan


def write_table(df: DataFrame, path: str, form: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if form == "csv":
        writer = writer.option("header", True)
    writer.format(form).save(path)


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON text; NaN and infinity are written as null, absent values kept."""
    clean = null_for_nan(df)
    return clean.select(F.to_json(F.struct(*clean.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    null_for_nan(df).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_category_summary(summary: DataFrame, features: DataFrame, folder: str, run_id: str,
                           mode: str = "errorifexists") -> None:
    """Two outputs of a per-category index run: one row per category, one row per feature."""
    for frame, name in ((summary, "summary"), (features, "features")):
        frame.withColumn("run_id", F.lit(run_id)).write.mode(mode).parquet(f"{folder}/{name}")
