"""Category encoding."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import encoded_names

# Texts that count as a missing category.
MISSING_TEXTS = ["", "nan", "none", "null"]


def _tidy(column: str):
    text = F.trim(F.coalesce(F.col(column).cast("string"), F.lit("Missing")))
    return F.when(text.isin(MISSING_TEXTS), F.lit("Missing")).otherwise(text)


@dataclass(frozen=True)
class OneHot:
    """Encoded column -> (base column, category); the most frequent categories per base column."""
    mapping: dict[str, tuple[str, str]] = field(default_factory=dict)
    top: dict[str, list[str]] = field(default_factory=dict)

    def table(self, spark) -> DataFrame:
        rows = [(e, b, c, i + 1) for i, (e, (b, c)) in enumerate(self.mapping.items())]
        return spark.createDataFrame(rows, "encoded string, base string, category string, place int")


def category_counts(df: DataFrame, columns: Sequence[str], limit: int = 6) -> dict[str, list[str]]:
    """Most frequent categories of every column from one pass; ties by name.

    Counts are folded by (column, category) before ranking. Only ``limit`` names per column reach
    the driver, because they become column names. A category column may have many values, so the
    ranking keeps ``limit`` per group of hashes first.
    """
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(c).alias("column"), _tidy(c).alias("category")) for c in columns])
    counts = df.select(F.inline(cells)).groupBy("column", "category").agg(F.count("*").alias("n"))
    order = [F.desc("n"), F.asc("category")]
    part = F.pmod(F.hash("category"), F.lit(256))
    local = counts.withColumn("_h", part).withColumn("_r", F.row_number().over(Window.partitionBy("column", "_h").orderBy(*order)))
    best = local.where(F.col("_r") <= limit).withColumn("_r", F.row_number().over(Window.partitionBy("column").orderBy(*order)))
    found = best.where(F.col("_r") <= limit).orderBy("column", "_r").collect()
    out: dict[str, list[str]] = {c: [] for c in columns}
    for row in found:
        out[row["column"]].append(row["category"])
    return out


def one_hot(df: DataFrame, columns: Sequence[str], top_n: int = 5) -> tuple[DataFrame, OneHot]:
    """Indicator columns of the most frequent categories and one for all others."""
    ranked = category_counts(df, columns, top_n + 1)
    mapping, top, added = {}, {}, {}
    for c in columns:
        leading, more = ranked[c][:top_n], len(ranked[c]) > top_n
        names = encoded_names(c, [*leading, *(["Others"] if more and "Others" not in leading else [])])
        for category, name in names.items():
            hit = _tidy(c) == category
            if category == "Others" and more:
                hit = ~_tidy(c).isin([x for x in leading if x != "Others"])
            added[name] = hit.cast("int")
            mapping[name] = (c, category)
        top[c] = leading
    out = df.withColumns(added) if added else df
    return out.drop(*columns), OneHot(mapping, top)


def coded_or_one_hot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with two or more than ten values become codes by sorted value, those with three to
    nine indicator columns. A column with exactly ten values is left as it is."""
    from .columns import ordinal_codes

    sizes = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in columns], *[F.max(F.col(c).isNull().cast("int")).alias(f"_null_{c}") for c in columns]).first()
    out = df
    for c in columns:
        size = sizes[c] + (sizes[f"_null_{c}"] or 0)
        if size == 2 or size > 10:
            out = ordinal_codes(out, {c: f"_code_{c}"}).drop(c).withColumnRenamed(f"_code_{c}", c)
        elif 3 <= size < 10:
            out, _ = one_hot(out, [c])
    return out
