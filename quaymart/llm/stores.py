"""Small shared helpers of the operators in this package."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import delete_folder, scratch_folder

_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()

HOT_SHARE = 10_000   # a key with at least this part of the rows is hot, so there are at most as many hot keys


def stored(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and no executor's loss costs it."""
    folder = scratch_folder(df.sparkSession)
    df.write.options(**options).parquet(folder)
    out = df.sparkSession.read.parquet(folder)
    _folders[out] = folder
    return out


def ended(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` made and nothing reads any more; the handle itself, not a frame made from it, says which."""
    for table in tables:
        delete_folder(table.sparkSession, _folders.pop(table))


def text_key(text: str) -> Column:
    """Sixteen bytes that stand for a text; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names like the wanted ones that do not clash with those of the input."""
    lower, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in lower:
            name = f"_{name}"
        lower.add(name.lower())
        out.append(name)
    return out


def attach(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row a key, or nulls: a left join without hot tasks.

    Facts of hot keys, at most ``HOT_SHARE`` rows, go out by broadcast; rows that found theirs so, and rows without a key,
    are spread over the tasks of the join with the other facts. ``rows`` is read twice, so it should be stored.
    """
    others = [c for c in facts.columns if c != key]
    n, hot, cold, spread = free_names([*rows.columns, *facts.columns], "_n", "_hot", "_cold", "_spread")
    counted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(n))
    used = stored(facts.join(counted, key))
    total = used.agg(F.sum(n)).first()[0] or 0
    few = used.where(F.col(n) * HOT_SHARE >= total).select(key, F.struct(*others).alias(hot))
    rest = used.where(F.col(n) * HOT_SHARE < total).select(key, F.lit(0).cast("bigint").alias(spread), F.struct(*others).alias(cold))
    looks = F.col(hot).isNull() & F.col(key).isNotNull()
    held = rows.join(F.broadcast(few), key, "left") \
        .withColumn(spread, F.when(looks, F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(HOT_SHARE))))
    both = held.join(rest, [key, spread], "left")
    return both.select(*rows.columns, *[F.coalesce(F.col(hot)[c], F.col(cold)[c]).alias(c) for c in others])
