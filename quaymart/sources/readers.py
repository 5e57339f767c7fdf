"""Scans. Schemas are given or come from the file footer; data is never sampled to guess types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed values, in the order in which they are tried.
DELIMITERS = (",", ";", "\t", "|")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pruned(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the listed columns that exist; Catalyst carries the projection into the scan."""
    present = [c for c in columns if c in df.columns]
    return df.select(*present)


def header_delimiter(line: str) -> str:
    """Comma unless the header would collapse into one column and another delimiter splits it."""
    if "," in line:
        return ","
    return max(DELIMITERS[1:], key=line.count) if any(d in line for d in DELIMITERS[1:]) else ","


# The Windows code page differs from Latin-1 in these characters only; five of its codes are unused.
_CODE_PAGE = {chr(i): bytes([i]).decode("cp1252", "ignore") for i in range(0x80, 0xA0)}
_UNUSED = [c for c, shown in _CODE_PAGE.items() if not shown]


def decoded_name(name: str) -> str:
    """A header field that was read byte by byte."""
    raw = name.encode("latin-1", "replace")
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return name if any(c in name for c in _UNUSED) else name.translate(str.maketrans({c: s for c, s in _CODE_PAGE.items() if s}))


def decoded(column: Column) -> Column:
    """Text that was read byte by byte (as Latin-1): UTF-8 where the bytes are valid UTF-8, else the Windows code page, or Latin-1 if
    there are bytes that the code page does not know."""
    raw = F.encode(column, "ISO-8859-1").cast("string")
    shown = {c: s for c, s in _CODE_PAGE.items() if s}
    single = F.when(column.rlike("[" + "".join(_UNUSED) + "]"), column).otherwise(F.translate(column, "".join(shown), "".join(shown.values())))
    return F.when(F.is_valid_utf8(raw), F.regexp_replace(raw, "^\ufeff", "")).otherwise(single)


def csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
        encoding: str | None = None, delimiter: str | None = None) -> DataFrame:
    """CSV scan; the delimiter is settled from the header line alone.

    Without an ``encoding`` the bytes are read as they are and each text is decoded inside the same scan, so files, and lines of one file,
    may differ in their encoding and nothing is read beforehand. Delimiters, quotes and line ends are ASCII in all of
    these encodings. Without a schema every column is read as text (use the coercion operators afterwards).
    """
    if delimiter is None:
        head = spark.read.text(path).first()
        delimiter = header_delimiter(head[0] if head else "")
    charset = {"cp1252": "ISO-8859-1", "latin1": "ISO-8859-1", None: "ISO-8859-1"}.get(encoding, encoding)
    reader = spark.read.option("header", True).option("sep", delimiter).option("encoding", charset)
    if schema is not None:
        reader = reader.schema(schema)
    rows = reader.csv(path)
    if encoding not in (None, "cp1252"):
        return rows
    if encoding is None:
        name, fix = (decoded_name if schema is None else str), decoded
    else:
        shown = {c: s for c, s in _CODE_PAGE.items() if s}
        name, fix = (lambda c: c.translate(str.maketrans(shown))), (lambda c: F.translate(c, "".join(shown), "".join(shown.values())))
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return rows.select(*[(fix(quoted(c)) if t == "string" else quoted(c)).alias(name(c)) for c, t in rows.dtypes])


def json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def null_for_nan(df: DataFrame) -> DataFrame:
    """NaN and infinity become NULL once, at the edge, so that aggregates skip them."""
    def clean(name, kind):
        if kind in ("double", "float"):
            c = F.col(name)
            return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c).alias(name)
        return F.col(name)
    return df.select(*[clean(n, k) for n, k in df.dtypes])
