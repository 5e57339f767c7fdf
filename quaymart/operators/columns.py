"""Schema and column operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import naming
from ..functions.scalars import EMPTY_TEXTS, id_text, label_key, number_in_text, tidy_text
from ..session import shared
from .scale import attach_group_stats, exact_quantiles, numbered, with_scalars

NUMERIC = ("bigint", "int", "smallint", "tinyint", "double", "float")

# Words that count as a positive outcome in a text target.
TRUTHY_TEXTS = ["1", "true", "yes", "y", "buyer", "churn", "churned", "sensitive", "high", "promo_sensitive",
                "promotion_sensitive", "full_price", "fullprice", "full_price_buyer", "isfullpricebuyer"]

# How a purchase is recognised, by part of the column name, in order of preference.
TRANSACTION_ID_WORDS = ["transaction_id", "order_id", "purchase_id", "invoice_id", "transactionid", "orderid", "purchaseid", "invoiceid"]
TRANSACTION_WORDS = ["transaction", "purchase", "order", "payment", "sale", "booking"]
INDICATOR_WORDS = ["revenue", "purchase_amount", "payment_status", "order_status", "checkout", "cart", "subscription", "price"]
NO_ID_TEXTS = ["none", "null", "nan", "0", "false", "", "undefined"]
NO_TRANSACTION_TEXTS = ["failed", "canceled", "cancelled", "0", "false", "none", "null", "nan", "", "pending"]
DONE_STATUS_TEXTS = ["completed", "success", "paid", "active", "completed_checkout", "checkout", "subscribed", "yes", "true", "1"]
NO_INDICATOR_TEXTS = ["false", "0", "no", "none", "nan", "", "null"]


def is_numeric(df: DataFrame, column: str) -> bool:
    kind = dict(df.dtypes)[column]
    return kind in NUMERIC or kind.startswith("decimal")


def normalised(df: DataFrame) -> DataFrame:
    return df.toDF(*naming.normalised_names(df.columns))


def aliased(df: DataFrame, wanted: Mapping[str, Sequence[str]], fill: float | None = 0.0) -> DataFrame:
    """Add each canonical column that is absent from the first alias that is present, as a number."""
    out = {}
    for name, candidates in wanted.items():
        source = None if name in df.columns else naming.find_column(df.columns, *candidates)
        if source is not None:
            number = F.col(source).try_cast("double")
            out[name] = number if fill is None else F.coalesce(number, F.lit(fill))
    return df.withColumns(out) if out else df


def coerced_numeric(df: DataFrame, column: str, accept: float = 0.8) -> DataFrame:
    """Read a text column as numbers if at least ``accept`` of its values survive; else leave it."""
    if is_numeric(df, column):
        return df
    number = number_in_text(column)
    row = df.agg(F.count(column).alias("given"), F.count(number).alias("kept")).first()
    if not row["kept"] or row["kept"] / row["given"] < accept:
        return df
    return df.withColumn(column, number)


def coercion_report(df: DataFrame, columns: Sequence[str], accept: float = 0.8) -> DataFrame:
    """How many values of each text column read as a number, and whether the column qualifies."""
    cells = [F.struct(F.lit(c).alias("column"), F.count(c).alias("given"), F.count(number_in_text(c)).alias("kept")) for c in columns]
    rows = df.agg(F.array(*cells).alias("_a")).select(F.inline("_a"))
    return rows.withColumn("numeric", F.coalesce(F.try_divide("kept", "given") >= accept, F.lit(False)).cast("int"))


def parsed_time(df: DataFrame, column: str, name: str = "event_time") -> DataFrame:
    """Timestamp from YYYYMMDD numbers, epoch seconds, milliseconds or microseconds, or text.

    The unit of a number follows from the median magnitude of the column, found on the whole data
    and cross-joined as one row, so nothing comes to the driver.
    """
    number = F.abs(F.col(column).try_cast("double"))
    middle = exact_quantiles(df.select(number.alias("_v")), "_v", {"_median": 0.5})
    rows = with_scalars(df, middle)
    raw = F.col(column).try_cast("double")
    whole = raw.try_cast("bigint")
    calendar = F.when(whole.between(20000101, 21001231), F.try_to_timestamp(whole.cast("string"), F.lit("yyyyMMdd")))
    level = F.col("_median")
    numeric = (F.when(level.between(20000101, 21001231), calendar)
               .when(level >= 1e15, F.timestamp_micros(whole)).when(level >= 1e12, F.timestamp_millis(whole))
               .when(level >= 1e9, F.timestamp_seconds(raw)))
    text = F.try_to_timestamp(F.col(column).cast("string"))
    text = F.when(raw.isNull(), text)
    return rows.withColumn(name, F.coalesce(numeric, text)).drop("_median")


def best_event_time(df: DataFrame, candidates: Sequence[str] = ("date", "event_date", "eventDate", "event_timestamp"),
                    name: str = "event_time") -> DataFrame:
    """Time from whichever candidate column parses for most rows."""
    sources = list(dict.fromkeys(c for c in (naming.find_column(df.columns, k) for k in candidates) if c))
    if not sources:
        return df.withColumn(name, F.lit(None).cast("timestamp"))
    out = df
    for i, source in enumerate(sources):
        out = parsed_time(out, source, f"_t{i}")
    counts = out.agg(*[F.count(f"_t{i}").alias(str(i)) for i in range(len(sources))]).first()
    best = max(range(len(sources)), key=lambda i: counts[i])
    return out.withColumn(name, F.col(f"_t{best}")).drop(*[f"_t{i}" for i in range(len(sources))])


def with_stable_id(df: DataFrame, source: str, name: str = "user_pseudo_id") -> DataFrame:
    return df.withColumn(name, id_text(source, dict(df.dtypes)[source]))


def without(df: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    """Drop columns by name, ignoring case, blanks and underscores."""
    banned = {naming.bare(f) for f in forbidden}
    return df.drop(*[c for c in df.columns if naming.bare(c) in banned])


def without_empty(df: DataFrame) -> DataFrame:
    """Drop all-null columns and, of several columns with one name, all but the first."""
    seen, unique = set(), []
    names = list(df.columns)
    if len(set(names)) < len(names):
        numbered_names = [f"{n}#{i}" for i, n in enumerate(names)]
        df = df.toDF(*numbered_names)
        for original, temporary in zip(names, numbered_names):
            if original not in seen:
                seen.add(original)
                unique.append(F.col(f"`{temporary}`").alias(original))
        df = df.select(*unique)
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if counts[c] > 0])


def with_row_id(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """Dense id 1..n in the stated order, numbered in parallel."""
    return numbered(df, order, name=name)


def merge_report(df: DataFrame) -> DataFrame:
    """Per column: share of nulls, whether it holds only 0/1 or booleans, and whether its lower-case
    name is shared with another column."""
    lowered = [c.lower() for c in df.columns]
    cells = []
    for c in df.columns:
        kind = dict(df.dtypes)[c]
        flaglike = F.col(c).isin(0, 1) if is_numeric(df, c) else (F.lit(True) if kind == "boolean" else F.lit(False))
        cells.append(F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count("*").alias("n_rows"),
                              F.coalesce(F.bool_and(F.when(F.col(c).isNotNull(), flaglike)), F.lit(True)).cast("int").alias("only_flags"),
                              F.lit(int(lowered.count(c.lower()) > 1)).alias("name_clash")))
    rows = df.agg(F.array(*cells).alias("_a")).select(F.inline("_a"))
    return rows.select("column", "nulls", "n_rows", "only_flags", "name_clash",
                       (F.coalesce(F.try_divide("nulls", "n_rows"), F.lit(0.0)) > 0.95).cast("int").alias("mostly_null"))


def target_verdict(df: DataFrame, target: str, numeric: bool = False, classification: bool = True,
                   min_rows: int = 10, max_missing: float = 0.5) -> DataFrame:
    """One row that says whether a target can be modelled and, if not, why."""
    if target not in df.columns:
        return df.agg(F.count("*").alias("n_rows")).select(F.col("n_rows"), F.lit(0).cast("bigint").alias("valid_rows"),
                                                          F.lit("missing column").alias("verdict"))
    value = number_in_text(target) if numeric and not is_numeric(df, target) else F.col(target)
    agg = df.agg(F.count("*").alias("n_rows"), F.count(value).alias("valid_rows"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    missing = F.try_divide(F.col("n_rows") - F.col("valid_rows"), F.col("n_rows"))
    one_class = F.lit(classification) & (F.col("_lo") == F.col("_hi"))
    verdict = (F.when(F.col("n_rows") == 0, "no rows").when(F.col("valid_rows") == 0, "no usable values")
               .when(F.col("valid_rows") < min_rows, "too few valid rows").when(missing >= max_missing, "too many missing values")
               .when(one_class, "only one class").otherwise("ok"))
    return agg.select("n_rows", "valid_rows", verdict.alias("verdict"))


def coded_outcome(df: DataFrame, target: str, good, bad, good_code: int = 1, bad_code: int = 0, name: str | None = None) -> DataFrame:
    """Two-valued outcome as codes; a value that is neither label nor code becomes NULL.

    ``unmapped_outcomes`` lists those values, so a caller can refuse the data.
    """
    key = label_key(target)
    code = (F.when(key.isin(str(good).strip().lower(), str(good_code)), F.lit(good_code))
            .when(key.isin(str(bad).strip().lower(), str(bad_code)), F.lit(bad_code)))
    return df.withColumn(name or target, code)


def unmapped_outcomes(df: DataFrame, target: str, good, bad) -> DataFrame:
    coded = coded_outcome(df, target, good, bad, name="_code")
    return coded.where(F.col(target).isNotNull() & F.col("_code").isNull()).groupBy(F.col(target).cast("string").alias("value")).agg(F.count("*").alias("n"))


def binary_target(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """0/1 numbers stay, other numbers split at their median, texts count by a list of positive words."""
    name = name or column
    if not is_numeric(df, column):
        return df.withColumn(name, F.coalesce(tidy_text(column).isin(TRUTHY_TEXTS), F.lit(False)).cast("int"))
    value = F.col(column).cast("double")
    shape = df.agg(F.coalesce(F.bool_and(F.when(value.isNotNull(), value.isin(0.0, 1.0))), F.lit(True)).alias("_flag"))
    middle = exact_quantiles(df, column, {"_median": 0.5})
    rows = with_scalars(with_scalars(df, shape), middle)
    split = (F.coalesce(value, F.col("_median")) >= F.col("_median")).cast("int")
    plain = (F.coalesce(value, F.lit(0.0)) > 0).cast("int")
    return rows.withColumn(name, F.when(F.col("_flag"), plain).otherwise(split)).drop("_flag", "_median")


def with_buyer_flag(df: DataFrame) -> DataFrame:
    """Derive ``is_buyer`` from the most telling column and drop that column."""
    def first(words):
        return next((c for c in df.columns if any(w in c.lower() for w in words)), None)

    def positive(column, empty):
        if is_numeric(df, column):
            return F.coalesce(F.col(column) > 0, F.lit(False))
        return F.col(column).isNotNull() & ~tidy_text(column).isin(empty)

    source = first(TRANSACTION_ID_WORDS)
    if source is not None:
        flag = F.col(source).isNotNull() & ~tidy_text(source).isin(NO_ID_TEXTS)
    elif (source := first(TRANSACTION_WORDS)) is not None:
        flag = positive(source, NO_TRANSACTION_TEXTS)
    elif (source := first(INDICATOR_WORDS)) is not None:
        if not is_numeric(df, source) and "status" in source.lower():
            flag = F.col(source).isNotNull() & tidy_text(source).isin(DONE_STATUS_TEXTS)
        else:
            flag = positive(source, NO_INDICATOR_TEXTS)
    else:
        raise ValueError("no column tells whether a purchase took place")
    return df.withColumn("is_buyer", flag.cast("int")).drop(source)


def key_is_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys and whether the keys identify rows."""
    folded = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return folded.agg(F.sum("_n").cast("bigint").alias("n_rows"), F.count("*").alias("n_keys")) \
        .withColumn("is_unique", (F.col("n_rows") == F.col("n_keys")).cast("int"))


def ordinal_codes(df: DataFrame, columns: Mapping[str, str], missing: str = "missing", broadcast_rows: int = 200_000) -> DataFrame:
    """Code each text column by its place among its sorted distinct values, as a number.

    The distinct values of all columns come from one pass. Their number is checked: a small
    dictionary is broadcast, a large one is numbered in parallel and joined skew-safely.
    """
    out = df.withColumns({f"_txt_{name}": F.coalesce(tidy_text(source), F.lit(missing)) for source, name in columns.items()})
    cells = F.array(*[F.struct(F.lit(name).alias("_of"), F.col(f"_txt_{name}").alias("_txt")) for name in columns.values()])
    values = shared(out.select(F.inline(cells)).groupBy("_of", "_txt").agg(F.count("*").alias("_w")))
    small = values.count() <= broadcast_rows
    if small:
        place = F.row_number().over(Window.partitionBy("_of").orderBy("_txt"))
        codes = values.withColumn("_code", (place - 1).cast("double"))
    else:
        codes = numbered(values, ["_txt"], by=["_of"], name="_code").withColumn("_code", (F.col("_code") - 1).cast("double"))
    for name in columns.values():
        own = codes.where(F.col("_of") == name).select(F.col("_txt").alias(f"_txt_{name}"), F.col("_code").alias(name), "_w")
        if small:
            out = out.join(F.broadcast(own.drop("_w")), f"_txt_{name}", "left")
        else:
            out = attach_group_stats(out, own, [f"_txt_{name}"], "_w")
        out = out.drop(f"_txt_{name}")
    return out.select(*df.columns, *columns.values())
