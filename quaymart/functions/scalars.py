"""Scalar expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "no value" in web exports and uploads.
EMPTY_TEXTS = ["", "nan", "none", "null"]
UNSET_CAMPAIGN_TEXTS = ["", "nan", "none", "null", "(not set)", "(notset)"]
UNFILLED_PROMO_TEXTS = ["", "(not set)", "not set", "nan", "none", "null", "unknown",
                        "undefined", "0", "false", "no"]

# Fixed value: campaign names that point to a discounted purchase.
DISCOUNT_CAMPAIGN_PATTERN = (
    "sale|offer|discount|coupon|promo|clearance|deal|voucher|"
    "flash|markdown|cashback|loyalty|bonanza|special"
)


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of the rows where both are known, as an aggregate; NULL where one of them does not vary.

    Spark's own ``corr`` divides by zero there, which is an error in the ANSI mode.
    """
    both = x.isNotNull() & y.isNotNull()
    spread = F.sqrt(F.var_pop(F.when(both, x)) * F.var_pop(F.when(both, y)))
    return F.nanvl(F.try_divide(F.covar_pop(x, y), spread), F.lit(None).cast("double"))


def clip(value, low=None, high=None) -> Column:
    """Bound a value; NULL stays NULL."""
    out = _c(value)
    if low is not None:
        out = F.when(out < F.lit(low), F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > F.lit(high), F.lit(high)).otherwise(out)
    return out


def guarded_ratio(numerator, denominator, default=0.0) -> Column:
    """Division that yields ``default`` for a zero or missing denominator."""
    return F.coalesce(F.try_divide(_c(numerator).cast("double"), _c(denominator).cast("double")),
                      F.lit(float(default)))


def cents(money) -> Column:
    """Money as whole cents, so that sums are exact and cheap."""
    return F.round(_c(money).cast("double") * 100).cast("bigint")


def batch_ceiling(quantity, batch: int) -> Column:
    """Smallest multiple of ``batch`` that is not below the quantity."""
    return (F.ceil(_c(quantity) / F.lit(float(batch))) * F.lit(batch)).cast("bigint")


def sigmoid(score, bound: float = 12.0) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(_c(score), -bound, bound)))


def shifted_log(value, minimum) -> tuple[Column, Column]:
    """ln of a value shifted to be positive, and the shift itself (0 for positive data)."""
    low = _c(minimum)
    offset = F.when(low <= 0, F.abs(low) + 1.0).otherwise(F.lit(0.0))
    return F.log(_c(value) + offset + 1.0), offset


def calendar_waves(day) -> dict[str, Column]:
    """Weekday, day of month and month as points on a circle (Monday is 0)."""
    day = _c(day)
    parts = {"dow": (F.weekday(day), 7), "dom": (F.dayofmonth(day), 31), "month": (F.month(day), 12)}
    waves = {}
    for name, (part, period) in parts.items():
        angle = part.cast("double") * F.lit(2 * math.pi) / F.lit(float(period))
        waves[f"sin_{name}"] = F.sin(angle)
        waves[f"cos_{name}"] = F.cos(angle)
    return waves


def calendar_parts(day) -> dict[str, Column]:
    day = _c(day)
    return {
        "order_month": F.coalesce(F.month(day), F.lit(0)).cast("double"),
        "order_quarter": F.coalesce(F.quarter(day), F.lit(0)).cast("double"),
        "order_dayofweek": F.coalesce(F.weekday(day), F.lit(0)).cast("double"),
        "is_weekend": F.coalesce((F.weekday(day) >= 5).cast("double"), F.lit(0.0)),
    }


def tidy_text(value) -> Column:
    return F.lower(F.trim(_c(value).cast("string")))


def is_filled(value, empty=tuple(EMPTY_TEXTS)) -> Column:
    """True where the text carries information."""
    value = _c(value)
    return value.isNotNull() & ~tidy_text(value).isin(list(empty))


def looks_discounted(campaign) -> Column:
    return F.coalesce(tidy_text(campaign).rlike(DISCOUNT_CAMPAIGN_PATTERN), F.lit(False))


def number_in_text(value) -> Column:
    """First number inside a text such as ``"1,200 units"``; NULL when there is none."""
    text = F.trim(_c(value).cast("string"))
    plain = F.when(~text.isin(EMPTY_TEXTS), F.regexp_replace(text, ",", ""))
    found = F.regexp_extract(plain, r"([-+]?\d*\.?\d+)", 1)
    return F.when(found != "", found).try_cast("double")


def id_text(value, dtype: str) -> Column:
    """Stable text form of an identifier: ``1.23E18`` and a trailing ``.0`` become plain digits."""
    value = _c(value)
    if dtype in ("double", "float"):
        whole = value == F.floor(value)
        text = F.when(whole, value.cast("decimal(38,0)").cast("string")).otherwise(value.cast("string"))
    else:
        text = F.regexp_replace(F.trim(value.cast("string")), r"^(-?\d+)\.0$", "$1")
    return F.coalesce(text, F.lit(""))


def label_key(value) -> Column:
    """Comparable form of a label, so that 1.0, 1 and "1" are one label."""
    text = F.trim(_c(value).cast("string"))
    number = text.try_cast("double")
    return F.when(number.isNotNull() & (number == F.floor(number)), number.cast("bigint").cast("string")) \
            .when(number.isNotNull(), number.cast("string")) \
            .otherwise(F.lower(text))


def same_label(left, right) -> Column:
    return F.coalesce(label_key(left) == label_key(right), F.lit(False))


def category_token(value) -> Column:
    """Category text made safe for use inside a column name."""
    text = F.coalesce(F.trim(_c(value).cast("string")), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(text, r"\s+", "_"), r"[^0-9A-Za-z_]+", "_")
    text = F.regexp_replace(F.regexp_replace(text, r"_+", "_"), r"^_+|_+$", "")
    return F.when(text == "", F.lit("blank")).otherwise(text)


def humanised(value) -> Column:
    """Column name as a display label: underscores to blanks, words capitalised."""
    return F.initcap(F.regexp_replace(F.trim(F.replace(_c(value).cast("string"), F.lit("_"), F.lit(" "))), r"\s+", " "))


def metric_share(value) -> Column:
    """A score given as percent or share, as a share; missing becomes 0."""
    score = F.coalesce(_c(value).try_cast("double"), F.lit(0.0))
    return F.when(score > 1, score / 100.0).otherwise(score)


def finite_or_null(value) -> Column:
    value = _c(value).cast("double")
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


def half_even(value, digits: int) -> Column:
    """Rounding used where the result is only shown, never computed with."""
    return F.bround(_c(value), digits)
