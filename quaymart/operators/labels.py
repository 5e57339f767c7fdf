"""Behavioural features and labels of customers and items."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import find_column
from ..functions.scalars import (UNFILLED_PROMO_TEXTS, UNSET_CAMPAIGN_TEXTS, calendar_parts, clip, guarded_ratio, is_filled,
                                 looks_discounted)
from ..session import shared
from .columns import aliased, is_numeric, ordinal_codes
from .scale import attach_group_stats, bounded_quantiles, exact_quantiles, quantile_row, with_scalars


def scaled_by_max(df: DataFrame, expressions: Mapping[str, Column]) -> DataFrame:
    """Columns divided by their maximum over the table; all 0 where that is not positive."""
    staged = df.withColumns({f"_raw_{n}": F.coalesce(e.cast("double"), F.lit(0.0)) for n, e in expressions.items()})
    tops = staged.agg(*[F.max(f"_raw_{n}").alias(f"_top_{n}") for n in expressions])
    rows = with_scalars(staged, tops)
    out = {n: F.when(F.col(f"_top_{n}") > 0, F.col(f"_raw_{n}") / F.col(f"_top_{n}")).otherwise(F.lit(0.0)) for n in expressions}
    return rows.withColumns(out).drop(*[f"_{k}_{n}" for n in expressions for k in ("raw", "top")])


def group_transform(df: DataFrame, key: str, value: str, distinct: str | None = None, leave_one_out: bool = False) -> DataFrame:
    """Mean, deviation and number of distinct values of the row's group.

    With ``leave_one_out`` the row's own value is kept out of the mean, so a target encoded this
    way does not leak into its own feature.
    """
    v = F.col(value).cast("double")
    stats = df.groupBy(key).agg(F.count("*").alias("_w"), F.count(v).alias("_gn"), F.sum(v).alias("_gs"), F.avg(v).alias("_gm"),
                                F.stddev_samp(v).alias("group_std"),
                                *([F.count_distinct(distinct).alias("group_distinct")] if distinct else []))
    rows = attach_group_stats(df, stats, [key], "_w")
    others = F.try_divide(F.col("_gs") - v, (F.col("_gn") - 1).cast("double"))
    mean = F.when(v.isNull(), F.col("_gm")).otherwise(others) if leave_one_out else F.col("_gm")
    return rows.withColumn("group_mean", mean).drop("_gn", "_gs", "_gm")


def _number(df: DataFrame, *names: str, default: float = 0.0) -> Column:
    source = find_column(df.columns, *names)
    return F.lit(default) if source is None else F.coalesce(F.col(source).try_cast("double"), F.lit(default))


def _presence(df: DataFrame, *names: str, filled: bool = False) -> Column:
    """A number as it is, a text as whether it is there, 0 when there is no such column."""
    source = find_column(df.columns, *names)
    if source is None:
        return F.lit(0.0)
    if is_numeric(df, source):
        return F.coalesce(F.col(source).cast("double"), F.lit(0.0))
    known = F.col(source).isNotNull() & (F.trim(source) != "") if filled else F.col(source).isNotNull()
    return known.cast("double")


# Coded column, and the names of the text column it comes from.
BEHAVIOUR_CODES = {
    "first_item_category_enc": ("itemCategory", "item_category", "first_item_category"),
    "acq_channel_enc": ("firstUserPrimaryChannelGroup", "acq_channel", "channel"),
    "age_group_enc": ("age", "age_group", "ageGroup"),
    "gender_enc": ("gender", "sex"),
    "device_enc": ("deviceCategory", "device", "device_enc"),
}


def encoded_texts(df: DataFrame, codes: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add each coded column whose source exists; two codes may share a source."""
    wanted = {}
    for name, names in codes.items():
        source = None if name in df.columns else find_column(df.columns, *names)
        if source is not None:
            wanted[name] = source
    if not wanted:
        return df
    staged = df.withColumns({f"_src_{n}": F.col(s) for n, s in wanted.items()})
    return ordinal_codes(staged, {f"_src_{n}": n for n in wanted}).drop(*[f"_src_{n}" for n in wanted])


def behaviour_pack(df: DataFrame) -> DataFrame:
    """Sessions, engagement, cart abandonment, promotion and search signals, churn risk and codes."""
    bounce, engaged = _number(df, "bounceRate", "bounce_rate"), _number(df, "engagementRate", "engagement_rate")
    carts = find_column(df.columns, "addToCarts", "add_to_carts", "itemsAddedToCart")
    checkouts = find_column(df.columns, "checkouts", "checkout")
    in_cart = _number(df, "addToCarts", "add_to_carts", "itemsAddedToCart") > 0
    abandoned = in_cart & (_number(df, "checkouts", "checkout") <= 0) if checkouts else in_cart
    columns = {
        "total_sessions": _number(df, "sessions", "total_sessions", "sessionsPerUser"),
        "scroll_depth": _number(df, "percentScrolled", "scroll_depth", "scrollDepth"),
        "cart_abandonment": abandoned.cast("int") if carts else F.lit(0),
        "add_to_carts": _number(df, "addToCarts", "add_to_carts", "itemsAddedToCart"),
        "promo_clicks": _presence(df, "sessionCampaign", "campaign", "promo_clicks"),
        "search_clicks": _presence(df, "searchTerm", "search_clicks", "search", filled=True),
        "churn_risk": (clip(bounce, 0.0, 1.0) + (F.lit(1.0) - clip(engaged, 0.0, 1.0))) / 2.0,
    }
    out = df.withColumns({n: e for n, e in columns.items() if n not in df.columns})
    if "engagement_time" not in out.columns:
        out = out.withColumn("engagement_time", _number(df, "userEngagementDuration", "engagement_time", "engagementTime"))
        middle = exact_quantiles(out, "engagement_time", {"_mid": 0.5})
        scale = F.when(F.col("_mid") > 1000, F.lit(1000.0)).otherwise(F.lit(1.0))
        out = with_scalars(out, middle).withColumn("engagement_time", F.col("engagement_time") / scale).drop("_mid")
    return encoded_texts(out, BEHAVIOUR_CODES)


def discount_signal(df: DataFrame) -> tuple[Column, str]:
    """Whether a row was bought with a discount: coupon, else amount, else the campaign's name."""
    coupon = find_column(df.columns, "coupon", "coupon_used", "couponUsed", "couponCode", "coupon_code")
    if coupon:
        used = F.coalesce(F.col(coupon).cast("double"), F.lit(0.0)) > 0 if is_numeric(df, coupon) else is_filled(coupon, UNFILLED_PROMO_TEXTS)
        return used, f"coupon:{coupon}"
    amount = find_column(df.columns, "discount_amount", "discountAmount", "promo_discount_amount", "itemDiscount", "discount")
    if amount:
        return F.coalesce(F.col(amount).try_cast("double"), F.lit(0.0)) > 0, f"amount:{amount}"
    campaign = find_column(df.columns, "sessionCampaign", "campaign", "promotion_name", "promotionName")
    if campaign:
        return looks_discounted(campaign), f"campaign:{campaign}"
    raise ValueError("no coupon, discount amount or campaign tells how buyers paid")


def full_price_buyers(df: DataFrame) -> DataFrame:
    """Buyers only, labelled by whether they paid the full price."""
    used, source = discount_signal(df)
    return df.where(F.col("is_buyer") == 1).withColumns({
        "bought_with_discount": used.cast("int"), "is_full_price_buyer": (~used).cast("int"),
        "discount_source": F.lit(source), "target_source": F.lit(f"derived:{source}")})


def has_both_classes(df: DataFrame, target: str) -> DataFrame:
    return df.agg(F.count_if(F.col(target) == 1).alias("positives"), F.count_if(F.col(target) == 0).alias("negatives")) \
        .withColumn("both", ((F.col("positives") > 0) & (F.col("negatives") > 0)).cast("int"))


def purchase_days(rows: DataFrame, user: str = "user_pseudo_id", day: str = "day", bought: Column | None = None) -> DataFrame:
    """Order days per user with the gap to the next one.

    Orders are folded to one row per user and day first, so the window per user holds at most the
    days of the calendar, however many rows a user has.
    """
    orders = rows if bought is None else rows.where(bought)
    days = orders.where(F.col(user).isNotNull() & F.col(day).isNotNull()).groupBy(user, day).agg(F.count("*").alias("day_orders"))
    end = days.agg(F.max(day).alias("_end"))
    line = Window.partitionBy(user).orderBy(day)
    following = with_scalars(days, end).select(
        "*", F.lead(day).over(line).alias("next_purchase_date"), F.lag(day).over(line).alias("previous_purchase_date"),
        F.row_number().over(line).alias("order_no"), F.count("*").over(Window.partitionBy(user)).alias("n_orders"))
    gap = F.datediff("next_purchase_date", day)
    open_days = F.datediff("_end", F.col(day))
    repeat = {f"repeat_purchase_{d}d": F.coalesce((gap <= d).cast("int"), F.lit(0)) for d in (30, 60, 90)}
    return following.select(
        user, day, "day_orders", "order_no", "n_orders", "previous_purchase_date", "next_purchase_date",
        gap.cast("double").alias("days_until_next_purchase"), gap.isNotNull().cast("int").alias("event_observed"),
        F.coalesce(gap, open_days).cast("int").alias("time_to_event"), *[e.alias(n) for n, e in repeat.items()])


def repeat_buyers(df: DataFrame, history: DataFrame | None = None, user: str = "user_pseudo_id") -> DataFrame:
    """Repeat-buyer label: order history, else a returning-user signal among buyers, else the buyer flag."""
    if history is not None:
        per_user = history.groupBy(user).agg(F.count("*").alias("_w"), F.max((F.col("n_orders") >= 2).cast("int")).alias("_repeat"))
        out = attach_group_stats(df, per_user, [user], "_w")
        return out.withColumn("is_repeat_buyer", F.coalesce("_repeat", F.lit(0))).withColumn("target_source", F.lit("longitudinal")).drop("_repeat")
    buyer = F.col("is_buyer") == 1
    signal = find_column(df.columns, "returningUsers", "returning_user", "returningUserRate") or \
        find_column(df.columns, "previous_purchases", "purchase_frequency")
    hit = buyer & (F.coalesce(F.col(signal).try_cast("double"), F.lit(0.0)) > 0) if signal else buyer
    return df.withColumn("is_repeat_buyer", hit.cast("int")).withColumn("target_source", F.lit("proxy"))


def evaluation_pack(df: DataFrame, day: str = "day") -> DataFrame:
    """Engagement, view, cart and calendar features of the repeat-purchase question."""
    out = aliased(df, {
        "views_per_user": ["views_per_user", "viewsPerUser", "itemsViewed", "views"], "bounce_rate": ["bounce_rate", "bounceRate"],
        "checkouts_per_user": ["checkouts_per_user", "checkoutsPerUser", "checkouts"],
        "items_viewed": ["items_viewed", "itemsViewed"], "items_added_to_cart": ["items_added_to_cart", "itemsAddedToCart", "addToCarts"],
        "session_engaged_rate": ["session_engaged_rate", "engagementRate", "engagedSessionsPerUser", "engagedSessions"]})
    if "session_engaged_rate" in out.columns:
        # Counts of engaged sessions become rates.
        sessions = _number(out, "total_sessions", "sessionsPerUser", default=1.0)
        sessions = F.when(sessions == 0, F.lit(1.0)).otherwise(sessions)
        top = out.agg(F.max("session_engaged_rate").alias("_top"))
        rate = F.when(F.col("_top") > 1, F.col("session_engaged_rate") / sessions).otherwise(F.col("session_engaged_rate"))
        out = with_scalars(out, top).withColumn("session_engaged_rate", clip(rate, 0.0, 1.0)).drop("_top")
    if "bounce_rate" in out.columns:
        out = out.withColumn("bounce_rate", clip("bounce_rate", 0.0, 1.0))
    out = out.withColumns({n: e for n, e in calendar_parts(day).items() if n not in out.columns})
    return encoded_texts(out, {"item_category2_enc": ("itemCategory2", "item_category2", "product_type")})


def high_value_buyers(df: DataFrame, revenue: str, share: float = 0.75) -> DataFrame:
    """Buyers whose revenue reaches the upper quartile of buyers."""
    value = F.coalesce(F.col(revenue).cast("double"), F.lit(0.0))
    cut = exact_quantiles(df.where("is_buyer = 1").select(value.alias("_v")), "_v", {"_cut": share})
    hit = (F.col("is_buyer") == 1) & (value >= F.col("_cut"))
    return with_scalars(df, cut).withColumn("is_high_ltv", F.coalesce(hit, F.lit(False)).cast("int")).drop("_cut")


def days_to_next_purchase(df: DataFrame, history: DataFrame | None = None, user: str = "user_pseudo_id", day: str = "day",
                          category: str | None = None, leave_one_out: bool = True) -> DataFrame:
    """Expected days to the next purchase from intensity of use, replaced by the observed gap where
    there is one, with category statistics and a readiness flag.

    Needs ``purchase_frequency``, ``previous_purchases``, ``sessionsPerUser`` and ``session_engaged``
    where known; absent ones count as 0 (sessions as 1).
    """
    freq, prev = _number(df, "purchase_frequency"), _number(df, "previous_purchases")
    sess = F.greatest(_number(df, "sessionsPerUser", default=1.0), F.lit(0.1))
    staged = df.withColumn("_eng", _number(df, "session_engaged"))
    top = staged.agg(F.max("_eng").alias("_top"))
    staged = with_scalars(staged, top)
    engaged = clip(F.when(F.col("_top") > 1.5, F.col("_eng") / sess).otherwise(F.col("_eng")), 0.0, 1.0)
    intensity = freq * 3.0 + prev * 1.5 + engaged * 0.8 + F.lit(1.0) / sess
    raw = F.lit(150.0) / (F.lit(1.0) + intensity)
    proxy = F.when(prev + freq > 0, clip(raw, 7.0, 120.0)).otherwise(clip(F.greatest(raw, F.lit(120.0)), 120.0, 180.0))
    out = staged.withColumn("_proxy", proxy)
    if "days_until_next_purchase" in df.columns:
        out = out.withColumn("_proxy", F.coalesce(F.col("days_until_next_purchase").cast("double"), "_proxy")).drop("days_until_next_purchase")
    if history is not None:
        seen = history.select(user, day, F.col("days_until_next_purchase").alias("_gap"))
        out = out.join(seen, [user, day], "left").withColumn("days_until_next_purchase", F.coalesce("_gap", "_proxy")).withColumn(
            "target_source", F.when(F.col("_gap").isNotNull(), "longitudinal").otherwise("proxy")).drop("_gap")
    else:
        out = out.withColumn("days_until_next_purchase", F.col("_proxy")).withColumn("target_source", F.lit("proxy"))
    out = out.drop("_proxy", "_eng", "_top")
    expected: Column = F.col("_mid")
    middle = exact_quantiles(out, "days_until_next_purchase", {"_mid": 0.5})
    out = with_scalars(out, middle)
    if category is not None:
        out = group_transform(out, category, "days_until_next_purchase", leave_one_out=leave_one_out)
        out = out.withColumnRenamed("group_mean", "cat_mean_target").withColumn("cat_std_target", F.coalesce("group_std", F.lit(0.0))).drop("group_std")
        expected = F.coalesce("cat_mean_target", "_mid")
    ready = F.col("days_until_next_purchase") <= F.greatest(expected * 0.85, F.lit(1.0))
    return out.withColumn("is_repurchase_ready", ready.cast("int")).drop("_mid")


def activity_scores(df: DataFrame) -> DataFrame:
    """Eight activity scores, each scaled by its maximum."""
    n = lambda *names: _number(df, *names)
    sess, purch = n("total_sessions", "sessions", "sessionsPerUser"), n("total_purchases", "purchases")
    per = lambda v, d: v / F.when(d == 0, F.lit(1.0)).otherwise(d)
    bounce, engaged = n("bounce_rate", "bounceRate"), n("engagement_rate", "engagementRate")
    return scaled_by_max(df, {
        "session_volume_score": sess, "frequency_score": per(purch, sess), "monetary_score": n("total_revenue", "totalRevenue", "purchaseRevenue"),
        "engagement_depth": per(n("engagement_time_msec", "userEngagementDuration") * (1 + n("avg_scroll_depth", "percentScrolled", "scroll_depth")), sess),
        "behavioral_degradation": bounce + (F.lit(1.0) - clip(engaged, 0.0, 1.0)),
        "promo_sensitivity": per(_presence(df, "promo_clicks", "sessionCampaign"), purch),
        "cart_abandon_severity": n("cart_abandonment_total", "cart_abandonment"), "conversion_efficiency": per(purch, sess)})


def retention_signals(df: DataFrame, day: str = "day") -> DataFrame:
    """Days since the row's activity, purchase frequency and promotion exposure."""
    last = df.agg(F.max(day).alias("_last"))
    gap = F.datediff("_last", F.col(day))
    rows = with_scalars(df, last).withColumn("_gap", gap.cast("double"))
    middle = bounded_quantiles(rows, "_gap", {"_mid": 0.5})
    rows = with_scalars(rows, middle)
    campaign = find_column(df.columns, "sessionCampaign", "firstUserCampaign")
    clicks = (_number(df, "promo_clicks") > 0).cast("double") if "promo_clicks" in df.columns else F.lit(0.0)
    exposed = is_filled(campaign, UNSET_CAMPAIGN_TEXTS).cast("double") if campaign else F.lit(0.0)
    return rows.withColumns({
        "recency_days": F.greatest(F.coalesce("_gap", "_mid"), F.lit(0.0)),
        "last_activity_date": F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("")),
        "purchase_frequency": _number(df, "purchasesPerUser", "purchase_frequency", "previous_purchases", "total_purchases", "purchases"),
        "promo_exposure": clip(exposed + clicks, 0.0, 2.0)}).drop("_last", "_gap", "_mid")


def quiet_traffic(df: DataFrame) -> DataFrame:
    """Low activity: last activity longer ago than for half of the rows."""
    middle = bounded_quantiles(df, "recency_days", {"activity_label_threshold_days": 0.5})
    return with_scalars(df, middle).withColumn(
        "is_low_activity", (F.coalesce("recency_days", F.lit(0.0)) > F.col("activity_label_threshold_days")).cast("int")) \
        .withColumn("target_source", F.lit("derived_recency"))


def buyer_churn_proxy(df: DataFrame) -> DataFrame:
    """Buyers who are inactive beyond the buyers' median and either rare or degraded; without usable
    recency, degraded and less engaged than the median buyer."""
    n = {c: _number(df, *names) for c, names in {
        "_rec": ("recency_days",), "_freq": ("purchase_frequency", "total_purchases"), "_bd": ("behavioral_degradation",),
        "_eng": ("engagement_rate", "engagementRate")}.items()}
    rows = df.withColumns(n)
    buyers = rows.where("is_buyer = 1")
    cuts = buyers.agg(((F.max("_rec") > F.min("_rec")) & (F.max("_rec") > 0)).alias("_usable"))
    cuts = with_scalars(cuts, quantile_row(buyers, list(n), 0.5, "_cut"))
    rows = with_scalars(rows, cuts)
    weak = (F.col("_freq") <= F.col("_cut_freq")) | (F.col("_bd") > F.col("_cut_bd"))
    usual = (F.col("_rec") > F.col("_cut_rec")) & weak
    other = (F.col("_bd") > F.col("_cut_bd")) & (F.col("_eng") < F.col("_cut_eng"))
    hit = (F.col("is_buyer") == 1) & F.when(F.col("_usable"), usual).otherwise(other)
    return rows.withColumn("churn_proxy", F.coalesce(hit, F.lit(False)).cast("int")).select(*df.columns, "churn_proxy")


def inactivity_churn(df: DataFrame, user: str = "user_pseudo_id", day: str = "day", threshold: int = 60) -> DataFrame:
    """Users whose last activity lies more than ``threshold`` days before the end of the data.

    The last day per user is an aggregate brought back to the rows; rows without a date are 0.
    """
    users = df.where(F.col(day).isNotNull()).groupBy(user).agg(F.count("*").alias("_w"), F.max(day).alias("last_active_date"))
    end = df.agg(F.max(day).alias("_end"))
    rows = with_scalars(attach_group_stats(df, users, [user], "_w"), end)
    gap = F.datediff("_end", "last_active_date")
    return rows.withColumns({
        "days_inactive": gap.cast("double"), "is_churned": F.coalesce((gap > threshold).cast("int"), F.lit(0)),
        "recency_days": F.greatest(F.coalesce(gap.cast("double"), F.lit(0.0)), F.lit(0.0)),
        "inactivity_threshold_days": F.lit(threshold), "target_source": F.lit(f"inactivity_{threshold}d")}).drop("_end")


def promotion_sensitivity(df: DataFrame, user: str = "user_pseudo_id", campaign: str = "sessionCampaign", purchases: str = "purchases",
                          carts: str = "addToCarts", threshold: float = 0.70) -> DataFrame:
    """Share of a user's purchases and cart additions made under a campaign, on every row of the user."""
    acts = F.coalesce(F.col(purchases).cast("double"), F.lit(0.0)) + F.coalesce(F.col(carts).cast("double"), F.lit(0.0))
    promo = F.when(is_filled(campaign, UNSET_CAMPAIGN_TEXTS), acts).otherwise(0.0)
    users = df.groupBy(user).agg(F.count("*").alias("_w"), guarded_ratio(F.sum(promo), F.sum(acts)).alias("promotion_sensitivity"))
    rows = attach_group_stats(df, users, [user], "_w")
    score = clip(F.coalesce("promotion_sensitivity", F.lit(0.0)), 0.0, 1.0)
    return rows.withColumns({"promotion_sensitivity": score, "is_promo_sensitive": (score >= threshold).cast("int"),
                             "promo_label_threshold": F.lit(threshold), "target_source": F.lit("derived_campaign")})


ROLLS = (3, 7, 14, 28)


def item_days(rows: DataFrame) -> DataFrame:
    """Item events per item and day. ``rows``: item_id, day, views, carts, purchases, revenue, item_category."""
    known = rows.where(is_filled("item_id", ["", "nan"]) & F.col("day").isNotNull())
    return known.groupBy(F.trim("item_id").alias("item_id"), "day").agg(
        *[F.sum(c).cast("double").alias(c) for c in ("views", "carts", "purchases", "revenue")], F.min("item_category").alias("item_category"))


def rolling_sums(daily: DataFrame) -> DataFrame:
    """Trailing sums over the last 3, 7, 14 and 28 rows of an item, and the 7-row revenue."""
    line = Window.partitionBy("item_id").orderBy("day")
    sums = {f"{label}_roll_{w}": F.sum(c).over(line.rowsBetween(-(w - 1), 0))
            for c, label in (("purchases", "purchases"), ("views", "views"), ("carts", "atc")) for w in ROLLS}
    return daily.withColumns({**sums, "revenue_roll_7": F.sum("revenue").over(line.rowsBetween(-6, 0))})


def forward_sums(daily: DataFrame, horizon: int = 7) -> DataFrame:
    """Purchases and revenue on the ``horizon`` calendar days after each day, and whether those days
    all lie inside the data."""
    ahead = Window.partitionBy("item_id").orderBy(F.unix_date("day")).rangeBetween(1, horizon)
    end = daily.agg(F.max("day").alias("_end"))
    return with_scalars(daily, end).withColumns({
        "future_units_raw": F.coalesce(F.sum("purchases").over(ahead), F.lit(0.0)),
        "future_revenue": F.coalesce(F.sum("revenue").over(ahead), F.lit(0.0)),
        "future_target_complete": (F.col("day") <= F.date_sub("_end", horizon)).cast("int")}).drop("_end")


def expanding_baseline(daily: DataFrame, horizon: int = 7) -> DataFrame:
    past = Window.partitionBy("item_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("sku_demand_baseline", F.avg("purchases").over(past) * float(horizon))


def rolled_lags(panel: DataFrame, lags: Sequence[int] = (1, 7)) -> DataFrame:
    """Earlier values of the 7-row purchase sum, 0 before the first."""
    line = Window.partitionBy("item_id").orderBy("day")
    return panel.withColumns({f"purchases_lag_{k}": F.coalesce(F.lag("purchases_roll_7", k).over(line), F.lit(0.0)) for k in lags})


def item_day_panel(rows: DataFrame, inventory: DataFrame | None = None, horizon: int = 7, shrink: float = 0.30) -> DataFrame:
    """Demand panel: one row per item and day with trailing features and next-``horizon``-day purchases.

    The target is clamped at its 95th percentile and drawn ``shrink`` towards the item's own
    average; the raw value stays in ``future_units_raw``. All windows run over item-days.
    """
    daily = shared(item_days(rows))
    panel = shared(rolled_lags(expanding_baseline(forward_sums(rolling_sums(daily), horizon), horizon)))
    views, carts, bought = F.col("views_roll_7"), F.col("atc_roll_7"), F.col("purchases_roll_7")
    panel = panel.withColumns({
        "cartToViewRate": guarded_ratio(carts, views), "purchaseToViewRate": guarded_ratio(bought, views),
        "unit_price": F.greatest(guarded_ratio("revenue_roll_7", bought), F.lit(0.0)),
        "purchase_momentum": bought / (F.col("purchases_roll_28") / 4.0 + 1e-6),
        "day_of_week": F.weekday("day").cast("double")})
    panel = scaled_by_max(panel, {"_s1": F.col("cartToViewRate"), "_s2": F.col("purchaseToViewRate"), "_s3": views, "_s4": F.col("purchases_roll_14")})
    panel = panel.withColumn("demand_score", (F.col("_s1") + F.col("_s2") + F.col("_s3") + F.col("_s4")) / 4.0)
    cap = exact_quantiles(panel, "future_units_raw", {"_cap": 0.95})
    raw = F.col("future_units_raw")
    clamped = F.when((F.col("_cap") > 0) & (raw > F.col("_cap")), F.col("_cap")).otherwise(raw)
    target = clamped * (1.0 - shrink) + F.greatest("sku_demand_baseline", F.lit(0.0)) * shrink
    panel = with_scalars(panel, cap).withColumn("itemsPurchased_future", F.greatest(target, F.lit(0.0)))
    panel = encoded_texts(panel, {"item_id_enc": ("item_id",), "item_category_enc": ("item_category",)})
    panel = panel.withColumns({"itemsViewed": views, "itemsAddedToCart": carts, "history_purchases": bought,
                               "history_revenue": F.col("revenue_roll_7"), "target_source": F.lit("time_split")})
    panel = panel.drop("_s1", "_s2", "_s3", "_s4", "_cap", "views", "carts", "purchases", "revenue")
    return with_inventory(panel, inventory)


def with_inventory(panel: DataFrame, inventory: DataFrame | None) -> DataFrame:
    """Stock position per item where there is one, and whether there is."""
    if inventory is None:
        return panel.withColumn("erp_inventory_available", F.lit(0))
    known = inventory.withColumn("erp_inventory_available", F.lit(1))
    return panel.join(known, "item_id", "left").withColumn("erp_inventory_available", F.coalesce("erp_inventory_available", F.lit(0)))


def item_fallback(rows: DataFrame) -> DataFrame:
    """One row per item for data without usable dates; past purchases stand for future ones."""
    known = rows.where(is_filled("item_id", ["", "nan"]))
    item = shared(known.groupBy(F.trim("item_id").alias("item_id")).agg(
        F.sum("views").cast("double").alias("itemsViewed"), F.sum("carts").cast("double").alias("itemsAddedToCart"),
        F.sum("purchases").cast("double").alias("history_purchases"), F.sum("revenue").cast("double").alias("history_revenue")))
    out = item.withColumns({
        "cartToViewRate": guarded_ratio("itemsAddedToCart", "itemsViewed"), "purchaseToViewRate": guarded_ratio("history_purchases", "itemsViewed"),
        "unit_price": F.greatest(guarded_ratio("history_revenue", "history_purchases"), F.lit(0.0)),
        "itemsPurchased_future": F.col("history_purchases"), "target_source": F.lit("proxy")})
    out = scaled_by_max(out, {"_a": F.col("cartToViewRate"), "_b": F.col("purchaseToViewRate"), "_c": F.col("itemsViewed")})
    return out.withColumn("demand_score", (F.col("_a") + F.col("_b") + F.col("_c")) / 3.0).drop("_a", "_b", "_c")


def dated_share(df: DataFrame, day: str = "day") -> DataFrame:
    """Share of rows with a date; below 0.3 the daily panel gives way to ``item_fallback``."""
    return df.agg(F.avg(F.col(day).isNotNull().cast("double")).alias("dated_share"))


LEAST_DATED = 0.3


def item_demand(rows: DataFrame, inventory: DataFrame | None = None, day: str = "day") -> tuple[DataFrame, str]:
    """The item-day panel where at least ``LEAST_DATED`` of the rows have a date, else one row per item; and which of the two it is."""
    share = dated_share(rows, day).first()["dated_share"]
    if share is None or share < LEAST_DATED:
        return with_inventory(item_fallback(rows), inventory), "proxy"
    return item_day_panel(rows.where(F.col(day).isNotNull()), inventory), "time_split"
