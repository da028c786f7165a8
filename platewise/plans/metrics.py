"""Dashboard datasets K1–K9 and their filters.

Inputs are clean-layer frames (orders, delivery, restaurants) or star tables.
Filters are plain column predicates applied before any aggregate, so Catalyst
pushes them into the Parquet scan.  Delivery minutes are carried in whole
seconds and averaged as exact integer sums, so means do not depend on the
order rows are added in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as X
from ..functions.schemas import require_columns


@dataclass(frozen=True)
class Filters:
    """Dashboard filter state (F10, F11); ``None`` or ``"All"`` = no filter."""
    start: str | None = None
    end: str | None = None
    city: str | None = None
    cuisine: str | None = None
    weather: str | None = None


def _active(v: str | None) -> bool:
    return v is not None and v != "All"


def date_range_predicate(c: Column, start: str | None, end: str | None) -> Column | None:
    """Inclusive date range on a timestamp/date column."""
    pred = None
    if start is not None:
        pred = c >= F.lit(start).cast("date")
    if end is not None:
        p2 = c < F.date_add(F.lit(end).cast("date"), 1)
        pred = p2 if pred is None else pred & p2
    return pred


def last_days_window(df: DataFrame, col: str, days: int = 30) -> tuple[str, str]:
    """Default range: the last ``days`` days of data (F14).  One small
    aggregate; the bounds come back as literals so the main query can push
    them into its scan."""
    hi = df.agg(F.max(F.to_date(col))).first()[0]
    if hi is None:
        return None, None
    import datetime as _dt
    return str(hi - _dt.timedelta(days=days - 1)), str(hi)


def apply_filters(df: DataFrame, f: Filters, date_col: str | None = None,
                  city_col: str | None = None, cuisine_col: str | None = None,
                  weather_col: str | None = None) -> DataFrame:
    """Fold the active filters with ``&`` (F11); inactive ones add nothing."""
    preds = []
    if date_col:
        p = date_range_predicate(F.col(date_col), f.start, f.end)
        if p is not None:
            preds.append(p)
    for v, c in ((f.city, city_col), (f.cuisine, cuisine_col), (f.weather, weather_col)):
        if c and _active(v):
            preds.append(F.col(c) == F.lit(v))
    for p in preds:
        df = df.where(p)
    return df


# --- K1 -----------------------------------------------------------------------

def daily_orders(orders: DataFrame, f: Filters = Filters()) -> DataFrame:
    """Orders per calendar day, sorted by day."""
    require_columns(orders, ["order_date"], "daily orders")
    o = apply_filters(orders, f, date_col="order_date")
    return (o.where(F.col("order_date").isNotNull())
             .groupBy(F.to_date("order_date").alias("date"))
             .agg(F.count(F.lit(1)).alias("order_count"))
             .orderBy("date"))


# --- K2 -----------------------------------------------------------------------

def delivery_seconds(stg_delivery: DataFrame) -> Column:
    """Clock-only elapsed seconds between order and pick-up text (X23, F16);
    null unless both parse."""
    t0 = X.parse_clock_seconds("Time_Orderd")
    t1 = X.parse_clock_seconds("Time_Order_picked")
    return t1 - t0


def delivery_minutes(stg_delivery: DataFrame, f: Filters = Filters()) -> DataFrame:
    """K2: minutes per delivery row, abs then clipped to [5, 120]; rows whose
    times do not parse keep null (X24, X25, D9).  The weather filter (F11)
    applies here, before any aggregate."""
    require_columns(stg_delivery, ["ID", "Weatherconditions", "Road_traffic_density",
                                   "Time_Orderd", "Time_Order_picked"], "delivery minutes")
    stg_delivery = apply_filters(stg_delivery, f, weather_col="Weatherconditions")
    d = stg_delivery.withColumn("_secs", delivery_seconds(stg_delivery))
    d = d.withColumn("_clip_secs", X.clip_abs("_secs", 300, 7200))
    return d.select(
        F.col("ID").alias("delivery_id"),
        F.col("Weatherconditions").alias("weather_conditions"),
        F.col("Road_traffic_density").alias("traffic_density"),
        F.col("_clip_secs").cast("bigint").alias("delivery_seconds"),
        (F.col("_clip_secs") / 60.0).alias("delivery_time_minutes"))


def _mean_minutes(secs: str = "delivery_seconds") -> Column:
    return F.try_divide(F.sum(secs).cast("double"), F.count(secs).cast("double")) / 60.0


# --- K3 -----------------------------------------------------------------------

def status_distribution(orders: DataFrame) -> DataFrame:
    """Value counts of order status, descending; null status dropped (A10)."""
    require_columns(orders, ["order_status"], "status distribution")
    return (orders.where(F.col("order_status").isNotNull())
            .groupBy(F.col("order_status").alias("status"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "status"))


# --- K4, K5 ---------------------------------------------------------------------

def weather_impact(minutes: DataFrame) -> DataFrame:
    """Mean delivery minutes per weather condition."""
    return (minutes.where(F.col("weather_conditions").isNotNull())
            .groupBy("weather_conditions")
            .agg(_mean_minutes().alias("avg_delivery_minutes")))


def traffic_impact(minutes: DataFrame) -> DataFrame:
    """Mean delivery minutes per traffic density, in Low < Medium < High < Jam
    order when every level is known, else by name (O4)."""
    g = (minutes.where(F.col("traffic_density").isNotNull())
         .groupBy("traffic_density")
         .agg(_mean_minutes().alias("avg_delivery_minutes")))
    rank = X.ordinal("traffic_density", X.TRAFFIC_ORDER)
    all_known = F.min(rank.isNotNull().cast("int")).over(Window.partitionBy())
    # the window spans the grouped rows only (one per density level)
    return (g.withColumn("_r", rank).withColumn("_ok", all_known)
             .orderBy(F.when(F.col("_ok") == 1, F.col("_r")), "traffic_density")
             .drop("_r", "_ok"))


# --- K6 -----------------------------------------------------------------------

def top_restaurants(restaurants: DataFrame, n: int = 10, f: Filters = Filters()) -> DataFrame:
    """Top ``n`` by rating; ties broken by id (O2 → TakeOrderedAndProject);
    city and cuisine filters (F11) apply first."""
    require_columns(restaurants, ["restaurant_id", "restaurant_name", "cuisine_type", "rating"],
                    "top restaurants")
    restaurants = apply_filters(restaurants, f, city_col="city", cuisine_col="cuisine_type")
    return (restaurants.where(F.col("rating").isNotNull())
            .select("restaurant_id", "restaurant_name", "cuisine_type", "rating")
            .orderBy(F.desc("rating"), "restaurant_id").limit(n))


# --- K7 -----------------------------------------------------------------------

def kpi_row(orders: DataFrame, minutes: DataFrame) -> DataFrame:
    """Total orders, mean delivery minutes, mean rating, mean tip.

    Both inputs are stacked into one frame and aggregated once: no join,
    one partial aggregate per task."""
    require_columns(orders, ["rating", "tip_amount"], "KPI row")
    o = orders.select(F.lit(1).alias("_is_order"), F.col("rating").alias("_rating"),
                      F.col("tip_amount").alias("_tip"),
                      F.lit(None).cast("bigint").alias("delivery_seconds"))
    m = minutes.select(F.lit(0).alias("_is_order"), F.lit(None).cast("int").alias("_rating"),
                       F.lit(None).cast("double").alias("_tip"), "delivery_seconds")
    u = o.unionByName(m)
    return u.agg(
        F.sum("_is_order").cast("bigint").alias("total_orders"),
        _mean_minutes().alias("avg_delivery_minutes"),
        F.try_divide(F.sum("_rating").cast("double"),
                     F.count("_rating").cast("double")).alias("avg_rating"),
        X.money_avg("_tip").alias("avg_tip"))


# --- K8 -----------------------------------------------------------------------

def monthly_orders(orders: DataFrame) -> DataFrame:
    """Orders per month."""
    require_columns(orders, ["order_date"], "monthly orders")
    return (orders.where(F.col("order_date").isNotNull())
            .groupBy(F.trunc(F.to_date("order_date"), "month").alias("month"))
            .agg(F.count(F.lit(1)).alias("order_count")))


def mom_growth(orders: DataFrame) -> DataFrame:
    """Last month's order count against the month before, in percent.
    Fewer than two months → null growth.  The window runs over the monthly
    aggregate (one row per month), never over order rows."""
    m = monthly_orders(orders)
    w = Window.orderBy("month")
    g = m.withColumn("previous_count", F.lag("order_count").over(w))
    g = g.withColumn("mom_growth_pct",
                     F.try_divide((F.col("order_count") - F.col("previous_count")).cast("double"),
                                  F.col("previous_count").cast("double")) * 100.0)
    return g.orderBy(F.desc("month")).limit(1)


# --- K9 -----------------------------------------------------------------------

def top_promotions(fact_order: DataFrame, dim_promotion: DataFrame, n: int = 10) -> DataFrame:
    """Active promotions ranked by order volume (F12, O3); from the facts,
    not invented numbers."""
    p = (dim_promotion.where(F.col("is_current") & F.col("is_active"))
         .select("promotion_sk", "promotion_name", "discount_type", "discount_value"))
    j = fact_order.select("order_id", "promotion_sk", "order_total").join(p, "promotion_sk")
    g = j.groupBy("promotion_name", "discount_type", "discount_value").agg(
        F.count_distinct("order_id").alias("orders"),
        X.money_sum("order_total").alias("revenue"),
        X.money_avg("order_total").alias("avg_order_value"))
    return g.orderBy(F.desc("orders"), "promotion_name").limit(n)


# --- F13, F14 -------------------------------------------------------------------

def filter_choices(restaurants: DataFrame, delivery: DataFrame) -> DataFrame:
    """Choice lists for the dashboard filters: 'All' plus the sorted distinct
    values of city, cuisine and weather (F13)."""
    parts = [
        restaurants.select(F.lit("city").alias("filter"), F.col("city").alias("value")),
        restaurants.select(F.lit("cuisine").alias("filter"), F.col("cuisine_type").alias("value")),
        delivery.select(F.lit("weather").alias("filter"),
                        F.col("weather_conditions").alias("value")),
    ]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    vals = u.where(F.col("value").isNotNull()).distinct()
    alls = vals.select("filter").distinct().withColumn("value", F.lit("All"))
    return (alls.unionByName(vals)
            .withColumn("_first", F.col("value") == "All")
            .orderBy("filter", F.desc("_first"), "value").drop("_first"))


def date_bounds(orders: DataFrame) -> DataFrame:
    """Earliest and latest order day."""
    return orders.agg(F.min(F.to_date("order_date")).alias("min_date"),
                      F.max(F.to_date("order_date")).alias("max_date"))
