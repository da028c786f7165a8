"""Clean-layer projections.

Each function maps a stage DataFrame (source columns + provenance) onto the
clean layout.  ``batch_ts`` is one timestamp for the whole batch, used where
the warehouse called ``CURRENT_TIMESTAMP()`` (P11, X21).  All projections
are narrow (no shuffle) and stay inside one codegen stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as X
from ..functions.schemas import CLEAN_DDL, conform


def _ts(batch_ts: str):
    return F.lit(batch_ts).cast("timestamp_ntz")


def _scd_stamp(batch_ts: str) -> dict:
    t = _ts(batch_ts)
    return {"created_at": t, "updated_at": t, "effective_from": t,
            "effective_to": F.lit(None), "is_current": F.lit(True), "dw_created_at": t}


def _src(df: DataFrame) -> dict:
    return {"source_system": F.col("source_system")} if "source_system" in df.columns else {}


def clean_restaurants(stg: DataFrame, batch_ts: str) -> DataFrame:
    """Rename location columns, constant country, F1 key filter."""
    out = stg.where(F.col("loc_number").isNotNull()).select(
        F.col("loc_number").alias("restaurant_id"),
        F.col("loc_name").alias("restaurant_name"),
        F.col("cuisines").alias("cuisine_type"),
        "address",
        F.col("searched_city").alias("city"),
        F.col("searched_state").alias("state"),
        F.lit("USA").alias("country"),
        F.col("searched_zipcode").alias("postal_code"),
        "latitude", "longitude",
        F.col("phone").alias("phone_number"),
        "rating",
        *[v.alias(k) for k, v in {**_scd_stamp(batch_ts), **_src(stg)}.items()])
    return conform(out, CLEAN_DDL["restaurants"])


def clean_products(stg: DataFrame, batch_ts: str) -> DataFrame:
    """Money text → double (strips ``$`` and ``,``), default flags FALSE."""
    out = stg.select(
        F.col("id").alias("product_id"),
        "restaurant_id",
        F.col("name").alias("product_name"),
        "description", "category",
        X.parse_money("price").alias("price"),
        X.parse_money("cost").alias("cost"),
        F.lit(False).alias("is_vegetarian"),
        F.lit(False).alias("is_vegan"),
        F.lit(False).alias("is_gluten_free"),
        *[v.alias(k) for k, v in {**_scd_stamp(batch_ts), **_src(stg)}.items()])
    return conform(out, CLEAN_DDL["products"])


def clean_promotions(stg: DataFrame, batch_ts: str) -> DataFrame:
    """Rename, typed dates, 0/1 → boolean."""
    out = stg.select(
        "promotion_id",
        F.col("name").alias("promotion_name"),
        "description", "discount_type", "discount_value", "start_date", "end_date",
        "min_order_value", "max_discount", "restaurant_id",
        (F.col("is_active") != 0).alias("is_active"),
        *[v.alias(k) for k, v in {**_scd_stamp(batch_ts), **_src(stg)}.items()])
    return conform(out, CLEAN_DDL["promotions"])


def clean_customers(stg: DataFrame, batch_ts: str) -> DataFrame:
    """Rename, keep the referral link, null-pad contact columns."""
    out = stg.select(
        F.col("id").alias("customer_id"),
        "first_name", "last_name", "city", "referral_customer_id",
        *[v.alias(k) for k, v in {**_scd_stamp(batch_ts), **_src(stg)}.items()])
    return conform(out, CLEAN_DDL["customers"])


def clean_orders(stg: DataFrame, batch_ts: str) -> DataFrame:
    """P5: order header; restaurant/promotion/total come from the optional
    source columns (null when the extract lacks them)."""
    out = stg.select(
        F.col("id").alias("order_id"),
        "customer_id", "restaurant_id",
        F.col("created_at").alias("order_date"),
        F.col("updated_status").alias("order_status"),
        "order_total",
        F.col("tips").alias("tip_amount"),
        "promotion_id", "created_at", "updated_at",
        *[v.alias(k) for k, v in {"dw_created_at": _ts(batch_ts), **_src(stg)}.items()])
    return conform(out, CLEAN_DDL["orders"])


def clean_order_items(stg: DataFrame, batch_ts: str) -> DataFrame:
    """``item_total = price * item_quantity``."""
    t = _ts(batch_ts)
    out = stg.select(
        F.col("id").alias("order_item_id"),
        "order_id", "product_id",
        F.col("item_quantity").alias("quantity"),
        F.col("price").alias("unit_price"),
        (F.col("price") * F.col("item_quantity")).alias("item_total"),
        t.alias("created_at"), t.alias("updated_at"), t.alias("dw_created_at"),
        *[v.alias(k) for k, v in _src(stg).items()])
    return conform(out, CLEAN_DDL["order_items"])


def delivery_timestamps(stg: DataFrame) -> DataFrame:
    """The extract carries clock text only.  Pick-up = order day + order
    clock; delivered = order day + pick clock, rolled to the next day when the
    clock is earlier than the pick-up (a midnight crossing)."""
    d = stg.withColumns({"_day": X.parse_day("Order_Date"),
                         "_t0": X.parse_clock_seconds("Time_Orderd"),
                         "_t1": X.parse_clock_seconds("Time_Order_picked")})
    t0, t1 = F.col("_t0"), F.col("_t1")
    rolled = F.when(t1 < t0, t1 + 86400).otherwise(t1)
    return (d.withColumn("pickup_time", F.when(t0.isNotNull(), X.day_plus_seconds("_day", t0)))
             .withColumn("delivery_time", F.when(t0.isNotNull() & t1.isNotNull(),
                                                 X.day_plus_seconds("_day", rolled)))
             .drop("_t0", "_t1"))


def clean_delivery(stg: DataFrame, batch_ts: str) -> DataFrame:
    """Rename mixed-case columns, real timestamps."""
    d = delivery_timestamps(stg)
    day_ts = X.day_plus_seconds("_day", F.lit(0))
    out = d.select(
        F.col("ID").alias("delivery_id"),
        F.col("Order_ID").alias("order_id"),
        F.col("Delivery_person_ID").alias("delivery_person_id"),
        "pickup_time", "delivery_time",
        F.col("Weatherconditions").alias("weather_conditions"),
        F.col("Road_traffic_density").alias("traffic_density"),
        F.col("Type_of_vehicle").alias("vehicle_type"),
        *([F.col("Distance").alias("delivery_distance")] if "Distance" in d.columns else []),
        day_ts.alias("created_at"), day_ts.alias("updated_at"),
        _ts(batch_ts).alias("dw_created_at"),
        *[v.alias(k) for k, v in _src(d).items()])
    return conform(out, CLEAN_DDL["delivery"])


def clean_ratings(stg_orders: DataFrame, batch_ts: str) -> DataFrame:
    """One rating row per rated order row; id = order id + '-rating';
    the restaurant is the order's."""
    have = [c for c in ("restaurant_id", "delivery_rating") if c in stg_orders.columns]
    out = stg_orders.where(F.col("rating").isNotNull()).select(
        F.concat(F.col("id"), F.lit("-rating")).alias("rating_id"),
        F.col("id").alias("order_id"),
        "customer_id", *have,
        F.col("rating").alias("overall_rating"),
        F.col("updated_at").alias("created_at"),
        _ts(batch_ts).alias("dw_created_at"),
        *[v.alias(k) for k, v in _src(stg_orders).items()])
    return conform(out, CLEAN_DDL["ratings"])


CLEANERS = {
    "restaurants": clean_restaurants,
    "products": clean_products,
    "promotions": clean_promotions,
    "customers": clean_customers,
    "orders": clean_orders,
    "order_items": clean_order_items,
    "delivery": clean_delivery,
}
