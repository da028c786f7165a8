"""Marketplace extracts derived from the driver's TPC-H-style tables.

The warehouse reads eight CSV extracts (restaurants, products, promotions,
customers, orders, order items, deliveries, plus a second restaurant feed).
For runs over ``/root/testdata`` each extract is derived from the parquet
tables with the mapping below; every function returns a frame in the
*source* layout (``functions.schemas.SOURCE_DDL``), so the same clean,
dimension and fact code runs on both.  All mappings are narrow projections or
key-wise joins/aggregates, so their cost grows linearly with the tables.

mapping:
  restaurant  ← supplier ⋈ nation ⋈ region
  product     ← part; restaurant = min(l_suppkey) of the part's lines
  promotion   ← the order priorities (one per priority)
  customer    ← customer ⋈ nation
  order       ← orders; restaurant = min(l_suppkey) of its lines (none → null),
                rating and delivery rating = event with event_id = o_orderkey
                unless it is an error
  order item  ← lineitem (unit price = extended price / quantity)
  delivery    ← events (person = user, pick-up = ts + value minutes, distance
                in quarters, so that sums are exact)
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.schemas import SOURCE_DDL, conform

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

# Fixed values for the mapping (stated once, in natural order).
STATUS_NAMES = {"F": "Delivered", "O": "In Progress", "P": "Preparing"}
WEATHER_BY_EVENT = {"view": "Sunny", "click": "Cloudy", "signup": "Windy",
                    "purchase": "Stormy", "error": "Foggy"}
VEHICLES = ["motorcycle", "scooter", "electric_scooter"]
ORDER_KINDS = ["Snack", "Meal", "Drinks", "Buffet"]
DISCOUNT_TYPES = ["percentage", "fixed", "bogo"]


class Tables:
    """Lazy handles on the driver parquet tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))
        return self._cache[name]


def _s(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _pick(idx, values: list[str]) -> F.Column:
    out = F.lit(None).cast("string")
    for i, v in reversed(list(enumerate(values))):
        out = F.when(idx == i, F.lit(v)).otherwise(out)
    return out


def _case(col, mapping: dict[str, str]) -> F.Column:
    out = F.lit(None).cast("string")
    for k, v in reversed(list(mapping.items())):
        out = F.when(col == F.lit(k), F.lit(v)).otherwise(out)
    return out


def restaurants(t: Tables) -> DataFrame:
    geo = t.nation.join(t.region, t.nation.n_regionkey == t.region.r_regionkey)
    df = t.supplier.join(geo, t.supplier.s_nationkey == geo.n_nationkey).select(
        _s("s_suppkey").alias("loc_number"),
        F.col("s_name").alias("loc_name"),
        F.concat(F.lit("C"), _s(F.col("s_suppkey") % 5)).alias("cuisines"),
        F.col("n_name").alias("searched_city"),
        F.col("r_name").alias("searched_state"),
        F.lpad(_s("s_nationkey"), 5, "0").alias("searched_zipcode"),
        F.col("s_acctbal").alias("rating"),
        F.col("s_nationkey"))
    return df


def restaurants_split(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Two restaurant feeds (S7): suppliers of nations 0–11 arrive in the
    main extract, the rest in the second feed with its own column names."""
    r = restaurants(t)
    main = conform(r.where(F.col("s_nationkey") < 12), SOURCE_DDL["restaurants"])
    other = r.where(F.col("s_nationkey") >= 12).select(
        F.col("loc_number").alias("res_id"), F.col("loc_name").alias("res_name"),
        "cuisines", F.col("searched_city").alias("city"),
        F.col("searched_state").alias("state"), F.col("searched_zipcode").alias("zipcode"),
        F.col("rating").alias("aggregate_rating"))
    return main, conform(other, SOURCE_DDL["restaurants_feed2"])


def products(t: Tables) -> DataFrame:
    seller = t.lineitem.groupBy("l_partkey").agg(F.min("l_suppkey").alias("_supp"))
    df = t.part.join(seller, t.part.p_partkey == seller.l_partkey, "left").select(
        _s("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("description"),
        F.concat(F.lit("$"), F.format_number("p_retailprice", 2)).alias("price"),
        F.concat(F.lit("$"), _s("p_size"), F.lit(".50")).alias("cost"),
        _s("_supp").alias("restaurant_id"),
        F.col("p_type").alias("category"))
    return conform(df, SOURCE_DDL["products"])


def promotions(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_orderpriority").agg(
        F.min("o_orderdate").alias("_lo"), F.max("o_orderdate").alias("_hi"))
    pid = F.substring("o_orderpriority", 1, 1)
    n = pid.try_cast("int")
    df = g.select(
        pid.alias("promotion_id"),
        F.col("o_orderpriority").alias("name"),
        F.concat(F.lit("Orders of priority "), F.col("o_orderpriority")).alias("description"),
        _pick((n - 1) % 3, DISCOUNT_TYPES).alias("discount_type"),
        (n * 5).cast("double").alias("discount_value"),
        F.to_date("_lo").alias("start_date"),
        F.to_date("_hi").alias("end_date"),
        (n * 10).cast("double").alias("min_order_value"),
        F.when(n < 4, n * 20).cast("double").alias("max_discount"),
        F.when(n % 2 == 1, _s(n)).alias("restaurant_id"),
        F.when(pid == "5", 0).otherwise(1).alias("is_active"))
    return conform(df, SOURCE_DDL["promotions"])


def customers(t: Tables) -> DataFrame:
    df = t.customer.join(t.nation, t.customer.c_nationkey == t.nation.n_nationkey).select(
        _s("c_custkey").alias("id"),
        F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first_name"),
        F.split_part("c_name", F.lit("#"), F.lit(2)).alias("last_name"),
        F.col("n_name").alias("city"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey"))
    return df


def orders(t: Tables) -> DataFrame:
    seller = t.lineitem.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("_supp"))
    rated = t.events.where(F.col("event_type") != "error").select(
        F.col("event_id").alias("_eid"),
        (F.get_json_object("props", "$.k").cast("int") % 5 + 1).alias("_rating"),
        (F.get_json_object("props", "$.k").cast("int") % 4 + 2).alias("_drating"))
    o = t.orders
    df = (o.join(seller, o.o_orderkey == seller.l_orderkey, "left")
           .join(rated, o.o_orderkey == rated._eid, "left")
           .select(
               _s("o_orderkey").alias("id"),
               _s("o_custkey").alias("customer_id"),
               F.col("o_orderdate").alias("created_at"),
               F.col("o_orderdate").alias("updated_at"),
               _case(F.col("o_orderstatus"), STATUS_NAMES).alias("updated_status"),
               (F.floor(F.col("o_totalprice") * 5) / 100).alias("tips"),
               F.col("_rating").alias("rating"),
               _s("_supp").alias("restaurant_id"),
               F.substring("o_orderpriority", 1, 1).alias("promotion_id"),
               F.col("o_totalprice").alias("order_total"),
               F.col("_drating").alias("delivery_rating")))
    return conform(df, SOURCE_DDL["orders"])


def order_items(t: Tables) -> DataFrame:
    li = t.lineitem
    df = li.select(
        F.concat_ws("-", _s("l_orderkey"), _s("l_linenumber")).alias("id"),
        _s("l_orderkey").alias("order_id"),
        _s("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("item_quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return conform(df, SOURCE_DDL["order_items"])


def delivery(t: Tables) -> DataFrame:
    e = t.events.withColumn("_k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("_k")
    picked = F.timestamp_add("SECOND", F.floor(F.col("value") * 60), F.col("ts"))

    def clock(c):  # 'HH:mm:ss' without a time-zone round trip
        return F.format_string("%02d:%02d:%02d", F.hour(c), F.minute(c), F.second(c))

    df = e.select(
        _s("event_id").alias("ID"),
        _s("user_id").alias("Delivery_person_ID"),
        clock(F.col("ts")).alias("Time_Orderd"),
        F.when(F.col("event_type") == "error", F.lit("NaN"))
         .otherwise(clock(picked)).alias("Time_Order_picked"),
        _case(F.col("event_type"), WEATHER_BY_EVENT).alias("Weatherconditions"),
        F.when(k < 25, "Low").when(k < 50, "Medium").when(k < 75, "High")
         .otherwise("Jam").alias("Road_traffic_density"),
        _pick(F.col("user_id") % 3, VEHICLES).alias("Type_of_vehicle"),
        F.format_string("%02d-%02d-%04d", F.dayofmonth("ts"), F.month("ts"),
                        F.year("ts")).alias("Order_Date"),
        _pick(k % 4, ORDER_KINDS).alias("Type_of_order"),
        (k % 3).alias("multiple_deliveries"),
        _s("event_id").alias("Order_ID"),
        ((k % 40) * 0.25 + 0.5).alias("Distance"))
    return conform(df, SOURCE_DDL["delivery"])


def customers_source(t: Tables) -> DataFrame:
    return conform(customers(t), SOURCE_DDL["customers"])


def restaurants_source(t: Tables) -> DataFrame:
    return conform(restaurants(t), SOURCE_DDL["restaurants"])


SOURCES = {
    "restaurants": restaurants_source,
    "products": products,
    "promotions": promotions,
    "customers": customers_source,
    "orders": orders,
    "order_items": order_items,
    "delivery": delivery,
}
