"""The five star-schema views (V1–V5; J7, J8, A1–A7, D12, D15).

Each view is a function of the star tables returning a lazy DataFrame
(register it with ``createOrReplaceTempView`` if SQL users need the name).
The dimension sides are filtered to current versions before the join, so the
filter is pushed into their scans; the calendar is broadcast.  Money is summed
through decimal(18,2) so results do not depend on partitioning.

``history="current"`` (default) is the stated SQL: facts whose key points at
an expired version drop out (D15).  ``history="key"`` instead re-attaches
every fact to the current attributes through the business key.

``unique_orders=True`` says that no order id comes twice in ``fact_order``, as
``LiveWarehouse.unique`` and ``Star.unique`` prove: orders are then counted
without a row per order in the exchange, over items by their integer key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import mean, money_avg, money_sum


def _orders(unique_orders: bool) -> Column:
    """Distinct order ids of rows of ``fact_order`` itself."""
    return F.count("order_id") if unique_orders else F.count_distinct("order_id")


def _current(dim: DataFrame, sk: str, key: str, cols: list[str], history: str) -> DataFrame:
    cur = dim.where(F.col("is_current"))
    if history == "current":
        return cur.select(sk, *cols)
    # every version's sk → the attributes of the key's current version
    allv = dim.select(sk, key)
    return allv.join(cur.select(key, *cols), key).select(sk, *cols)


#: yyyymm, as stored facts lay their rows out (``plans.live``)
_YM = "year * 100 + month_number AS _ym"


def _by_day(fact: DataFrame, columns: list[str], day: str, days: DataFrame) -> DataFrame:
    """These columns of a fact with the calendar's on the key ``day``.  A fact
    stored by month is joined on the month too: with a filtered calendar Spark
    then reads the folders of its months only (dynamic partition pruning)."""
    on = F.col(day) == F.col("date_sk")
    if "month" not in fact.columns:
        return fact.select(*columns).join(days, on).drop("_ym")
    return fact.select(*columns, "month").join(days, on & (F.col("month") == F.col("_ym"))).drop("_ym", "month")


def _groups(rows: DataFrame, sk: str, names: list[str], gid: str) -> tuple[DataFrame, DataFrame]:
    """Number the distinct ``names`` of a dimension by their smallest key:
    (sk, gid) for the facts and (gid, names) for the result.  Facts then
    travel with one integer in place of texts; several keys with the same
    names are one group, as the view's SQL has it."""
    numbered = rows.withColumn(gid, F.min(sk).over(W.partitionBy(*names)))
    return numbered.select(sk, gid), numbered.where(F.col(sk) == F.col(gid)).select(gid, *names)


def _months(dim_date: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for the calendar's months; it is bounded, so broadcast."""
    months = dim_date.selectExpr("date_sk", "year", "month_name", _YM)
    numbered = months.withColumn("_month_id", F.min("date_sk").over(W.partitionBy("_ym")))
    names = numbered.where("date_sk = _month_id").select("_month_id", "year", "month_name")
    return F.broadcast(numbered.select("date_sk", "_month_id", "_ym")), F.broadcast(names)


def restaurant_order_performance(fact_order: DataFrame, dim_restaurant: DataFrame,
                                 dim_date: DataFrame, history: str = "current",
                                 unique_orders: bool = False) -> DataFrame:
    """V1: orders, revenue and tips per restaurant and month."""
    r = _current(dim_restaurant, "restaurant_sk", "restaurant_id",
                 ["restaurant_name", "cuisine_type", "city", "state"], history)
    keys, names = _groups(r, "restaurant_sk", ["restaurant_name", "cuisine_type", "city", "state"], "_gid")
    days, months = _months(dim_date)
    j = _by_day(fact_order, ["order_id", "restaurant_sk", "order_date_sk", "order_total", "tip_amount"],
                "order_date_sk", days).join(keys, "restaurant_sk")
    g = j.groupBy("_gid", "_month_id").agg(
        _orders(unique_orders).alias("total_orders"),
        money_sum("order_total").alias("total_revenue"),
        money_avg("order_total").alias("avg_order_value"),
        money_sum("tip_amount").alias("total_tips"),
        money_avg("tip_amount").alias("avg_tip_amount"))
    return g.join(names, "_gid").join(months, "_month_id").select(
        "restaurant_name", "cuisine_type", "city", "state", "year", "month_name",
        "total_orders", "total_revenue", "avg_order_value", "total_tips", "avg_tip_amount")


def delivery_performance(fact_delivery: DataFrame, dim_person: DataFrame,
                         dim_date: DataFrame, fact_rating: DataFrame,
                         mode: str = "per_order", history: str = "current") -> DataFrame:
    """V2: deliveries, mean duration and mean delivery rating per person and month.

    ``mode="per_order"`` (default) first reduces ratings to (sum, count) per
    order, so a delivery with several ratings is counted once (D12);
    ``mode="literal"`` is the plain left join of the stated SQL.
    """
    p = _current(dim_person, "delivery_person_sk", "delivery_person_id",
                 ["delivery_person_id"], history)
    persons, names = _groups(p, "delivery_person_sk", ["delivery_person_id"], "_gid")
    days, months = _months(dim_date)

    def named(rows: DataFrame) -> DataFrame:
        return rows.join(names, "_gid").join(months, "_month_id").select(
            "delivery_person_id", "year", "month_name", "total_deliveries", "avg_delivery_time",
            "avg_delivery_distance", "avg_delivery_rating")

    d = _by_day(fact_delivery, ["delivery_id", "order_sk", "delivery_person_sk", "delivery_date_sk",
                                "delivery_duration_minutes", "delivery_distance"],
                "delivery_date_sk", days).join(persons, "delivery_person_sk")
    keys = ["_gid", "_month_id"]
    if mode == "literal":
        j = d.join(fact_rating.select("order_sk", "delivery_rating"), "order_sk", "left")
        return named(j.groupBy(*keys).agg(
            F.count("delivery_id").alias("total_deliveries"),
            mean("delivery_duration_minutes").alias("avg_delivery_time"),
            mean("delivery_distance").alias("avg_delivery_distance"),
            mean("delivery_rating").alias("avg_delivery_rating")))
    per_order = (fact_rating.where(F.col("order_sk").isNotNull())
                 .groupBy("order_sk").agg(
                     F.sum("delivery_rating").alias("_rsum"),
                     F.count("delivery_rating").alias("_rcnt")))
    j = d.join(per_order, "order_sk", "left")
    return named(j.groupBy(*keys).agg(
        F.count("delivery_id").alias("total_deliveries"),
        mean("delivery_duration_minutes").alias("avg_delivery_time"),
        mean("delivery_distance").alias("avg_delivery_distance"),
        F.try_divide(F.sum("_rsum").cast("double"),
                     F.sum("_rcnt").cast("double")).alias("avg_delivery_rating")))


def customer_order_patterns(fact_order: DataFrame, dim_customer: DataFrame,
                            dim_date: DataFrame, dim_restaurant: DataFrame,
                            history: str = "current", unique_orders: bool = False) -> DataFrame:
    """V3: per customer and month — orders, spend, distinct restaurants (A2)."""
    c = _current(dim_customer, "customer_sk", "customer_id",
                 ["customer_id", "city", "state"], history)
    r = _current(dim_restaurant, "restaurant_sk", "restaurant_id", ["restaurant_id"], history)
    keys, names = _groups(c, "customer_sk", ["customer_id", "city", "state"], "_gid")
    served, _ = _groups(r, "restaurant_sk", ["restaurant_id"], "_rid")
    days, months = _months(dim_date)
    j = (_by_day(fact_order, ["order_id", "customer_sk", "restaurant_sk", "order_date_sk", "order_total"],
                 "order_date_sk", days)
         .join(keys, "customer_sk")
         .join(served, "restaurant_sk"))
    g = j.groupBy("_gid", "_month_id").agg(
        _orders(unique_orders).alias("total_orders"),
        money_sum("order_total").alias("total_spent"),
        money_avg("order_total").alias("avg_order_value"),
        F.count_distinct("_rid").alias("unique_restaurants_ordered"))
    return g.join(names, "_gid").join(months, "_month_id").select(
        "customer_id", "city", "state", "year", "month_name", "total_orders", "total_spent",
        "avg_order_value", "unique_restaurants_ordered")


def product_performance(fact_order_item: DataFrame, dim_product: DataFrame,
                        fact_order: DataFrame, dim_restaurant: DataFrame,
                        dim_date: DataFrame, history: str = "current",
                        unique_orders: bool = False) -> DataFrame:
    """V4: quantity, revenue and order count per product, restaurant and month."""
    p = _current(dim_product, "product_sk", "product_id",
                 ["product_name", "category", "restaurant_sk"], history)
    r = _current(dim_restaurant, "restaurant_sk", "restaurant_id", ["restaurant_name"], history)
    keys, names = _groups(p.join(r, "restaurant_sk"), "product_sk",
                          ["product_name", "category", "restaurant_name"], "_gid")
    days, months = _months(dim_date)
    o = _by_day(fact_order, ["order_sk", "order_id", "order_date_sk"], "order_date_sk", days)
    # of unique orders the integer stands for the id, which an order without one doesn't have
    number = F.when(F.col("order_id").isNotNull(), F.col("order_sk")) if unique_orders else F.col("order_id")
    o = o.select("order_sk", number.alias("_order"), "_month_id")
    j = (fact_order_item.select("order_sk", "product_sk", "quantity", "item_total")
         .join(keys, "product_sk")
         .join(o, "order_sk"))
    g = j.groupBy("_gid", "_month_id").agg(
        F.sum("quantity").cast("bigint").alias("total_quantity_sold"),
        money_sum("item_total").alias("total_revenue"),
        F.count_distinct("_order").alias("order_count"))
    return g.join(names, "_gid").join(months, "_month_id").select(
        "product_name", "category", "restaurant_name", "year", "month_name",
        "total_quantity_sold", "total_revenue", "order_count")


def promotion_effectiveness(fact_order: DataFrame, dim_promotion: DataFrame,
                            dim_date: DataFrame, history: str = "current",
                            unique_orders: bool = False) -> DataFrame:
    """V5: orders and revenue per promotion and month; revenue per order."""
    p = _current(dim_promotion, "promotion_sk", "promotion_id",
                 ["promotion_name", "discount_type", "discount_value"], history)
    keys, names = _groups(p, "promotion_sk", ["promotion_name", "discount_type", "discount_value"], "_gid")
    days, months = _months(dim_date)
    j = _by_day(fact_order, ["order_id", "promotion_sk", "order_date_sk", "order_total"],
                "order_date_sk", days).join(keys, "promotion_sk")
    g = j.groupBy("_gid", "_month_id").agg(
        _orders(unique_orders).alias("total_orders"),
        money_sum("order_total").alias("total_revenue"),
        money_avg("order_total").alias("avg_order_value"))
    return g.join(names, "_gid").join(months, "_month_id").select(
        "promotion_name", "discount_type", "discount_value", "year", "month_name", "total_orders", "total_revenue",
        "avg_order_value", F.try_divide("total_revenue", F.col("total_orders").cast("double")).alias("revenue_per_order"))


VIEW_NAMES = {
    "vw_restaurant_order_performance": "V1",
    "vw_delivery_performance": "V2",
    "vw_customer_order_patterns": "V3",
    "vw_product_performance": "V4",
    "vw_promotion_effectiveness": "V5",
}


def register_views(star, history: str = "current") -> list[str]:
    """Publish V1–V5 as named (re-creatable) temp views over a star —
    anything with ``fact(name)``, ``dim(name)`` and ``unique(name)``, e.g.
    ``plans.warehouse.Star`` — so SQL users can ``SELECT … FROM vw_…``."""
    f, d, unique = star.fact, star.dim, star.unique("order")
    frames = {
        "vw_restaurant_order_performance": restaurant_order_performance(
            f("order"), d("restaurant"), d("date"), history, unique),
        "vw_delivery_performance": delivery_performance(
            f("delivery"), d("delivery_person"), d("date"), f("rating"), history=history),
        "vw_customer_order_patterns": customer_order_patterns(
            f("order"), d("customer"), d("date"), d("restaurant"), history, unique),
        "vw_product_performance": product_performance(
            f("order_item"), d("product"), f("order"), d("restaurant"), d("date"), history, unique),
        "vw_promotion_effectiveness": promotion_effectiveness(
            f("order"), d("promotion"), d("date"), history, unique),
    }
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return list(frames)
