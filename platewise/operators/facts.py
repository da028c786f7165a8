"""Fact builders (D-FO, D-FOI, D-FD, D-FR; joins J1–J6).

Each builder is one scan of its clean table plus left joins:

* dimension lookups take the *current* version of the business key (J1);
  the join strategy is left to the planner — it broadcasts a side whose
  estimated size is under ``spark.sql.autoBroadcastJoinThreshold`` and AQE
  re-plans at runtime from real shuffle sizes; a large customer dimension is
  shuffle-joined, with AQE splitting a hot key;
* date and time lookups are computed keys (``to_date``, minute of day) against
  the calendar dimensions, whose size is bounded by the calendar span, so they
  are always broadcast (J2–J4);
* fact → fact links (item → order, delivery/rating → order) shuffle on the
  order id (J5, J6).

Surrogate keys are assigned on the clean rows *before* the lookups (as the
clean tables carry the auto-increment key in the warehouse design), so the
key step covers only the narrow clean input, never the joins.  Rows that come
with a surrogate key (or, without ``fact_order_df``, with ``order_sk``) keep it.
``key_mode="ordered"`` (default) numbers in business id order (a range
sort and a written copy; reproducible whatever the file layout);
``key_mode="stored"`` numbers a clean table read from storage in its stored
order — no shuffle and no copy, the choice for very large facts.

``versions="as_of"`` looks up the version valid at the fact's own time in all
versions of a dimension (``asof``), for facts that arrive late or are rebuilt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as X
from ..functions.schemas import FACT_DDL, conform
from .asof import with_version_as_of
from .dims import current_keys
from .keys import assign_keys


#: The order in which each fact's rows are numbered.
ORDER = {
    "order": ["order_id", "customer_id", "order_date"],
    "order_item": ["order_item_id", "order_id", "product_id", "quantity", "unit_price"],
    "delivery": ["delivery_id", "order_id", "pickup_time"],
    "rating": ["rating_id", "created_at", "order_id", "overall_rating"],
}


def _date_key(dim_date: DataFrame, alias: str) -> DataFrame:
    return F.broadcast(dim_date.select(F.col("date_id").alias(f"_{alias}_d"),
                                       F.col("date_sk").alias(alias)))


def _time_key(dim_time: DataFrame, alias: str) -> DataFrame:
    return F.broadcast(dim_time.select(F.col("minute_of_day").alias(f"_{alias}_m"),
                                       F.col("time_sk").alias(alias)))


def with_date_time_keys(df: DataFrame, ts_col: str, dim_date: DataFrame, dim_time: DataFrame,
                        date_alias: str, time_alias: str) -> DataFrame:
    """Role-playing lookup of one timestamp column."""
    d = _date_key(dim_date, date_alias)
    t = _time_key(dim_time, time_alias)
    out = df.join(d, F.to_date(F.col(ts_col)) == F.col(f"_{date_alias}_d"), "left")
    out = out.join(t, X.minute_of_day(ts_col) == F.col(f"_{time_alias}_m"), "left")
    return out.drop(f"_{date_alias}_d", f"_{time_alias}_m")


def _keys(df: DataFrame, key_col: str, order: list[str], offset: int, key_mode: str
          ) -> DataFrame:
    assert key_mode in ("ordered", "stored"), key_mode
    if key_col in df.columns:  # of rows stored before; only the others are sorted and numbered
        fresh = _keys(df.where(F.col(key_col).isNull()).drop(key_col), key_col, order, offset, key_mode)
        return fresh.unionByName(df.where(F.col(key_col).isNotNull()))
    return assign_keys(df, key_col, order, offset=offset, frozen=key_mode == "stored")


def _with_order(df: DataFrame, fact_order_df: DataFrame | None, how: str) -> DataFrame:
    """The order's key; rows that are linked already (no
    ``fact_order_df``) keep theirs."""
    if fact_order_df is None:
        return df.where(F.col("order_sk").isNotNull()) if how == "inner" else df
    o = fact_order_df.select(F.col("order_id").alias("_oid"), "order_sk")
    return df.join(o, df.order_id == o._oid, how).drop("_oid")


def _lookup(df: DataFrame, dim: DataFrame, fk: str, key: str, sk: str) -> DataFrame:
    cur = current_keys(dim, key, sk).withColumnRenamed(key, f"_{sk}_k")
    return df.join(cur, df[fk] == cur[f"_{sk}_k"], "left").drop(f"_{sk}_k")


def fact_order(orders: DataFrame, dim_customer: DataFrame, dim_restaurant: DataFrame,
               dim_promotion: DataFrame, dim_date: DataFrame, dim_time: DataFrame,
               batch_ts: str, key_offset: int = 0, key_mode: str = "ordered",
               versions: str = "current") -> DataFrame:
    """``key_offset``: largest ``order_sk`` already issued (incremental loads).
    ``versions``: "current", or "as_of" for those valid at ``order_date``."""
    assert versions in ("current", "as_of"), versions
    f = _keys(orders, "order_sk", ORDER["order"], key_offset, key_mode)
    for dim, key, sk in ((dim_customer, "customer_id", "customer_sk"), (dim_restaurant, "restaurant_id", "restaurant_sk"),
                         (dim_promotion, "promotion_id", "promotion_sk")):
        f = (_lookup(f, dim, key, key, sk) if versions == "current" else
             with_version_as_of(f, dim, key, "order_date", key, sk))
    f = with_date_time_keys(f, "order_date", dim_date, dim_time, "order_date_sk", "order_time_sk")
    f = f.withColumn("dw_created_at", F.lit(batch_ts).cast("timestamp_ntz"))
    return conform(f, FACT_DDL["order"])


def fact_order_item(items: DataFrame, fact_order_df: DataFrame | None, dim_product: DataFrame,
                    batch_ts: str, key_offset: int = 0, key_mode: str = "ordered") -> DataFrame:
    f = _keys(items, "order_item_sk", ORDER["order_item"], key_offset, key_mode)
    f = _with_order(f, fact_order_df, "inner")  # J5
    f = _lookup(f, dim_product, "product_id", "product_id", "product_sk")
    f = f.withColumn("dw_created_at", F.lit(batch_ts).cast("timestamp_ntz"))
    return conform(f, FACT_DDL["order_item"])


def fact_delivery(delivery: DataFrame, fact_order_df: DataFrame | None, dim_person: DataFrame,
                  dim_date: DataFrame, dim_time: DataFrame, batch_ts: str,
                  key_offset: int = 0, key_mode: str = "ordered") -> DataFrame:
    f = _keys(delivery, "delivery_sk", ORDER["delivery"], key_offset, key_mode)
    f = _with_order(f, fact_order_df, "left")  # J6
    f = _lookup(f, dim_person, "delivery_person_id", "delivery_person_id", "delivery_person_sk")
    f = with_date_time_keys(f, "pickup_time", dim_date, dim_time,
                            "pickup_date_sk", "pickup_time_sk")
    f = with_date_time_keys(f, "delivery_time", dim_date, dim_time,
                            "delivery_date_sk", "delivery_time_sk")
    f = (f.withColumn("delivery_duration_minutes",
                      X.minute_boundaries("pickup_time", "delivery_time"))
          .withColumn("dw_created_at", F.lit(batch_ts).cast("timestamp_ntz")))
    return conform(f, FACT_DDL["delivery"])


def person_of_order(fact_delivery_df: DataFrame) -> DataFrame:
    """(_osk, _person): the delivery person of each order; of several
    deliveries the last by id, in whatever order they arrived."""
    return (fact_delivery_df.where(F.col("order_sk").isNotNull()).groupBy(F.col("order_sk").alias("_osk"))
            .agg(F.max_by("delivery_person_sk", F.struct("delivery_id", "delivery_sk")).alias("_person")))


def fact_rating(ratings: DataFrame, fact_order_df: DataFrame | None, dim_customer: DataFrame,
                dim_restaurant: DataFrame, dim_person: DataFrame, dim_date: DataFrame,
                dim_time: DataFrame, batch_ts: str, key_offset: int = 0,
                key_mode: str = "ordered", fact_delivery_df: DataFrame | None = None) -> DataFrame:
    """``fact_delivery_df``: deliveries whose person a rating takes that names
    none itself (``person_of_order``)."""
    f = _keys(ratings, "rating_sk", ORDER["rating"], key_offset, key_mode)
    f = _with_order(f, fact_order_df, "left")  # J6
    f = _lookup(f, dim_customer, "customer_id", "customer_id", "customer_sk")
    f = _lookup(f, dim_restaurant, "restaurant_id", "restaurant_id", "restaurant_sk")
    f = _lookup(f, dim_person, "delivery_person_id", "delivery_person_id", "delivery_person_sk")
    f = with_date_time_keys(f, "created_at", dim_date, dim_time,
                            "rating_date_sk", "rating_time_sk")
    if fact_delivery_df is not None:
        person = person_of_order(fact_delivery_df)
        f = f.join(person, f.order_sk == person._osk, "left").withColumn(
            "delivery_person_sk", F.coalesce("delivery_person_sk", "_person")).drop("_osk", "_person")
    f = f.withColumn("dw_created_at", F.lit(batch_ts).cast("timestamp_ntz"))
    return conform(f, FACT_DDL["rating"])
