"""Registry of named queries over the driver tables.

Every entry takes ``(spark, sf_dir)`` and returns a DataFrame computed from
the whole parquet tables of that scale factor (through the mapping in
``sources.testdata``).  Column names match ``plans.oracle``.  Queries that
exercise file round trips or streaming write their intermediate files under
the shared checkpoint folder (``session.scratch_path``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import money_sum
from ..functions.schemas import SOURCE_DDL, conform
from ..operators import audits, clean as C, dims, facts, scd2
from ..session import scratch_path
from ..sources import csv as csvsrc
from ..sources import store, testdata
from ..streaming import incremental
from . import metrics as K
from . import views
from .audit_log import AuditLog
from .live import LiveWarehouse
from .load import StoredStar, full_load
from .warehouse import CLEAN_OF_DIM, DEFAULT_BATCH_TS, Star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Batch times of the two-snapshot SCD2 scenario.
SNAPSHOT_TS = ["2025-01-01 00:00:00", "2025-02-01 00:00:00"]


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def tables(spark: SparkSession, sf_dir: str) -> testdata.Tables:
    return testdata.Tables(spark, sf_dir)


def star(spark: SparkSession, sf_dir: str, batch_ts: str = DEFAULT_BATCH_TS,
         materialize: bool = True) -> Star:
    t = tables(spark, sf_dir)
    stage = {name: fn(t) for name, fn in testdata.SOURCES.items()}
    return Star(stage, batch_ts, materialize=materialize, joined=("orders", "products", "promotions"),
                narrow=("order_items",))


# ------------------------------------------------------------ calendar -----

@query("dim_date")
def q_dim_date(spark, sf_dir):
    return star(spark, sf_dir).dim("date")


@query("deliveries_by_time_of_day")
def q_deliveries_by_time_of_day(spark, sf_dir):
    """J3 + D-TIME: pick-ups per minute-grain time bucket attributes."""
    s = star(spark, sf_dir)
    t = F.broadcast(s.dim("time").select("time_sk", "hour_of_day", "am_pm",
                                         "time_of_day_category"))
    f = s.fact("delivery").select("delivery_id", "pickup_time_sk")
    return (f.join(t, f.pickup_time_sk == t.time_sk)
            .groupBy("hour_of_day", "am_pm", "time_of_day_category")
            .agg(F.count(F.lit(1)).alias("deliveries")))


# --------------------------------------------------------------- clean -----

_CLEAN_COLS = {
    "restaurants": ["restaurant_id", "restaurant_name", "cuisine_type", "address", "city",
                    "state", "country", "postal_code", "latitude", "longitude",
                    "phone_number", "email", "operating_hours", "rating", "effective_from",
                    "is_current"],
    "products": ["product_id", "restaurant_id", "product_name", "description", "category",
                 "price", "cost", "is_vegetarian", "is_vegan", "is_gluten_free", "calories",
                 "preparation_time"],
    "promotions": ["promotion_id", "promotion_name", "description", "discount_type",
                   "discount_value", "start_date", "end_date", "min_order_value",
                   "max_discount", "restaurant_id", "is_active"],
    "customers": ["customer_id", "first_name", "last_name", "city", "state",
                  "referral_customer_id"],
    "orders": ["order_id", "customer_id", "restaurant_id", "order_date", "order_status",
               "order_total", "tip_amount", "promotion_id"],
    "order_items": ["order_item_id", "order_id", "product_id", "quantity", "unit_price",
                    "item_total"],
    "delivery": ["delivery_id", "order_id", "delivery_person_id", "pickup_time",
                 "delivery_time", "weather_conditions", "traffic_density", "vehicle_type",
                 "created_at"],
    "ratings": ["rating_id", "order_id", "customer_id", "overall_rating", "created_at"],
}


def _clean_query(name: str):
    def q(spark, sf_dir):
        return star(spark, sf_dir).clean(name).select(*_CLEAN_COLS[name])
    q.__name__ = f"q_clean_{name}"
    return q


for _n in _CLEAN_COLS:
    QUERIES[f"clean_{_n}"] = _clean_query(_n)


# ---------------------------------------------------------- dimensions -----

@query("dim_delivery_person")
def q_dim_delivery_person(spark, sf_dir):
    return star(spark, sf_dir).dim("delivery_person").select(
        "delivery_person_sk", "delivery_person_id", "vehicle_type", "is_active", "is_current")


def _customer_snapshots(t: testdata.Tables) -> list[DataFrame]:
    """Two full extracts of the customers: the second changes cities — keys
    divisible by 17 lose it (→ null), other keys divisible by 10 move — and
    adds the customers of nations 20+, who are absent from the first."""
    first = testdata.customers(t).withColumn("_key", F.col("id").cast("bigint"))
    snap0 = first.where(F.col("c_nationkey") < 20)
    city = (F.when(F.col("_key") % 17 == 0, F.lit(None).cast("string"))
             .when(F.col("_key") % 10 == 0, F.concat(F.col("city"), F.lit(" North")))
             .otherwise(F.col("city")))
    snap1 = first.withColumn("city", city)
    return [conform(s, SOURCE_DDL["customers"]) for s in (snap0, snap1)]


_SCD_OUT = ["customer_sk", "customer_id", "first_name", "last_name", "city",
            "effective_from", "effective_to", "is_current"]


@query("scd2_merge")
def q_scd2_merge(spark, sf_dir):
    """D-SCD2: two customer extracts merged one after the other."""
    snaps = _customer_snapshots(tables(spark, sf_dir))
    dim = None
    for i, snap in enumerate(snaps):
        c = C.clean_customers(snap, SNAPSHOT_TS[i])
        dim = dims.merge_dimension("customer", dim, c, SNAPSHOT_TS[i])
    return dim.select(*_SCD_OUT)


@query("scd2_from_log")
def q_scd2_from_log(spark, sf_dir):
    """Version history of each customer's order priority, rebuilt from
    the order log (a new version whenever the priority changes)."""
    o = tables(spark, sf_dir).orders
    log = o.select(F.col("o_custkey").cast("string").alias("customer_id"),
                   F.col("o_orderpriority").alias("priority"),
                   F.col("o_orderdate").alias("changed_at"),
                   F.col("o_orderkey").alias("order_key"))
    spec = scd2.Scd2Spec(sk="version_sk", key="customer_id", tracked=["priority"])
    h = scd2.scd2_from_log(log, spec, "changed_at", ["order_key"])
    return h.select("version_sk", "customer_id", "priority", "effective_from",
                    "effective_to", "is_current")


# Batch times of the two customer extracts among the orders' dates.
AS_OF_TS = ["1994-01-01 00:00:00", "1996-07-01 00:00:00"]


@query("fact_order_as_of")
def q_fact_order_as_of(spark, sf_dir):
    """Order facts with the customer, restaurant and promotion versions
    valid at the order's time; the customers' second extract, of 1996, closes
    some versions of the first, of 1994, and opens others."""
    s = star(spark, sf_dir)
    live = LiveWarehouse(spark, scratch_path(spark, "as-of"))
    for i, snap in enumerate(_customer_snapshots(tables(spark, sf_dir))):
        live.put_dimension("customer", C.clean_customers(snap, AS_OF_TS[i]), AS_OF_TS[i], f"load:{i}")
    for name in ("restaurant", "promotion"):
        live.put_dimension(name, s.clean(CLEAN_OF_DIM[name]), AS_OF_TS[0], "load:0")
    f = facts.fact_order(s.clean("orders"), live.dim("customer"), live.dim("restaurant"), live.dim("promotion"),
                         s.dim("date"), s.dim("time"), DEFAULT_BATCH_TS, versions="as_of")
    return f.select("order_sk", "order_id", "customer_sk", "restaurant_sk", "promotion_sk", "order_date_sk",
                    "order_total")


@query("latest_per_key")
def q_latest_per_key(spark, sf_dir):
    """Each customer's latest order priority (by order date, then order
    key) — one partially aggregated max_by per customer."""
    o = tables(spark, sf_dir).orders
    log = o.select(F.col("o_custkey").cast("string").alias("customer_id"),
                   F.col("o_orderpriority").alias("priority"),
                   F.col("o_orderdate").alias("changed_at"),
                   F.col("o_orderkey").alias("order_key"))
    return scd2.latest_per_key(log, "customer_id", ["changed_at", "order_key"])


# --------------------------------------------------------------- facts -----

@query("fact_order")
def q_fact_order(spark, sf_dir):
    return star(spark, sf_dir).fact("order").select(
        "order_sk", "order_id", "customer_sk", "restaurant_sk", "order_date_sk",
        "order_time_sk", "promotion_sk", "order_status", "order_total", "tip_amount")


@query("fact_order_item")
def q_fact_order_item(spark, sf_dir):
    return star(spark, sf_dir).fact("order_item", once=True).select(
        "order_item_sk", "order_item_id", "order_sk", "product_sk", "quantity", "unit_price",
        "item_total")


@query("fact_delivery")
def q_fact_delivery(spark, sf_dir):
    return star(spark, sf_dir).fact("delivery").select(
        "delivery_sk", "delivery_id", "order_sk", "delivery_person_sk", "pickup_date_sk",
        "pickup_time_sk", "delivery_date_sk", "delivery_time_sk",
        "delivery_duration_minutes", "weather_conditions", "traffic_density")


@query("fact_rating")
def q_fact_rating(spark, sf_dir):
    return star(spark, sf_dir).fact("rating", once=True).select(
        "rating_sk", "rating_id", "order_sk", "customer_sk", "restaurant_sk",
        "delivery_person_sk", "rating_date_sk", "rating_time_sk", "overall_rating")


# --------------------------------------------------------------- views -----

@query("vw_restaurant_order_performance")
def q_v1(spark, sf_dir):
    s = star(spark, sf_dir)
    return views.restaurant_order_performance(s.fact("order"), s.dim("restaurant"),
                                              s.dim("date"), unique_orders=s.unique("order"))


@query("vw_delivery_performance")
def q_v2(spark, sf_dir):
    s = star(spark, sf_dir)
    return views.delivery_performance(s.fact("delivery"), s.dim("delivery_person"),
                                      s.dim("date"), s.fact("rating", once=True))


@query("vw_delivery_performance_literal")
def q_v2_literal(spark, sf_dir):
    s = star(spark, sf_dir)
    return views.delivery_performance(s.fact("delivery"), s.dim("delivery_person"),
                                      s.dim("date"), s.fact("rating", once=True), mode="literal")


@query("vw_customer_order_patterns")
def q_v3(spark, sf_dir):
    s = star(spark, sf_dir)
    return views.customer_order_patterns(s.fact("order"), s.dim("customer"), s.dim("date"),
                                         s.dim("restaurant"), unique_orders=s.unique("order"))


@query("vw_product_performance")
def q_v4(spark, sf_dir):
    s = star(spark, sf_dir)
    return views.product_performance(s.fact("order_item", once=True), s.dim("product"), s.fact("order"),
                                     s.dim("restaurant"), s.dim("date"), unique_orders=s.unique("order"))


@query("vw_promotion_effectiveness")
def q_v5(spark, sf_dir):
    s = star(spark, sf_dir)
    return views.promotion_effectiveness(s.fact("order"), s.dim("promotion"), s.dim("date"),
                                         unique_orders=s.unique("order"))


# ------------------------------------------------------------- metrics -----

@query("daily_orders")
def q_daily_orders(spark, sf_dir):
    return K.daily_orders(star(spark, sf_dir).clean("orders"))


@query("daily_orders_filtered")
def q_daily_orders_filtered(spark, sf_dir):
    """K1 with the default filter: the last 30 days of data."""
    orders = star(spark, sf_dir).clean("orders")
    lo, hi = K.last_days_window(orders, "order_date", 30)
    return K.daily_orders(orders, K.Filters(start=lo, end=hi))


def _minutes(spark, sf_dir):
    return K.delivery_minutes(testdata.delivery(tables(spark, sf_dir)))


@query("delivery_minutes")
def q_delivery_minutes(spark, sf_dir):
    return _minutes(spark, sf_dir)


@query("status_distribution")
def q_status_distribution(spark, sf_dir):
    return K.status_distribution(star(spark, sf_dir).clean("orders"))


@query("weather_impact")
def q_weather_impact(spark, sf_dir):
    return K.weather_impact(_minutes(spark, sf_dir))


@query("traffic_impact")
def q_traffic_impact(spark, sf_dir):
    return K.traffic_impact(_minutes(spark, sf_dir))


@query("top_restaurants")
def q_top_restaurants(spark, sf_dir):
    return K.top_restaurants(star(spark, sf_dir).clean("restaurants"))


@query("kpi_row")
def q_kpi_row(spark, sf_dir):
    t = tables(spark, sf_dir)
    orders = testdata.orders(t).withColumnRenamed("tips", "tip_amount")
    return K.kpi_row(orders, K.delivery_minutes(testdata.delivery(t)))


@query("monthly_orders")
def q_monthly_orders(spark, sf_dir):
    """Orders per calendar month."""
    return K.monthly_orders(star(spark, sf_dir).clean("orders"))


@query("mom_growth")
def q_mom_growth(spark, sf_dir):
    return K.mom_growth(star(spark, sf_dir).clean("orders"))


@query("top_promotions")
def q_top_promotions(spark, sf_dir):
    s = star(spark, sf_dir)
    return K.top_promotions(s.fact("order"), s.dim("promotion"))


@query("filter_choices")
def q_filter_choices(spark, sf_dir):
    s = star(spark, sf_dir)
    return K.filter_choices(s.clean("restaurants"), s.clean("delivery"))


@query("date_bounds")
def q_date_bounds(spark, sf_dir):
    return K.date_bounds(star(spark, sf_dir).clean("orders"))


# -------------------------------------------------------------- audits -----

_BUSINESS_KEYS = {"clean_restaurants": "restaurant_id", "clean_products": "product_id",
                  "clean_customers": "customer_id", "clean_orders": "order_id",
                  "clean_order_items": "order_item_id", "clean_delivery": "delivery_id",
                  "clean_ratings": "rating_id"}


@query("audit_pk")
def q_audit_pk(spark, sf_dir):
    """Q1 over the surrogate keys of the star and the business keys of the
    clean layer."""
    t = star(spark, sf_dir).tables(once=True)
    keys = {**{k: v for k, v in audits.PRIMARY_KEYS.items()}, **_BUSINESS_KEYS}
    return audits.audit_primary_keys(t, keys)


@query("audit_fk")
def q_audit_fk(spark, sf_dir):
    return audits.audit_foreign_keys(star(spark, sf_dir).tables(once=True))


@query("audit_reconcile")
def q_audit_reconcile(spark, sf_dir):
    """Q3: rows per entity and layer, and lookups that found no key."""
    s = star(spark, sf_dir)
    layers = [
        ("restaurants", "stage", s.source("restaurants")),
        ("restaurants", "clean", s.clean("restaurants")),
        ("restaurants", "dimension", s.dim("restaurant")),
        ("customers", "stage", s.source("customers")),
        ("customers", "clean", s.clean("customers")),
        ("customers", "dimension", s.dim("customer")),
        ("products", "stage", s.source("products")),
        ("products", "clean", s.clean("products")),
        ("products", "dimension", s.dim("product")),
        ("promotions", "stage", s.source("promotions")),
        ("promotions", "clean", s.clean("promotions")),
        ("promotions", "dimension", s.dim("promotion")),
        ("orders", "stage", s.source("orders")),
        ("orders", "clean", s.clean("orders")),
        ("orders", "fact", s.fact("order")),
        ("order_items", "stage", s.source("order_items")),
        ("order_items", "clean", s.clean("order_items")),
        ("order_items", "fact", s.fact("order_item", once=True)),
        ("delivery", "stage", s.source("delivery")),
        ("delivery", "clean", s.clean("delivery")),
        ("delivery", "fact", s.fact("delivery")),
        ("ratings", "clean", s.clean("ratings")),
        ("ratings", "fact", s.fact("rating", once=True)),
    ]
    return audits.reconcile(layers)


@query("audit_lookup_completeness")
def q_audit_lookup_completeness(spark, sf_dir):
    s = star(spark, sf_dir)
    return audits.lookup_completeness(
        s.fact("order"), "fact_order",
        ["customer_sk", "restaurant_sk", "order_date_sk", "order_time_sk", "promotion_sk"])


# ----------------------------------------------------- incremental / files -----

@query("high_water_mark")
def q_high_water_mark(spark, sf_dir):
    """Rows of the order extract newer than what a first load (orders
    before 1998) already holds; the mark is a scalar subquery."""
    orders = star(spark, sf_dir).clean("orders")
    loaded = orders.where(F.col("order_date") < F.lit("1998-01-01").cast("timestamp_ntz"))
    mark = loaded.agg(F.coalesce(F.max("order_date"),
                                 F.lit("1900-01-01").cast("timestamp_ntz"))).scalar()
    return orders.where(F.col("order_date") > mark).select("order_id", "order_date")


@query("csv_roundtrip")
def q_csv_roundtrip(spark, sf_dir):
    """Promotions written as a quoted CSV extract with NULL
    markers, read back with the declared schema and cleaned."""
    path = scratch_path(spark, "promotions-csv")
    csvsrc.write_extract(testdata.promotions(tables(spark, sf_dir)), path, quoting="all")
    read = csvsrc.read_source(spark, "promotions", path, "promotions_csv", DEFAULT_BATCH_TS)
    return C.clean_promotions(read.good, DEFAULT_BATCH_TS).select(*_CLEAN_COLS["promotions"])


@query("csv_quarantine")
def q_csv_quarantine(spark, sf_dir):
    """An order extract where pending orders carry an unreadable tip
    and urgent finished orders an extra field; those rows are quarantined."""
    t = tables(spark, sf_dir)
    src = testdata.orders(t)
    o = t.orders.select(F.col("o_orderkey").cast("string").alias("id"), "o_orderpriority")
    rows = src.join(o, "id")
    text = rows.select(*[F.col(c).cast("string").alias(c) for c in src.columns],
                       "o_orderpriority")
    text = text.withColumn("tips", F.when(F.col("updated_status") == "Preparing",
                                          F.lit("later")).otherwise(F.col("tips")))
    extra = (F.col("updated_status") == "Delivered") & (F.col("o_orderpriority") == "1-URGENT")
    text = text.withColumn("order_total", F.when(
        extra, F.concat(F.coalesce(F.col("order_total"), F.lit("")), F.lit(",x")))
        .otherwise(F.col("order_total"))).drop("o_orderpriority")
    path = scratch_path(spark, "orders-csv")
    csvsrc.write_extract(text, path, quoting="none")
    read = csvsrc.read_source(spark, "orders", path, "orders_csv", DEFAULT_BATCH_TS)
    good = read.good.select(F.col("id").alias("order_id"), F.lit(False).alias("quarantined"))
    bad = read.quarantine.select(
        F.coalesce(F.col("id"), F.split(F.col("raw_record"), ",").getItem(0)).alias("order_id"),
        F.lit(True).alias("quarantined"))
    return good.unionByName(bad)


@query("csv_null_markers")
def q_csv_null_markers(spark, sf_dir):
    """Order items whose quantities and products are missing in many
    spellings, and whose prices are unreadable now and then: each rejected
    cell is listed with its column, value and reason."""
    path = scratch_path(spark, "markers-csv")
    n = F.regexp_replace("id", "-", "").cast("bigint")
    markers = F.array(*[F.lit(m) for m in ("NA", "N/A", "null", "None", "#N/A", "NaN", "NULL", " ", "n/a", "<NA>")])
    items = testdata.order_items(tables(spark, sf_dir)).select(
        "id", "order_id", F.when(n % 3 == 0, F.get(markers, (n / 3 % 10).cast("int"))).otherwise(F.col("product_id"))
        .alias("product_id"),
        F.when(n % 4 == 0, F.get(markers, (n / 4 % 10).cast("int"))).when(n % 25 == 1, F.lit("two"))
        .otherwise(F.col("item_quantity").cast("string")).alias("item_quantity"),
        F.when(n % 50 == 1, F.lit("1,5")).otherwise(F.col("price").cast("string")).alias("price"))
    csvsrc.write_extract(items, path)
    read = csvsrc.read_source(spark, "order_items", path, "order_items_csv", DEFAULT_BATCH_TS)
    none = F.lit(None).cast("string")
    good = read.good.select("id", F.col("product_id").alias("product"), F.col("item_quantity").cast("bigint")
                            .alias("quantity"), none.alias("rejected_column"), none.alias("rejected_value"),
                            none.alias("reason"))
    cells = read.quarantine.select("id", F.explode("rejected").alias("r"))
    return good.unionByName(cells.select(
        "id", none.alias("product"), F.lit(None).cast("bigint").alias("quantity"),
        F.col("r.column").alias("rejected_column"), F.col("r.value").alias("rejected_value"), F.col("r.reason")))


@query("multi_source_union")
def q_multi_source_union(spark, sf_dir):
    """Restaurants arriving in two feeds with different layouts."""
    main, second = testdata.restaurants_split(tables(spark, sf_dir))
    main = csvsrc.with_provenance(main, "restaurants_csv", "restaurants.csv", DEFAULT_BATCH_TS)
    second = csvsrc.with_provenance(second, "feed2_csv", "restaurants_feed2.csv", DEFAULT_BATCH_TS)
    both = csvsrc.union_restaurant_feeds(main, second)
    return C.clean_restaurants(both, DEFAULT_BATCH_TS).select(
        "restaurant_id", "restaurant_name", "cuisine_type", "city", "state", "postal_code",
        "rating", "source_system")


def _orders_batches(src: DataFrame) -> list[DataFrame]:
    """The order extract ``src`` in two: orders before 1998, and those since."""
    early = F.col("created_at") < F.lit("1998-01-01").cast("timestamp_ntz")
    return [src.where(early), src.where(~early)]


@query("incremental_clean")
def q_incremental_clean(spark, sf_dir):
    """Two order extracts land one after the other; each availableNow
    run of the stage stream cleans only the new files."""
    root = scratch_path(spark, "incremental-orders")
    for i, b in enumerate(_orders_batches(star(spark, sf_dir).source("orders"))):
        stamped = csvsrc.with_provenance(b, "orders_csv", f"orders_{i}.csv", SNAPSHOT_TS[i])
        incremental.land_batch(stamped, root, "orders", i)
        incremental.run_once(spark, root, "orders", incremental.clean_handler(root, "orders"))
    return store.read_table(spark, root, "clean", "orders").select(*_CLEAN_COLS["orders"])


@query("incremental_scd2")
def q_incremental_scd2(spark, sf_dir):
    """The two customer extracts of ``scd2_merge`` through the stage
    stream; each micro-batch merges into the previous snapshot."""
    root = scratch_path(spark, "incremental-customers")
    for i, snap in enumerate(_customer_snapshots(tables(spark, sf_dir))):
        stamped = csvsrc.with_provenance(snap, "customers_csv", f"customers_{i}.csv",
                                         SNAPSHOT_TS[i])
        incremental.land_batch(stamped, root, "customers", i)
        incremental.run_once(spark, root, "customers",
                             incremental.dimension_handler(root, "customers", "customer"))
    return LiveWarehouse(spark, root).dim("customer").select(*_SCD_OUT)


def _put_dimensions(live: LiveWarehouse, s: Star, names: list[str]) -> None:
    for name in names:
        source = s.clean("delivery" if name == "delivery_person" else CLEAN_OF_DIM[name])
        live.put_dimension(name, source, DEFAULT_BATCH_TS, "load:0")


def _land(spark, root: str, entity: str, parts: list[DataFrame], handler, first: int = 0) -> None:
    """Each part arrives as one extract and is processed before the next."""
    for i, b in enumerate(parts, first):
        stamped = csvsrc.with_provenance(b, f"{entity}_csv", f"{entity}_{i}.csv", SNAPSHOT_TS[min(i, 1)])
        incremental.land_batch(stamped, root, entity, i)
        incremental.run_once(spark, root, entity, handler)


@query("incremental_fact_order")
def q_incremental_fact_order(spark, sf_dir):
    """Order facts upserted per micro-batch; dimensions loaded once, the
    calendar covers every date from the start."""
    root = scratch_path(spark, "incremental-facts")
    s = star(spark, sf_dir)
    live = LiveWarehouse(spark, root)
    _put_dimensions(live, s, ["customer", "restaurant", "promotion"])
    live.put_calendar(s.calendar_dates(), "load:0")
    _land(spark, root, "orders", _orders_batches(s.source("orders")), incremental.fact_order_handler(root))
    return LiveWarehouse(spark, root).fact("order").select(
        "order_sk", "order_id", "customer_sk", "restaurant_sk", "order_date_sk",
        "order_time_sk", "promotion_sk", "order_status", "order_total", "tip_amount")


def late_parents(spark: SparkSession, sf_dir: str, audited: bool = False) -> LiveWarehouse:
    """The warehouse of ``load_late_parents``; ``audited``: its audit is
    brought up to date after each of its last three extracts."""
    root = scratch_path(spark, "late-parents")
    s = star(spark, sf_dir)
    live = LiveWarehouse(spark, root)
    _put_dimensions(live, s, ["restaurant", "customer", "product", "promotion", "delivery_person"])
    live.put_calendar(s.calendar_dates(), "load:0")
    odd = F.col("order_id").cast("bigint") % 2 == 1
    items, orders, dl = s.source("order_items"), s.source("orders"), s.source("delivery")
    dl_odd = F.col("Order_ID").cast("bigint") % 2 == 1
    handle = {e: incremental.entity_handler(root, e, dimension=False) for e in ("orders", "order_items", "delivery")}
    for i, (entity, rows) in enumerate([
            ("order_items", items.where(odd)), ("delivery", dl.where(dl_odd)), ("orders", orders),
            ("order_items", items.where(~odd)), ("delivery", dl.where(~dl_odd))]):
        stamped = csvsrc.with_provenance(rows, f"{entity}_csv", f"{entity}_{i}.csv", SNAPSHOT_TS[i % 2])
        incremental.land_batch(stamped, root, entity, i)
        incremental.run_once(spark, root, entity, handle[entity])
        if audited and i >= 2:
            AuditLog(LiveWarehouse(spark, root)).run()
    return LiveWarehouse(spark, root)


@query("audit_incremental")
def q_audit_incremental(spark, sf_dir):
    """Q1, Q2 over increments: after each extract only what it wrote is
    checked; the merged result is that of a full audit of the facts."""
    log = AuditLog(late_parents(spark, sf_dir, audited=True))
    twice = log.duplicate_keys().groupBy(F.col("table_name").alias("child_table")).agg(
        F.count(F.lit(1)).alias("duplicate_keys"))
    checks = log.foreign_keys()
    return checks.join(twice, "child_table", "left").select(
        *checks.columns, F.coalesce("duplicate_keys", F.lit(0)).cast("bigint").alias("duplicate_keys"))


@query("load_late_parents")
def q_load_late_parents(spark, sf_dir):
    """The items and deliveries of odd orders arrive before their
    orders, those of even orders after them; every link is found in the end."""
    live = late_parents(spark, sf_dir)
    o = live.fact("order").select("order_sk", "order_id")
    nobody = F.lit(None).cast("bigint").alias("delivery_person_sk")
    item = live.fact("order_item").join(o, "order_sk").select(
        F.lit("item").alias("fact"), F.col("order_item_id").alias("id"), "order_id",
        F.col("item_total").alias("amount"), nobody)
    dlv = live.fact("delivery").join(o, "order_sk", "left").select(
        F.lit("delivery").alias("fact"), F.col("delivery_id").alias("id"), "order_id",
        F.col("delivery_duration_minutes").cast("double").alias("amount"), "delivery_person_sk")
    rating = live.fact("rating").join(o, "order_sk", "left").select(
        F.lit("rating").alias("fact"), F.col("rating_id").alias("id"), "order_id",
        F.col("overall_rating").cast("double").alias("amount"), "delivery_person_sk")
    return item.unionByName(dlv).unionByName(rating)


@query("incremental_delivery_person")
def q_incremental_delivery_person(spark, sf_dir):
    """T6, D-DP: deliveries of two years in two micro-batches; a person whose
    latest vehicle differs gets a new version."""
    root = scratch_path(spark, "incremental-persons")
    t = tables(spark, sf_dir)
    d = testdata.delivery(t)
    first = F.col("ID").cast("bigint") % 2 == 0
    swapped = d.where(~first).withColumn("Type_of_vehicle", F.when(
        F.col("Delivery_person_ID").cast("bigint") % 5 == 0, F.lit("bicycle")).otherwise(F.col("Type_of_vehicle")))
    _land(spark, root, "delivery", [d.where(first), swapped],
          incremental.dimension_handler(root, "delivery", "delivery_person"))
    return LiveWarehouse(spark, root).dim("delivery_person").select(
        "delivery_person_id", "vehicle_type", "effective_from", "effective_to", "is_current")


@query("incremental_two_extracts")
def q_incremental_two_extracts(spark, sf_dir):
    """Two extracts of the customers wait for one micro-batch, the
    newer one landed first; the row that was loaded last wins."""
    root = scratch_path(spark, "two-extracts")
    old, new = _customer_snapshots(tables(spark, sf_dir))
    for i, (snap, ts) in enumerate([(new, SNAPSHOT_TS[1]), (old, SNAPSHOT_TS[0])]):
        incremental.land_batch(csvsrc.with_provenance(snap, "customers_csv", f"{i}.csv", ts), root, "customers", i)
    incremental.run_once(spark, root, "customers", incremental.dimension_handler(root, "customers", "customer"))
    return LiveWarehouse(spark, root).dim("customer").select("customer_id", "first_name", "last_name", "city",
                                                             "is_current")


def _write_extracts(spark, sf_dir: str, root: str) -> dict[str, str]:
    t = tables(spark, sf_dir)
    paths = {n: f"{root}/extracts/{n}" for n in testdata.SOURCES}
    for n, fn in testdata.SOURCES.items():
        csvsrc.write_extract(fn(t), paths[n])
    return paths


@query("full_load_twice")
def q_full_load_twice(spark, sf_dir):
    """The same extracts loaded on two days; V1 over the warehouse
    is that of one load."""
    root = scratch_path(spark, "load-twice")
    paths = _write_extracts(spark, sf_dir, root)
    for batch, ts in ((20250101, SNAPSHOT_TS[0]), (20250201, SNAPSHOT_TS[1])):
        full_load(spark, paths, root, batch, ts, kind="full")
    s = StoredStar(spark, root)
    return views.restaurant_order_performance(s.fact("order"), s.dim("restaurant"), s.dim("date"),
                                              unique_orders=s.unique("order"))


@query("load_then_stream_customer")
def q_load_then_stream_customer(spark, sf_dir):
    """T4, T5: a full load, then the changed customers through the stream:
    readers see the change, and keys go on after the load's."""
    root = scratch_path(spark, "load-stream")
    t = tables(spark, sf_dir)
    old, new = _customer_snapshots(t)
    path = f"{root}/extracts/customers"
    csvsrc.write_extract(old, path)
    full_load(spark, {"customers": path}, root, 20250101, SNAPSHOT_TS[0])
    incremental.land_batch(csvsrc.with_provenance(new, "customers_csv", "c.csv", SNAPSHOT_TS[1]), root,
                           "customers", 0)
    incremental.run_once(spark, root, "customers", incremental.entity_handler(root, "customers"))
    return StoredStar(spark, root).dim("customer").select(*_SCD_OUT)


@query("scd2_merge_null_change")
def q_scd2_merge_null_change(spark, sf_dir):
    """The versions that changes from or to null opened."""
    h = q_load_then_stream_customer(spark, sf_dir)
    now, then = h.where("is_current").alias("n"), h.where("NOT is_current").alias("t")
    return (now.join(then, F.col("n.customer_id") == F.col("t.customer_id"))
            .where("n.city IS NULL OR t.city IS NULL")
            .select("n.customer_id", F.col("t.city").alias("old_city"), F.col("n.city").alias("new_city"),
                    "n.effective_from"))


@query("csv_header_orders")
def q_csv_header_orders(spark, sf_dir):
    """Two files of one extract list their columns in another order."""
    path = scratch_path(spark, "items-csv")
    items = testdata.order_items(tables(spark, sf_dir))
    odd = F.col("order_id").cast("bigint") % 2 == 1
    for rows in (items.where(odd), items.where(~odd).select("price", "product_id", "order_id", "id", "item_quantity")):
        rows.write.mode("append").option("header", "true").option("nullValue", "NULL").csv(path)
    read = csvsrc.read_source(spark, "order_items", path, "order_items_csv", DEFAULT_BATCH_TS)
    return C.clean_order_items(read.good, DEFAULT_BATCH_TS).select(*_CLEAN_COLS["order_items"])


@query("csv_all_sources")
def q_csv_all_sources(spark, sf_dir):
    """All eight extracts written as CSV and read back."""
    root = scratch_path(spark, "all-csv")
    t = tables(spark, sf_dir)
    shown = {"restaurants": ("loc_number", "loc_name"), "restaurants_feed2": ("res_id", "res_name"),
             "products": ("id", "price"), "promotions": ("promotion_id", "name"), "customers": ("id", "last_name"),
             "orders": ("id", "updated_status"), "order_items": ("id", "product_id"), "delivery": ("ID", "Order_Date")}
    out = None
    for name, (key, value) in shown.items():
        df = testdata.restaurants_split(t)[1] if name == "restaurants_feed2" else testdata.SOURCES[name](t)
        csvsrc.write_extract(df, f"{root}/{name}")
        read = csvsrc.read_source(spark, name, f"{root}/{name}", name, DEFAULT_BATCH_TS).good
        rows = read.select(F.lit(name).alias("source"), F.col(key).alias("key"), F.col(value).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("full_load_quarantine")
def q_full_load_quarantine(spark, sf_dir):
    """Restaurants from two feeds, each with unreadable ratings; bad rows
    of both are stored and counted, good ones reach the dimension."""
    root = scratch_path(spark, "load-quarantine")
    main, second = testdata.restaurants_split(tables(spark, sf_dir))

    def spoil(df, key, rating):
        return df.withColumn(rating, F.when(F.col(key).cast("bigint") % 7 == 0, F.lit("five"))
                             .otherwise(F.col(rating).cast("string")))

    csvsrc.write_extract(spoil(main, "loc_number", "rating"), f"{root}/main")
    csvsrc.write_extract(spoil(second, "res_id", "aggregate_rating"), f"{root}/second")
    report = full_load(spark, {"restaurants": f"{root}/main"}, f"{root}/warehouse", 1, SNAPSHOT_TS[0],
                       second_restaurant_feed=f"{root}/second")
    def stored(feed):
        return store.read_table(spark, f"{root}/warehouse", "stage", f"{feed}_quarantine")

    def bad(feed, key):
        return stored(feed).select(F.coalesce(key, F.split_part("raw_record", F.lit(","), F.lit(1))).alias("id"),
                                   F.lit("quarantined").alias("state"), F.lit(report[feed]).cast("bigint").alias("n"))

    good = StoredStar(spark, f"{root}/warehouse").dim("restaurant").select(
        F.col("restaurant_id").alias("id"), F.lit("kept").alias("state"), F.lit(None).cast("bigint").alias("n"))
    for feed, key in (("restaurants", "loc_number"), ("restaurants_feed2", "res_id")):
        if report[feed]:
            good = good.unionByName(bad(feed, key))
    return good


@query("vw_delivery_performance_two_ratings")
def q_v2_two_ratings(spark, sf_dir):
    """V2 in both modes where every even order is rated twice."""
    s = star(spark, sf_dir)
    r = s.fact("rating")
    twice = r.unionByName(r.where("order_sk % 2 = 0").withColumn("delivery_rating", F.lit(1)))
    out = [views.delivery_performance(s.fact("delivery"), s.dim("delivery_person"), s.dim("date"), twice, mode=m)
           .withColumn("mode", F.lit(m)) for m in ("per_order", "literal")]
    return out[0].unionByName(out[1])


@query("audit_lookup_completeness_all")
def q_audit_lookup_completeness_all(spark, sf_dir):
    """Q3: null rate of every looked-up key, one scan of each fact."""
    s = star(spark, sf_dir)
    keys: dict[str, list[str]] = {}
    for child, column, _, _ in audits.FOREIGN_KEYS:
        if child.startswith("fact_"):
            keys.setdefault(child, []).append(column)
    parts = [audits.lookup_completeness(s.fact(c.removeprefix("fact_"), once=True), c, ks) for c, ks in keys.items()]
    for p in parts[1:]:
        parts[0] = parts[0].unionByName(p)
    return parts[0]


@query("daily_orders_choices")
def q_daily_orders_choices(spark, sf_dir):
    """the K1 series under a cuisine filter, with "All" for the city."""
    s = star(spark, sf_dir)
    chosen = K.apply_filters(s.clean("restaurants"), K.Filters(city="All", cuisine="C1"), city_col="city",
                             cuisine_col="cuisine_type").select("restaurant_id")
    return K.daily_orders(s.clean("orders").join(chosen, "restaurant_id", "left_semi"))


# ----------------------------------------- dimensions and filters, in full ---

@query("dim_time")
def q_dim_time(spark, sf_dir):
    """D-TIME, joined with the deliveries' pick-up minutes that use it."""
    s = star(spark, sf_dir)
    used = s.fact("delivery").groupBy(F.col("pickup_time_sk").alias("time_sk")).agg(
        F.count(F.lit(1)).alias("deliveries"))
    return s.dim("time").join(used, "time_sk", "left").select(
        *s.dim("time").columns, F.coalesce("deliveries", F.lit(0)).alias("deliveries"))


@query("dim_restaurant")
def q_dim_restaurant(spark, sf_dir):
    return star(spark, sf_dir).dim("restaurant").select(
        "restaurant_sk", "restaurant_id", "restaurant_name", "cuisine_type", "city", "state", "country",
        "postal_code", "effective_from", "effective_to", "is_current")


@query("dim_product")
def q_dim_product(spark, sf_dir):
    return star(spark, sf_dir).dim("product").select(
        "product_sk", "product_id", "restaurant_sk", "product_name", "description", "category", "price", "cost",
        "is_vegetarian", "is_vegan", "is_gluten_free", "is_current")


@query("dim_promotion")
def q_dim_promotion(spark, sf_dir):
    return star(spark, sf_dir).dim("promotion").select(
        "promotion_sk", "promotion_id", "restaurant_sk", "promotion_name", "description", "discount_type",
        "discount_value", "start_date", "end_date", "min_order_value", "max_discount", "is_active", "is_current")


# ------------------------------------------- the stored warehouse, over time ---

def changed_orders(spark: SparkSession, sf_dir: str, compact: bool) -> LiveWarehouse:
    """Orders before 1998, then those since; each time the orders whose number
    divides by 7 come again with a higher total.  ``compact``: the order fact
    is rewritten after the second of the three extracts, and what that
    superseded is deleted."""
    root = scratch_path(spark, "changed-orders")
    s = star(spark, sf_dir)
    live = LiveWarehouse(spark, root)
    _put_dimensions(live, s, ["restaurant", "customer", "promotion"])
    live.put_calendar(s.calendar_dates(), "load:0")
    early, late = _orders_batches(s.source("orders"))
    again = early.where("CAST(id AS BIGINT) % 7 = 0").withColumns({
        "order_total": F.col("order_total") + 1, "updated_at": F.col("updated_at") + F.expr("INTERVAL 1 DAY")})
    for i, rows in enumerate([early, again, late]):
        _land(spark, root, "orders", [rows], incremental.fact_order_handler(root), i)
        if compact and i == 1:
            live = LiveWarehouse(spark, root)
            live.compact("order", "compact:1")
            live.retire("order", keep=0)
    return LiveWarehouse(spark, root)


@query("compact_then_query")
def q_compact_then_query(spark, sf_dir):
    """The order fact is compacted between two increments."""
    return changed_orders(spark, sf_dir, compact=True).fact("order").select(
        "order_sk", "order_id", "customer_sk", "restaurant_sk", "order_date_sk", "promotion_sk", "order_status",
        "order_total", "tip_amount")


@query("stored_orders_of_a_month")
def q_stored_orders_of_a_month(spark, sf_dir):
    """F10, K1 over the stored fact: the days of February 1998, read from that
    month's folders."""
    live = changed_orders(spark, sf_dir, compact=False)
    rows = live.fact("order", between=("1998-02-01", "1998-02-28"))
    return (rows.join(F.broadcast(live.dim("date").select("date_sk", "date_id")),
                      F.col("order_date_sk") == F.col("date_sk"))
            .groupBy(F.col("date_id").alias("date"))
            .agg(F.count(F.lit(1)).alias("order_count"), money_sum("order_total").alias("revenue")))


@query("stored_v1_of_a_year")
def q_stored_v1_of_a_year(spark, sf_dir):
    """V1 of 1995 over the stored fact: the filtered calendar prunes months."""
    live = changed_orders(spark, sf_dir, compact=False)
    return views.restaurant_order_performance(live.fact("order"), live.dim("restaurant"),
                                              live.dim("date").where("year = 1995"))


@query("full_load_no_dates")
def q_full_load_no_dates(spark, sf_dir):
    """D-DATE: a load with sentinel dates only, then one with real dates."""
    root = scratch_path(spark, "no-dates")
    orders = testdata.orders(tables(spark, sf_dir))
    far = F.lit("9999-12-31").cast("timestamp_ntz")
    for batch, rows in ((1, orders.withColumns({"created_at": far, "updated_at": far})
                         .withColumn("id", F.concat(F.lit("far-"), "id"))), (2, orders)):
        csvsrc.write_extract(rows, f"{root}/orders-{batch}")
        report = full_load(spark, {"orders": f"{root}/orders-{batch}"}, f"{root}/warehouse", batch, SNAPSHOT_TS[batch - 1])
        assert (report["stray_dates_orders"] > 0) == (batch == 1), report
    live = LiveWarehouse(spark, f"{root}/warehouse")
    days = live.dim("date").select("date_sk", "date_id")
    return (live.fact("order").join(F.broadcast(days), F.col("order_date_sk") == F.col("date_sk"), "left")
            .groupBy(F.col("date_id").alias("date")).agg(F.count(F.lit(1)).alias("order_count")))
