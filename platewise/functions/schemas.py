"""Declared table schemas.

Sources are read with these schemas — never inferred.  Clean, dimension and
fact layouts follow the warehouse DDL; ``FLOAT`` maps to double, surrogate
keys are bigint, ``TIME`` is carried as minute-of-day (int) plus an
``HH:mm:ss`` string because Spark has no default TIME type.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

# ---------------------------------------------------------------- sources --
# Source CSV layouts.  Some trailing columns are optional extensions (listed
# in ``sources.csv.OPTIONAL``): the original extracts lack the restaurant,
# promotion and order links, which therefore loaded as NULL; files without
# them still read, the columns come out null.
SOURCE_DDL = {
    "restaurants": (
        "loc_number string, loc_name string, cuisines string, address string, "
        "searched_city string, searched_state string, searched_zipcode string, "
        "latitude double, longitude double, phone string, rating double"),
    "restaurants_feed2": (
        "res_id string, res_name string, cuisines string, address string, "
        "city string, state string, zipcode string, latitude double, "
        "longitude double, phone string, aggregate_rating double"),
    "products": (
        "id string, name string, description string, price string, cost string, "
        "restaurant_id string, category string"),
    "promotions": (
        "promotion_id string, name string, description string, discount_type string, "
        "discount_value double, start_date date, end_date date, min_order_value double, "
        "max_discount double, restaurant_id string, is_active int"),
    "customers": (
        "id string, first_name string, last_name string, city string, "
        "referral_customer_id string"),
    "orders": (
        "id string, customer_id string, created_at timestamp_ntz, updated_at timestamp_ntz, "
        "updated_status string, tips double, rating int, "
        "restaurant_id string, promotion_id string, order_total double, delivery_rating int"),
    "order_items": (
        "id string, order_id string, product_id string, item_quantity int, price double"),
    "delivery": (
        "ID string, Delivery_person_ID string, Time_Orderd string, Time_Order_picked string, "
        "Weatherconditions string, Road_traffic_density string, Type_of_vehicle string, "
        "Order_Date string, Type_of_order string, multiple_deliveries int, Order_ID string, "
        "Distance double"),
}

# Provenance columns appended to every stage table.
PROVENANCE_DDL = "source_system string, source_file string, load_timestamp timestamp_ntz"

# ------------------------------------------------------------------ clean --
_SCD_TAIL = ("created_at timestamp_ntz, updated_at timestamp_ntz, "
             "effective_from timestamp_ntz, effective_to timestamp_ntz, "
             "is_current boolean, source_system string, dw_created_at timestamp_ntz")

CLEAN_DDL = {
    "restaurants": (
        "restaurant_id string, restaurant_name string, cuisine_type string, "
        "address string, city string, state string, country string, postal_code string, "
        "latitude double, longitude double, phone_number string, email string, "
        "operating_hours string, rating double, " + _SCD_TAIL),
    "products": (
        "product_id string, restaurant_id string, product_name string, description string, "
        "category string, price double, cost double, is_vegetarian boolean, is_vegan boolean, "
        "is_gluten_free boolean, calories int, preparation_time int, " + _SCD_TAIL),
    "promotions": (
        "promotion_id string, promotion_name string, description string, "
        "discount_type string, discount_value double, start_date date, end_date date, "
        "min_order_value double, max_discount double, restaurant_id string, "
        "is_active boolean, " + _SCD_TAIL),
    "customers": (
        "customer_id string, first_name string, last_name string, email string, "
        "phone_number string, address string, city string, state string, country string, "
        "postal_code string, latitude double, longitude double, created_at timestamp_ntz, "
        "updated_at timestamp_ntz, referral_customer_id string, effective_from timestamp_ntz, "
        "effective_to timestamp_ntz, is_current boolean, source_system string, "
        "dw_created_at timestamp_ntz"),
    "orders": (
        "order_id string, customer_id string, restaurant_id string, order_date timestamp_ntz, "
        "order_status string, delivery_address string, delivery_city string, "
        "delivery_state string, delivery_postal_code string, delivery_latitude double, "
        "delivery_longitude double, order_total double, tax_amount double, tip_amount double, "
        "promotion_id string, payment_method string, payment_status string, "
        "created_at timestamp_ntz, updated_at timestamp_ntz, source_system string, "
        "dw_created_at timestamp_ntz"),
    "order_items": (
        "order_item_id string, order_id string, product_id string, quantity int, "
        "unit_price double, item_total double, special_instructions string, "
        "created_at timestamp_ntz, updated_at timestamp_ntz, source_system string, "
        "dw_created_at timestamp_ntz"),
    "delivery": (
        "delivery_id string, order_id string, delivery_person_id string, "
        "delivery_status string, pickup_time timestamp_ntz, delivery_time timestamp_ntz, "
        "estimated_delivery_time timestamp_ntz, actual_delivery_time timestamp_ntz, "
        "delivery_distance double, weather_conditions string, traffic_density string, "
        "vehicle_type string, created_at timestamp_ntz, updated_at timestamp_ntz, "
        "source_system string, dw_created_at timestamp_ntz"),
    "ratings": (
        "rating_id string, order_id string, customer_id string, restaurant_id string, "
        "delivery_person_id string, food_rating int, delivery_rating int, "
        "overall_rating int, comments string, created_at timestamp_ntz, "
        "source_system string, dw_created_at timestamp_ntz"),
}

# -------------------------------------------------------------- consumption --
DIM_DATE_DDL = (
    "date_sk bigint, date_id date, day_of_week int, day_of_week_name string, "
    "day_of_month int, day_of_year int, week_of_year int, month_number int, "
    "month_name string, quarter int, year int, is_weekend boolean, is_holiday boolean, "
    "holiday_name string, fiscal_year int, fiscal_quarter int")

DIM_TIME_DDL = (
    "time_sk bigint, time_id string, minute_of_day int, hour_of_day int, "
    "minute_of_hour int, second_of_minute int, am_pm string, time_of_day_category string")

FACT_DDL = {
    "order": (
        "order_sk bigint, order_id string, customer_sk bigint, restaurant_sk bigint, "
        "order_date_sk bigint, order_time_sk bigint, promotion_sk bigint, order_status string, "
        "delivery_address string, delivery_city string, delivery_state string, "
        "delivery_postal_code string, delivery_latitude double, delivery_longitude double, "
        "order_total double, tax_amount double, tip_amount double, payment_method string, "
        "payment_status string, created_at timestamp_ntz, updated_at timestamp_ntz, "
        "source_system string, dw_created_at timestamp_ntz"),
    "order_item": (
        "order_item_sk bigint, order_item_id string, order_sk bigint, product_sk bigint, "
        "quantity int, unit_price double, item_total double, special_instructions string, "
        "created_at timestamp_ntz, updated_at timestamp_ntz, source_system string, "
        "dw_created_at timestamp_ntz"),
    "delivery": (
        "delivery_sk bigint, delivery_id string, order_sk bigint, delivery_person_sk bigint, "
        "delivery_status string, pickup_date_sk bigint, pickup_time_sk bigint, "
        "delivery_date_sk bigint, delivery_time_sk bigint, "
        "estimated_delivery_time timestamp_ntz, actual_delivery_time timestamp_ntz, "
        "delivery_duration_minutes bigint, delivery_distance double, "
        "weather_conditions string, traffic_density string, created_at timestamp_ntz, "
        "updated_at timestamp_ntz, source_system string, dw_created_at timestamp_ntz"),
    "rating": (
        "rating_sk bigint, rating_id string, order_sk bigint, customer_sk bigint, "
        "restaurant_sk bigint, delivery_person_sk bigint, rating_date_sk bigint, "
        "rating_time_sk bigint, food_rating int, delivery_rating int, overall_rating int, "
        "comments string, created_at timestamp_ntz, source_system string, "
        "dw_created_at timestamp_ntz"),
}


@lru_cache(maxsize=None)
def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def source_schema(name: str) -> StructType:
    return struct(SOURCE_DDL[name])


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Project ``df`` onto a declared layout: same order, declared types,
    missing columns as typed nulls (P9).  Extra columns are dropped."""
    have = set(df.columns)
    cols = []
    for f in struct(ddl).fields:
        c = F.col(f.name) if f.name in have else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Column-presence guard (P12): names that a step needs but ``df`` lacks."""
    have = set(df.columns)
    return [c for c in required if c not in have]


def require_columns(df: DataFrame, required: list[str], what: str) -> None:
    miss = missing_columns(df, required)
    if miss:
        raise ValueError(f"{what}: missing columns {miss}")
