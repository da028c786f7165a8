"""The five versioned dimensions (D-REST, D-PROD, D-PROMO, D-CUST, D-DP).

One generic SCD2 merge serves all of them; this module only holds each
dimension's spec and the extra lookups (product/promotion → restaurant).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from .scd2 import Scd2Spec, latest_per_key, scd2_merge

_AUDIT = ["created_at", "updated_at", "source_system"]

SPECS = {
    "restaurant": Scd2Spec(
        sk="restaurant_sk", key="restaurant_id",
        tracked=["restaurant_name", "cuisine_type", "address", "city", "state", "country",
                 "postal_code", "latitude", "longitude", "phone_number", "email",
                 "operating_hours"],
        carried=_AUDIT),
    "product": Scd2Spec(
        sk="product_sk", key="product_id",
        tracked=["restaurant_id", "product_name", "description", "category", "price", "cost",
                 "is_vegetarian", "is_vegan", "is_gluten_free", "calories",
                 "preparation_time"],
        carried=_AUDIT),
    "promotion": Scd2Spec(
        sk="promotion_sk", key="promotion_id",
        tracked=["promotion_name", "description", "discount_type", "discount_value",
                 "start_date", "end_date", "min_order_value", "max_discount",
                 "restaurant_id", "is_active"],
        carried=_AUDIT),
    "customer": Scd2Spec(
        sk="customer_sk", key="customer_id",
        tracked=["first_name", "last_name", "email", "phone_number", "address", "city",
                 "state", "country", "postal_code", "latitude", "longitude",
                 "referral_customer_id"],
        carried=_AUDIT),
    "delivery_person": Scd2Spec(
        sk="delivery_person_sk", key="delivery_person_id",
        tracked=["first_name", "last_name", "phone_number", "email", "vehicle_type",
                 "rating", "active_since", "is_active", "city", "state", "country"],
        carried=["source_system"]),
}

# Clean column used to pick the latest row of a key inside one batch.
LATEST_BY = {
    "restaurant": ["updated_at"],
    "product": ["updated_at"],
    "promotion": ["updated_at"],
    "customer": ["updated_at"],
    "delivery_person": ["_seen_at", "_seen_id"],
}


def delivery_person_source(clean_delivery: DataFrame) -> DataFrame:
    """D-DP: no person extract exists; each person's latest delivery row
    gives the vehicle type (partial aggregate per person)."""
    d = clean_delivery.select(
        "delivery_person_id", "vehicle_type", "source_system",
        F.coalesce("pickup_time", "created_at").alias("_seen_at"),
        F.col("delivery_id").alias("_seen_id"))
    latest = latest_per_key(d.where(F.col("delivery_person_id").isNotNull()),
                            "delivery_person_id", ["_seen_at", "_seen_id"])
    cols = {c: F.lit(None) for c in SPECS["delivery_person"].tracked}
    cols["vehicle_type"] = F.col("vehicle_type")
    cols["is_active"] = F.lit(True)
    typed = {"rating": "double", "active_since": "date", "is_active": "boolean"}
    return latest.select(
        "delivery_person_id",
        *[c.cast(typed.get(n, "string")).alias(n) for n, c in cols.items()],
        "source_system", "_seen_at", "_seen_id")


LINKED_TO_RESTAURANT = ("product", "promotion")

# Business key of each dimension's extract.
STAGE_KEYS = {"restaurants": "loc_number", "products": "id", "promotions": "promotion_id", "customers": "id"}


def latest_stage_rows(stage: DataFrame, entity: str) -> DataFrame:
    """One row for each key of an extract: the one loaded last; of one load,
    the later file's; then by content, so that every run picks the same."""
    key = STAGE_KEYS[entity]
    order = [c for c in ("load_timestamp", "batch_id", "source_file") if c in stage.columns]
    tied = stage.withColumn("_tie", F.xxhash64(*[c for c in stage.columns if c not in order]))
    return latest_per_key(tied.where(F.col(key).isNotNull()), key, [*order, "_tie"]).select(*stage.columns)


def merge_dimension(name: str, dim: DataFrame | None, clean: DataFrame, batch_ts: str,
                    next_key: int | None = None, touched_only: bool = False,
                    dim_restaurant: DataFrame | None = None) -> DataFrame:
    """Apply one clean batch to dimension ``name`` (SCD2); ``touched_only``
    for small incremental batches (see ``scd2_merge``).

    With ``dim_restaurant`` (or a ``dim`` that has the link) products and
    promotions get ``restaurant_sk``: current versions that of the current
    restaurant version, expired versions the one they had.
    """
    spec = SPECS[name]
    linked = name in LINKED_TO_RESTAURANT and (
        dim_restaurant is not None or dim is not None and "restaurant_sk" in dim.columns)
    if linked:
        spec = replace(spec, carried=[*spec.carried, "restaurant_sk"])
        if dim is not None and "restaurant_sk" not in dim.columns:
            dim = dim.withColumn("restaurant_sk", F.lit(None).cast("bigint"))
        clean = clean.withColumn("restaurant_sk", F.lit(None).cast("bigint"))
    out = scd2_merge(dim, clean, spec, batch_ts, order_by=LATEST_BY[name],
                     next_key=0 if dim is None else next_key, touched_only=touched_only)
    if not linked or dim_restaurant is None:
        return out
    current = out.where(F.col("is_current")).drop("restaurant_sk")
    return (with_restaurant_sk(current, dim_restaurant).select(*out.columns)
            .unionByName(out.where(~F.col("is_current"))))


def current_keys(dim: DataFrame, key: str, sk: str) -> DataFrame:
    """(business key, surrogate key) of the current versions."""
    return dim.where(F.col("is_current")).select(key, sk)


def with_restaurant_sk(dim: DataFrame, dim_restaurant: DataFrame) -> DataFrame:
    """Product/promotion → current restaurant version."""
    r = current_keys(dim_restaurant, "restaurant_id", "restaurant_sk")
    return dim.join(r, "restaurant_id", "left")
