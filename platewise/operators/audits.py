"""Integrity and reconciliation audits (Q1–Q4).

Spark does not enforce the declared primary and foreign keys, so they are
checked as table jobs:

* primary keys — ``groupBy(pk).count()`` (partial aggregate, so a hot key is
  combined map-side) keeping counts > 1;
* foreign keys — one scan per child table: its key columns are left-joined
  against each parent's distinct keys and one aggregate counts rows, null
  references and orphans for every key of that table; parent sides are
  projected to the key only, so the planner can broadcast the small ones;
* reconciliation — one single-pass aggregate per table, stacked with
  ``unionByName`` (no joins between counts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Declared keys of the consumption layer.
PRIMARY_KEYS = {
    "dim_date": "date_sk", "dim_time": "time_sk", "dim_restaurant": "restaurant_sk",
    "dim_product": "product_sk", "dim_promotion": "promotion_sk",
    "dim_customer": "customer_sk", "dim_delivery_person": "delivery_person_sk",
    "fact_order": "order_sk", "fact_order_item": "order_item_sk",
    "fact_delivery": "delivery_sk", "fact_rating": "rating_sk",
}

# (child table, child column, parent table, parent column) — the declared
# foreign keys, plus the product/promotion → restaurant links.
FOREIGN_KEYS = [
    ("fact_order", "customer_sk", "dim_customer", "customer_sk"),
    ("fact_order", "restaurant_sk", "dim_restaurant", "restaurant_sk"),
    ("fact_order", "order_date_sk", "dim_date", "date_sk"),
    ("fact_order", "order_time_sk", "dim_time", "time_sk"),
    ("fact_order", "promotion_sk", "dim_promotion", "promotion_sk"),
    ("fact_order_item", "order_sk", "fact_order", "order_sk"),
    ("fact_order_item", "product_sk", "dim_product", "product_sk"),
    ("fact_delivery", "order_sk", "fact_order", "order_sk"),
    ("fact_delivery", "delivery_person_sk", "dim_delivery_person", "delivery_person_sk"),
    ("fact_delivery", "pickup_date_sk", "dim_date", "date_sk"),
    ("fact_delivery", "pickup_time_sk", "dim_time", "time_sk"),
    ("fact_delivery", "delivery_date_sk", "dim_date", "date_sk"),
    ("fact_delivery", "delivery_time_sk", "dim_time", "time_sk"),
    ("fact_rating", "order_sk", "fact_order", "order_sk"),
    ("fact_rating", "customer_sk", "dim_customer", "customer_sk"),
    ("fact_rating", "restaurant_sk", "dim_restaurant", "restaurant_sk"),
    ("fact_rating", "delivery_person_sk", "dim_delivery_person", "delivery_person_sk"),
    ("fact_rating", "rating_date_sk", "dim_date", "date_sk"),
    ("fact_rating", "rating_time_sk", "dim_time", "time_sk"),
    ("dim_product", "restaurant_sk", "dim_restaurant", "restaurant_sk"),
    ("dim_promotion", "restaurant_sk", "dim_restaurant", "restaurant_sk"),
]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def duplicate_keys(df: DataFrame, table: str, key: str) -> DataFrame:
    """Key values that occur more than once (Q1)."""
    return (df.where(F.col(key).isNotNull()).groupBy(key).count()
            .where(F.col("count") > 1)
            .select(F.lit(table).alias("table_name"), F.col(key).cast("string").alias("key_value"),
                    F.col("count").alias("occurrences")))


def audit_primary_keys(tables: dict[str, DataFrame], keys: dict[str, str] | None = None
                       ) -> DataFrame:
    keys = keys or {t: k for t, k in PRIMARY_KEYS.items() if t in tables}
    return _union([duplicate_keys(tables[t], t, k) for t, k in keys.items()])


def orphans(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Child rows whose non-null key has no parent (Q2)."""
    p = parent.select(F.col(parent_col).alias("_pk")).where(F.col("_pk").isNotNull())
    c = child.where(F.col(child_col).isNotNull())
    return c.join(p, c[child_col] == p["_pk"], "left_anti")


def fk_check(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str,
             child_name: str, parent_name: str) -> DataFrame:
    """One row: child rows, null references and orphans of one foreign key.
    One left join of the child against the parent's distinct keys, one
    aggregate; the distinct keeps a duplicated parent key from multiplying
    child rows."""
    p = (parent.select(F.col(parent_col).alias("_pk")).where(F.col("_pk").isNotNull())
         .distinct().withColumn("_hit", F.lit(True)))
    j = child.select(F.col(child_col).alias("_fk")).join(p, F.col("_fk") == F.col("_pk"), "left")
    return j.agg(
        F.count(F.lit(1)).alias("child_rows"),
        F.count(F.when(F.col("_fk").isNull(), 1)).alias("null_rows"),
        F.count(F.when(F.col("_fk").isNotNull() & F.col("_hit").isNull(), 1))
         .alias("orphan_rows")).select(
        F.lit(child_name).alias("child_table"), F.lit(child_col).alias("child_column"),
        F.lit(parent_name).alias("parent_table"), "child_rows", "null_rows", "orphan_rows")


def child_fk_checks(child: DataFrame, child_name: str,
                    fks: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """All foreign keys of one child table in one scan: the child's key
    columns are left-joined against each parent's distinct keys (calendar
    parents are small and get broadcast by the planner) and one aggregate
    counts rows, null references and orphans per key; the counts are then
    turned into one row per foreign key."""
    cols = list(dict.fromkeys(c for c, _, _, _ in fks))
    j = child.select(*cols)
    for i, (ccol, parent, _, pcol) in enumerate(fks):
        p = (parent.select(F.col(pcol).alias(f"_pk{i}")).where(F.col(f"_pk{i}").isNotNull())
             .distinct().withColumn(f"_hit{i}", F.lit(True)))
        j = j.join(p, F.col(ccol) == F.col(f"_pk{i}"), "left").drop(f"_pk{i}")
    aggs = [F.count(F.lit(1)).alias("child_rows")]
    for i, (ccol, _, _, _) in enumerate(fks):
        aggs += [F.count(F.when(F.col(ccol).isNull(), 1)).alias(f"_null{i}"),
                 F.count(F.when(F.col(ccol).isNotNull() & F.col(f"_hit{i}").isNull(), 1))
                  .alias(f"_orph{i}")]
    a = j.agg(*aggs)
    rows = [F.struct(F.lit(child_name).alias("child_table"), F.lit(ccol).alias("child_column"),
                     F.lit(pname).alias("parent_table"), F.col("child_rows"),
                     F.col(f"_null{i}").alias("null_rows"),
                     F.col(f"_orph{i}").alias("orphan_rows"))
            for i, (ccol, _, pname, _) in enumerate(fks)]
    return a.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def audit_foreign_keys(tables: dict[str, DataFrame], fks=None) -> DataFrame:
    """One row per declared foreign key (Q2), one scan per child table."""
    fks = fks or [fk for fk in FOREIGN_KEYS if fk[0] in tables and fk[2] in tables]
    by_child: dict[str, list] = {}
    for c, cc, p, pc in fks:
        by_child.setdefault(c, []).append((cc, tables[p], p, pc))
    return _union([child_fk_checks(tables[c], c, lst) for c, lst in by_child.items()])


def reconcile(layers: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """Row counts per (entity, layer) (Q3): one aggregate per table, stacked."""
    return _union([df.agg(F.count(F.lit(1)).alias("row_count"))
                   .select(F.lit(entity).alias("entity"), F.lit(layer).alias("layer"),
                           "row_count")
                   for entity, layer, df in layers])


def lookup_completeness(fact: DataFrame, table: str, key_cols: list[str]) -> DataFrame:
    """Share of fact rows whose dimension lookup found no key (Q3)."""
    aggs = [F.count(F.lit(1)).alias("fact_rows")]
    aggs += [F.count(F.col(c)).alias(c) for c in key_cols]
    one = fact.agg(*aggs)  # one scan, unfolded to a row for each key
    keys = F.explode(F.array(*[F.struct(F.lit(c).alias("key_column"), F.col(c).alias("found")) for c in key_cols]))
    return one.select("fact_rows", keys.alias("k")).select(
        F.lit(table).alias("table_name"), "k.key_column", "fact_rows",
        (F.col("fact_rows") - F.col("k.found")).alias("missing"))
