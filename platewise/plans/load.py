"""The batch load as one callable job (§3.1): CSV extracts → stage → clean →
dimensions → facts, every layer written under one storage root.

    from platewise.plans.load import full_load
    full_load(spark, {"orders": "s3://…/orders/", …}, root="s3://…/warehouse",
              batch_id=20250101, batch_ts="2025-01-01 02:00:00")

Each extract is read with its declared schema (bad rows of every feed go to
``stage/<name>_quarantine``) and stored as ``stage/<name>_load`` — beside the
folder that the change streams watch, so a stream never reads a load's own
files again.  Everything after that is ``plans.live``: versions, SCD2 merges,
upserts by business key, links over all batches.

``kind="delta"`` (default): the order, item and delivery extracts hold new,
changed or repeated rows, which are upserted.  ``kind="full"``: they hold
everything and replace the facts of earlier loads, so rows that left the
source leave the facts too.  Either way known rows keep their keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import clean as C
from ..operators import dims
from ..session import scratch_scope
from ..sources import csv as csvsrc
from ..sources import store
from .live import DATES, DIMENSIONS, FACTS, LiveWarehouse
from .warehouse import CLEAN_OF_DIM


def _batch(spark: SparkSession, root: str, layer: str, table: str, batch_id: int) -> DataFrame:
    return (store.read_table(spark, root, layer, table)
            .where(F.col("batch_id") == batch_id).drop("batch_id"))


def fact_dates(clean: dict[str, DataFrame]) -> DataFrame | None:
    """Every date that the facts of these clean tables look up."""
    parts = [clean[n].select(F.to_date(c).alias("d")) for n, cs in DATES.items() if n in clean for c in cs]
    for p in parts[1:]:
        parts[0] = parts[0].unionByName(p)
    return parts[0] if parts else None


def full_load(spark: SparkSession, paths: dict[str, str], root: str, batch_id: int,
              batch_ts: str, second_restaurant_feed: str | None = None, kind: str = "delta",
              multiline: bool = False) -> dict[str, int]:
    """Run one load; returns the number of quarantined rows per extract and,
    as ``pending_<fact>``, how many rows wait for their order and, as
    ``stray_dates_<table>``, how many have a date beyond the calendar."""
    if kind not in ("full", "delta"):
        raise ValueError(f"kind must be full or delta, not {kind}")
    report: dict[str, int] = {}
    run = f"load:{batch_id}"
    live = LiveWarehouse(spark, root)
    with scratch_scope(spark):
        for name, path in paths.items():
            r = csvsrc.read_source(spark, name, path, f"{name}_csv", batch_ts, multiline, copy=False)
            good, feeds = r.good, [(name, r)]
            if name == "restaurants" and second_restaurant_feed:
                r2 = csvsrc.read_source(spark, "restaurants_feed2", second_restaurant_feed,
                                        "restaurants_feed2_csv", batch_ts, multiline, copy=False)
                good = csvsrc.union_restaurant_feeds(good, r2.good)
                feeds.append(("restaurants_feed2", r2))
            store.write_batch(good, root, "stage", f"{name}_load", batch_id)
            for feed, r in feeds:
                bad = r.seen.get["bad"]
                store.write_batch(r.quarantine if bad else r.quarantine.limit(0), root, "stage", f"{feed}_quarantine",
                                  batch_id)
                report[feed] = (_batch(spark, root, "stage", f"{feed}_quarantine", batch_id).count() if bad else 0)

        stage = {n: _batch(spark, root, "stage", f"{n}_load", batch_id) for n in paths}
        clean = {n: live.put_clean(n, C.CLEANERS[n](s, batch_ts), run, kind) for n, s in stage.items()}
        if "orders" in stage:
            clean["ratings"] = live.put_clean("ratings", C.clean_ratings(stage["orders"], batch_ts), run, kind)

        dates = fact_dates(clean)
        if dates is not None:
            live.put_calendar(dates, run)
            report |= live.put_stray_dates(clean, run)
        live.put_time(run)
        for d in DIMENSIONS:
            entity = CLEAN_OF_DIM.get(d)
            if d == "delivery_person" and "delivery" in clean:
                live.put_dimension(d, clean["delivery"], batch_ts, run)
            elif entity in stage:
                latest = dims.latest_stage_rows(stage[entity], entity)
                live.put_dimension(d, C.CLEANERS[entity](latest, batch_ts), batch_ts, run)
        for f, (_, _, table, _) in FACTS.items():
            rows = clean.get(table)
            if rows is None and (waiting := live.pending(f)) is not None:
                rows = waiting.limit(0)  # only those that waited for an order
            if rows is not None:
                waits = live.put_fact(f, rows, batch_ts, run, kind if table in clean else "delta")
                if f != "order":
                    report[f"pending_{f}"] = waits
        live.put_rating_persons(run)  # of ratings of earlier loads
    return report


class StoredStar:
    """Read side of a loaded warehouse: ``fact(name)``/``dim(name)`` over the
    committed tables (newest snapshot; the fact rows that count now), e.g. for
    ``views.register_views``."""

    def __init__(self, spark: SparkSession, root: str):
        self.live = LiveWarehouse(spark, root)

    def dim(self, name: str) -> DataFrame:
        return self.live.dim(name)

    def fact(self, name: str) -> DataFrame:
        return self.live.fact(name)

    def unique(self, name: str) -> bool:
        return self.live.unique(name)
