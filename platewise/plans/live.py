"""The stored warehouse through its life: full loads, delta loads, streams.

``LiveWarehouse`` is the one writer of the clean, dimension and fact tables
under a root, used by ``plans.load.full_load`` and by the micro-batch handlers
of ``streaming.incremental``.  Every write is a version in the control table
(``sources.control``), so load → load → stream is one sequence: dimensions are
merged into the newest snapshot, fact keys go on after the last one, and a
replayed run replaces exactly its own output.

Facts (``fact_<f>/batch_id=<version>``) are upserted by business key, the
latest row wins (rows that one extract gives the same key and time stay
together):

* a row whose business key is known keeps its surrogate key; the keys whose
  older rows it replaces go to ``replaced_<f>/batch_id=<version>`` and readers
  leave those out (the fact itself is never rewritten);
* a ``full`` extract replaces all earlier versions, with the same keys for
  the same business keys;
* both kinds of key look-up, of a fact's own rows and of the orders they
  belong to, go through the key index (``sources.keyindex``), so a run reads
  what its own keys touch and not the facts;
* rows whose order has not arrived are kept in ``pending_<f>`` and tried again
  by every later run; items wait there, deliveries and ratings are in the fact
  without a link until then;
* rows lie in folders by month (``month=<yyyymm>``, of the date in ``MONTH_OF``)
  below their version, and the control table has each version's months with
  their date keys: a date range reads the months it covers only;
* ``compact`` rewrites a fact as one version without replaced rows, and
  ``retire`` deletes what it superseded.
* a rating takes the delivery person of its order's delivery: ratings whose
  delivery is linked, arrives or changes later are upserted with its person
  (``put_rating_persons``).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import asdict, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.schemas import CLEAN_DDL, FACT_DDL, struct
from ..operators import calendar, dims, facts, scd2
from ..operators.keys import assign_keys, count_keys, is_unique
from ..session import materialize
from ..sources import buckets, keyindex, store
from ..sources.buckets import Bucketed, Manifest
from ..sources.control import Control

#: fact: (surrogate key, business key, clean table, how the latest row of a key is found)
FACTS = {
    "order": ("order_sk", "order_id", "orders", ["updated_at", "created_at"]),
    "order_item": ("order_item_sk", "order_item_id", "order_items", ["updated_at", "created_at"]),
    "delivery": ("delivery_sk", "delivery_id", "delivery", ["updated_at", "created_at"]),
    "rating": ("rating_sk", "rating_id", "ratings", ["created_at"]),
}
#: clean table: the columns whose dates its facts look up
DATES = {"orders": ["order_date"], "delivery": ["pickup_time", "delivery_time"], "ratings": ["created_at"]}
#: fact: the date key that its months follow (items have no date of their own)
MONTH_OF = {"order": "order_date_sk", "delivery": "delivery_date_sk", "rating": "rating_date_sk"}
#: fact: clean columns that its keys are looked up by, besides those that number its rows
LOOKED_UP = {
    "order": ["restaurant_id", "promotion_id"],
    "order_item": [],
    "delivery": ["delivery_person_id", "delivery_time"],
    "rating": ["customer_id", "restaurant_id", "delivery_person_id"],
}
DIMENSIONS = ["restaurant", "customer", "product", "promotion", "delivery_person"]


class LiveWarehouse:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.control = Control(spark, root)

    # ------------------------------------------------------------- reading --
    def dim(self, name: str, before: int | None = None) -> DataFrame | None:
        """All versions of a dimension as committed (before version ``before``), or None."""
        table = f"dim_{name}"
        v = self.control.last(table) if before is None else self.control.before(table, before)
        if v is None:
            return None
        if name in dims.SPECS:
            return self._buckets(name).rows(Manifest(**v.parts))
        return store.read_snapshot(self.spark, self.root, table, v.version)

    def current(self, name: str) -> DataFrame | None:
        """The current versions of a dimension; closed ones are not read."""
        v = self.control.last(f"dim_{name}")
        return None if v is None else self._buckets(name).current(Manifest(**v.parts))

    def _buckets(self, name: str) -> Bucketed:
        return Bucketed(self.spark, self.root, f"dim_{name}", dims.SPECS[name].key)

    def _versions(self, table: str, before: int | None) -> list[int]:
        """The last full version and what came after it."""
        done = [v for v in self.control.versions(table) if before is None or v.version < before]
        start = max((i for i, v in enumerate(done) if v.kind == "full"), default=0)
        return [v.version for v in done[start:]]

    def _stored(self, table: str, versions: list[int]) -> DataFrame:
        # with its declared layout: versions without rows have no file to take one from
        kind, _, name = table.partition("_")
        ddl = {"fact": lambda: FACT_DDL[name] + (", month int" if name in MONTH_OF else ""), "pending": lambda: CLEAN_DDL[FACTS[name][2]],
               "replaced": lambda: f"{FACTS[name][0]} bigint"}[kind]()
        return (store.read_table(self.spark, self.root, "consumption", table, ddl + ", batch_id bigint")
                .where(F.col("batch_id").isin(*versions)))

    def fact(self, name: str, before: int | None = None, between: tuple[str, str] | None = None,
             after: int | None = None) -> DataFrame | None:
        """Rows that count now (before version ``before``): no replaced ones;
        with ``after`` only those that later versions wrote.

        ``between``: first and last day (of the date in ``MONTH_OF``); only the
        versions and months that have such days are read.  Facts with a date
        keep their ``month`` (yyyymm), so a join with the calendar on it prunes
        folders too.
        """
        sk, table = FACTS[name][0], f"fact_{name}"
        versions = [v for v in self._versions(table, before) if after is None or v > after]
        if not versions:
            return None
        if between is None:
            rows = self._stored(table, versions)
        else:
            lo, hi = (self._date_key(day) for day in between)
            ranges = {v.version: v.parts.get("months", {}) for v in self.control.versions(table)}
            months = {int(m) for v in versions for m, (_, first, last) in ranges[v].items()
                      if first is not None and first <= hi and last >= lo}
            read = [v for v in versions if months.intersection(map(int, ranges[v]))]
            rows = (self._stored(table, read).where(F.col("month").isin(*sorted(months)))
                    .where(F.col(MONTH_OF[name]).between(lo, hi)))
        replacing = [v for v in self._versions(f"replaced_{name}", before) if v in versions[1:]]
        if replacing:
            # the newest version that replaces a key; few rows, Spark broadcasts them while small
            gone = (self._stored(f"replaced_{name}", replacing).groupBy(F.col(sk).alias("_gone"))
                    .agg(F.max("batch_id").alias("_since")))
            rows = (rows.join(gone, rows[sk] == gone["_gone"], "left")
                    .where(F.col("_since").isNull() | (F.col("batch_id") >= F.col("_since")))
                    .drop("_gone", "_since"))
        return rows.drop("batch_id")

    def unique(self, name: str) -> bool:
        """Whether no business key comes twice in a fact: every version that
        counts has it so, and an upsert leaves no older row of its keys."""
        counts = set(self._versions(f"keys_{name}", None))
        known = {v.version: v.parts.get("unique", False) for v in self.control.versions(f"keys_{name}")}
        return all(known[v] for v in counts) and counts >= set(self._versions(f"fact_{name}", None))

    def clean(self, name: str, version: int) -> DataFrame:
        return (store.read_table(self.spark, self.root, "clean", name, CLEAN_DDL[name] + ", batch_id bigint")
                .where(F.col("batch_id") == version).drop("batch_id"))

    def pending(self, name: str, before: int | None = None) -> DataFrame | None:
        """Clean rows that wait for their order, or None (the control table has their number)."""
        table = f"pending_{name}"
        v = self.control.last(table) if before is None else self.control.before(table, before)
        return None if v is None or not v.max_key else self._stored(table, [v.version]).drop("batch_id")

    def _date_key(self, day: str) -> int:
        """Date keys count days: the key of any day, in the calendar or not."""
        v = self.control.last("dim_date")
        origin = v.parts.get("origin") if v else None
        return (dt.date.fromisoformat(day) - dt.date.fromisoformat(origin)).days + 1 if origin else 0

    def _index(self, name: str) -> keyindex.KeyIndex:
        return keyindex.KeyIndex(self.spark, self.root, name)

    def keys_of(self, name: str, keys: DataFrame, before: int | None = None) -> DataFrame:
        """(key, sk, version) of the rows of fact ``name`` with these business keys."""
        return self._index(name).find(keys, self._segments(name, before))

    def _segments(self, name: str, before: int | None = None) -> list[keyindex.Segment]:
        versions = set(self._versions(f"fact_{name}", before))
        return keyindex.segments([v for v in self.control.versions(f"keys_{name}") if v.version in versions])

    def _keys_for(self, name: str, keys: DataFrame, most: int, before: int | None = None) -> DataFrame:
        """``keys_of`` for a join with up to ``most`` keys: may hold others."""
        found = self._index(name).whole(most, self._segments(name, before))
        return self.keys_of(name, keys, before) if found is None else found

    # ------------------------------------------------------------- writing --
    def put_clean(self, name: str, rows: DataFrame, run: str, kind: str = "delta") -> DataFrame:
        """Write a clean table's version and return it as stored."""
        v = self.control.version_for(f"clean_{name}", run)
        store.write_batch(rows, self.root, "clean", name, v)
        self.control.commit(f"clean_{name}", v, run, kind)
        return self.clean(name, v)

    def put_calendar(self, dates: DataFrame, run: str) -> None:
        """Date keys never change: later days go on after the last key, days
        before the first one get keys from 0 downwards.  Dates that the
        calendar has already change nothing."""
        table, c = "dim_date", dates.columns[0]
        v = self.control.version_for(table, run)
        last = self.control.before(table, v)
        known = last.parts if last else {}
        inside = F.col(c).between(F.lit(calendar.CALENDAR_START).cast("date"), F.lit(calendar.CALENDAR_END).cast("date"))
        lo, hi = dates.where(inside).agg(F.min(c), F.max(c)).first()
        if known and (lo is None or known["lo"] <= str(lo) and str(hi) <= known["hi"]):
            return
        days = [d for d in (lo, hi, known.get("lo"), known.get("hi")) if d is not None]
        span = self.spark.createDataFrame([(str(d),) for d in days], "d string").select(F.to_date("d").alias("d"))
        store.write_snapshot(calendar.dim_date_covering(span, origin=known.get("origin")), self.root, table, v)
        found = store.read_snapshot(self.spark, self.root, table, v).agg(
            F.min("date_id"), F.max("date_id"), F.max(F.when(F.col("date_sk") == 1, F.col("date_id")))).first()
        parts = dict(zip(("lo", "hi", "origin"), map(str, found))) if found[0] is not None else {}
        self.control.commit(table, v, run, "full", parts=parts)

    def put_stray_dates(self, clean: dict[str, DataFrame], run: str) -> dict[str, int]:
        """Write the clean rows with a date beyond the calendar's bounds, whose
        facts have no key for it, to ``stage/<table>_stray_dates``; returns
        their number for each table, as ``stray_dates_<table>``."""
        counts = {}
        for name in DATES.keys() & clean.keys():
            table, stray = f"{name}_stray_dates", F.lit(False)
            for c in DATES[name]:
                inside = F.to_date(c).between(F.lit(calendar.CALENDAR_START).cast("date"),
                                              F.lit(calendar.CALENDAR_END).cast("date"))
                stray = stray | F.coalesce(~inside, F.lit(False))
            rows = clean[name].where(stray)
            counts[f"stray_dates_{name}"] = n = rows.count()
            if n:
                v = self.control.version_for(table, run)
                store.write_batch(rows, self.root, "stage", table, v)
                self.control.commit(table, v, run)
        return counts

    def put_time(self, run: str) -> None:
        v = self.control.version_for("dim_time", run)
        store.write_snapshot(calendar.dim_time(self.spark), self.root, "dim_time", v)
        self.control.commit("dim_time", v, run, "full")

    def put_dimension(self, name: str, source: DataFrame, batch_ts: str, run: str,
                      touched_only: bool = False) -> None:
        """SCD2-merge clean rows (delivery persons: clean deliveries) into the
        stored dimension.

        Read are the buckets that the batch's keys fall into; written are those
        with a new version, and closed versions are added to the others.
        Products and promotions carry the key of their current restaurant
        version: buckets with a row whose restaurant has a newer one count as
        touched.  ``touched_only`` suits small batches: inside the buckets too
        only rows of the batch's keys meet it.
        """
        table, spec = f"dim_{name}", dims.SPECS[name]
        v = self.control.version_for(table, run)
        last = self.control.before(table, v)
        if name == "delivery_person":
            source = dims.delivery_person_source(source)
        restaurants = self.current("restaurant") if name in dims.LINKED_TO_RESTAURANT else None
        links = self.control.last("dim_restaurant").version if restaurants is not None else None
        if name in dims.LINKED_TO_RESTAURANT:
            spec = replace(spec, carried=[*spec.carried, "restaurant_sk"])
            source = source.withColumn("restaurant_sk", F.lit(None).cast("bigint"))
        src = materialize(scd2.latest_source(source, spec, dims.LATEST_BY[name]), "scd2-source")
        store_, old = self._buckets(name), Manifest(**last.parts) if last else None
        next_key = last.max_key if last else 0

        def linked(rows: DataFrame) -> DataFrame:
            if restaurants is None:
                return rows
            return dims.with_restaurant_sk(rows.drop("restaurant_sk"), restaurants).select(*rows.columns)

        if old is None:
            count = src.count()
            n, which, closed = buckets.power_of_two(count, buckets.BUCKET_ROWS), None, None
            fresh = materialize(scd2.first_versions(src, spec, batch_ts), "scd2-fresh")
            new, rows = linked(fresh), count
        else:
            n, which = old.n, store_.touched(src, old.n)
            moved = self._relinked(name, old, links)
            which = sorted({*which, *moved})
            if old.rows > 4 * buckets.BUCKET_ROWS * n:  # split all
                n, which = buckets.power_of_two(old.rows, buckets.BUCKET_ROWS), None
            met, aside = scd2.merged_rows(store_.current(old, which).select(*spec.columns), src, spec, batch_ts,
                                          touched_only)
            opened = met.where(F.col(spec.sk).isNull())
            counted = met.agg(F.count_if(F.col(spec.sk).isNull()), F.count_if(~F.col("is_current"))).first()
            rows = old.rows + counted[0] - counted[1]
            if which is not None:  # of the buckets read, those with a new version (or a new link) are written
                which = sorted({*store_.touched(opened, n), *moved})
                if not which:
                    parts = replace(old, links=links)
                    self.control.commit(table, v, run, "full", next_key, asdict(parts))
                    return
            fresh = materialize(assign_keys(opened.drop(spec.sk), spec.sk, [spec.key], offset=next_key)
                                .select(*spec.columns), "scd2-fresh")
            kept = met.where(F.col(spec.sk).isNotNull() & F.col("is_current"))
            kept = kept if aside is None else kept.unionByName(aside)
            if which is not None:
                kept = kept.where(buckets.bucket_of(spec.key, n).isin(*which))
            new = linked(kept.unionByName(fresh))
            closed = met.where(~F.col("is_current")) if counted[1] else None
        top = fresh.agg(F.max(spec.sk)).first()[0]
        parts = store_.put(old, v, n, new, which, closed, rows, links)
        self.control.commit(table, v, run, "full", max(next_key, top or 0), asdict(parts))

    def _relinked(self, name: str, old: Manifest, links: int | None) -> list[int]:
        """Buckets with a current row whose restaurant has another current
        version than the row's link says; looked for only if restaurants have
        changed since the links were made, in two columns."""
        if links is None or links == old.links:
            return []
        store_ = self._buckets(name)
        restaurants = Manifest(**self.control.last("dim_restaurant").parts)
        of = self._buckets("restaurant")
        gone = of.closed(restaurants, after=-1 if old.links is None else old.links).select("restaurant_sk")
        rows = store_.current(old).select(dims.SPECS[name].key, "restaurant_id", "restaurant_sk")
        came = of.current(restaurants).select("restaurant_id")
        stale = rows.join(gone, "restaurant_sk", "left_semi").select(*rows.columns).unionByName(
            rows.where("restaurant_sk IS NULL").join(came, "restaurant_id", "left_semi").select(*rows.columns))
        return store_.touched(stale, old.n)

    def _build(self, name: str, rows: DataFrame, orders: DataFrame | None, batch_ts: str, offset: int
               ) -> DataFrame:
        def d(dim: str) -> DataFrame:
            found = self.current(dim) if dim in dims.SPECS else self.dim(dim)
            if found is None:  # not loaded yet: no key is found
                spec = dims.SPECS[dim]
                found = self.spark.createDataFrame([], f"{spec.key} string, {spec.sk} long, is_current boolean")
            return found

        if name == "order":
            return facts.fact_order(rows, d("customer"), d("restaurant"), d("promotion"), d("date"), d("time"),
                                    batch_ts, key_offset=offset, key_mode="ordered")
        if name == "order_item":
            return facts.fact_order_item(rows, orders, d("product"), batch_ts, key_offset=offset,
                                         key_mode="ordered")
        if name == "delivery":
            return facts.fact_delivery(rows, orders, d("delivery_person"), d("date"), d("time"), batch_ts,
                                       key_offset=offset, key_mode="ordered")
        delivery = self.fact("delivery")
        if delivery is not None:  # those of this batch's orders
            delivery = delivery.join((rows if orders is None else orders).select("order_sk"), "order_sk", "left_semi")
        return facts.fact_rating(rows, orders, d("customer"), d("restaurant"), d("delivery_person"), d("date"),
                                 d("time"), batch_ts, key_offset=offset, key_mode="ordered",
                                 fact_delivery_df=delivery)

    def put_fact(self, name: str, rows: DataFrame, batch_ts: str, run: str, kind: str = "delta") -> int:
        """Upsert clean rows into a fact; returns how many rows wait for their
        order.  Rows without a business key are all kept."""
        sk, key, clean_table, latest = FACTS[name]
        table = f"fact_{name}"
        v = self.control.version_for(table, run)
        last = self.control.before(table, v)
        offset = last.max_key if last else 0
        waits = None
        if name != "order":
            held = self.pending(name, before=self.control.version_for(f"pending_{name}", run))
            if held is not None and kind != "full":
                rows = held.withColumn("_held", F.lit(True)).unionByName(rows.withColumn("_held", F.lit(False)))
            else:
                rows = rows.withColumn("_held", F.lit(False))
        # a batch without a key that comes twice, as most are, needs no sort of whole rows
        (most, once), orders = count_keys(rows, key), None
        replaced, linked = None, name == "order" or all(s.unique for s in self._segments("order"))
        if linked:  # a link adds no rows, so that keys are found with it, before rows are numbered
            rows, waits, replaced = self._keyed(name, rows, most, once, v, kind)
        else:  # an order id that comes twice
            rows = rows if once else self._newest(rows, key, latest)
            orders = self.keys_of("order", rows.select("order_id")).select(
                F.col("key").alias("order_id"), F.col("sk").alias("order_sk"))
            known = orders.select(F.col("order_id").alias("_o")).distinct()
            rows = rows.join(known, F.col("order_id") == F.col("_o"), "left")
            rows = materialize(rows.withColumn("_found", F.col("_o").isNotNull()).drop("_o"), "fact-input")
            waits = rows.where(~F.col("_found") & F.col("order_id").isNotNull()).drop("_held", "_found")
            # what waited and still finds no order is in the fact already, or waits on
            rows = rows.where(F.col("_found") if name == "order_item" else F.col("_found") | ~F.col("_held"))
            rows = rows.drop("_held", "_found")
        fact = self._build(name, rows, orders, batch_ts, offset)
        # what is stored, with this run's own output if it runs again: keys stay
        if not linked and self._versions(table, v + 1):
            old = self.keys_of(name, rows.select(key), before=v + 1).select(
                F.col("key").alias("_k"), F.col("sk").alias("_sk"))
            # one row a key on both sides (current versions have one row a key, so look-ups add none)
            if once and is_unique(old, "_k") and (orders is None or is_unique(orders, "order_id")):
                fact = fact.join(old, F.col(key) == F.col("_k"), "left")
            else:  # the n-th row of a key goes on with its n-th surrogate key
                nth = old.withColumn("_on", F.row_number().over(W.partitionBy("_k").orderBy("_sk")))
                fact = fact.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(sk)))
                fact = fact.join(nth, (F.col(key) == F.col("_k")) & (F.col("_n") == F.col("_on")), "left").drop("_n", "_on")
            fact = fact.withColumn(sk, F.coalesce("_sk", sk)).drop("_k", "_sk")
            replaced = old.select(F.col("_sk").alias(sk))
        parts, count, top = self._write_fact(name, v, fact)
        if replaced is not None and kind != "full" and not replaced.isEmpty():
            # the replaced keys carry the fact's version and count once that is committed
            store.write_batch(replaced, self.root, "consumption", f"replaced_{name}", v)
            self.control.commit(f"replaced_{name}", v, run)
        self._write_index(name, v, run, kind, count)
        n_waits = 0
        if waits is not None:
            pv = self.control.version_for(f"pending_{name}", run)
            n_waits = waits.count()
            store.write_batch(waits, self.root, "consumption", f"pending_{name}", pv)
            self.control.commit(f"pending_{name}", pv, run, "full", n_waits)
        self.control.commit(table, v, run, kind, max(offset, top), parts)
        return n_waits

    def _keyed(self, name: str, rows: DataFrame, most: int, once: bool, v: int, kind: str
               ) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """The newest rows of a batch with the surrogate keys that are stored
        for their business keys and, but for orders, with their order's; the
        rows that wait for their order; the surrogate keys whose older rows
        are replaced.  No order id comes twice in the index."""
        sk, key, _, latest = FACTS[name]
        segments = self._segments(name, v + 1)  # with this run's own output if it runs again: keys stay
        old, keep = None, F.lit(True)
        if segments:
            old = self._keys_for(name, rows.select(key), most, v + 1)
        if name != "order":
            orders = self._keys_for("order", rows.select("order_id"), most)
            rows = rows.join(orders.select(F.col("key").alias("_o"), F.col("sk").alias("order_sk")),
                             F.col("order_id") == F.col("_o"), "left").drop("_o")
            # what waited and still finds no order is in the fact already, or waits on
            keep = F.col("order_sk").isNotNull() if name == "order_item" else F.col("order_sk").isNotNull() | ~F.col("_held")
        if once and all(s.unique for s in segments):  # one row a key on both sides
            if old is not None:
                rows = rows.join(old.select(F.col("key").alias("_k"), F.col("sk").alias(sk)), F.col(key) == F.col("_k"),
                                 "left").drop("_k")
            elif name == "order":
                return rows, None, None
            rows, gone = materialize(rows, "keyed-input"), None
            if old is not None and kind != "full":
                gone = rows.where(keep & F.col(sk).isNotNull()).select(sk)
        else:
            rows = materialize(self._paired(name, rows, keep, old), "fact-input")
            gone = rows.where("_stored").select(sk) if old is not None and kind != "full" else None
            rows = rows.where("NOT _stored")
            rows = rows.drop("_stored", *([] if old is not None else [sk]))
        waits = None
        if name != "order":
            waits = rows.where(F.col("order_sk").isNull() & F.col("order_id").isNotNull()).drop("_held", "order_sk", sk)
            rows = rows.where(keep).drop("_held")
        # the sort for new keys carries only what the fact is made of
        names = {f.name for f in struct(FACT_DDL[name]).fields} | {*facts.ORDER[name], *LOOKED_UP[name]}
        return rows.select(*[c for c in rows.columns if c in names]), waits, gone

    @staticmethod
    def _paired(name: str, rows: DataFrame, keep: Column, old: DataFrame | None) -> DataFrame:
        """The rows of each business key that none is newer than (the latest,
        and those that the extract gives the same time), the n-th of those to
        ``keep`` with the n-th stored surrogate key; and, as ``_stored``, a row
        for each surrogate key that they replace.  One exchange by the key."""
        sk, key, _, latest = FACTS[name]
        if "_held" in rows.columns:  # at the same time, a new row beats the one that waited
            rows = rows.withColumn("_new", ~F.col("_held"))
            latest = [*latest, "_new"]
        # rows without a key are all kept: they are spread by content
        rows = rows.withColumns({"_salt": F.when(F.col(key).isNull(), F.xxhash64(*facts.ORDER[name])), "_keep": keep,
                                 "_old": F.lit(None).cast("bigint")})
        if old is not None:
            rows = rows.unionByName(old.select(F.col("key").alias(key), F.col("sk").alias("_old")), allowMissingColumns=True)
        rows = rows.repartition(key, "_salt").withColumn("_stored", F.col("_old").isNotNull())
        time = F.struct(*latest)
        by = W.partitionBy(key, "_salt", "_stored").orderBy(time.desc(), F.col("_keep").desc(), *facts.ORDER[name], "_old")
        rows = rows.withColumns({"_n": F.row_number().over(by), "_top": F.first(time).over(by)})
        rows = rows.where(F.col("_stored") | F.col(key).isNull() | time.eqNullSafe(F.col("_top")))
        sk_of = F.lit(None).cast("bigint")
        if old is not None:
            has = F.max(F.coalesce("_keep", F.lit(False))).over(W.partitionBy(key, "_salt"))
            rows = rows.withColumn("_has", has).where("NOT _stored OR _has").drop("_has")
            sk_of = F.max("_old").over(W.partitionBy(key, "_salt", "_n"))
        rows = rows.withColumn(sk, sk_of)
        return rows.drop("_salt", "_keep", "_old", "_n", "_top", "_new")

    def _write_fact(self, name: str, v: int, fact: DataFrame) -> tuple[dict, int, int]:
        """Write a version's rows by month; returns its parts ({month: [rows,
        first date key, last date key]}), its rows and its largest key."""
        sk, day = FACTS[name][0], MONTH_OF.get(name)
        if day is None:
            store.write_batch(fact, self.root, "consumption", f"fact_{name}", v)
            count, top = self._stored(f"fact_{name}", [v]).agg(F.count(F.lit(1)), F.max(sk)).first()
            return {}, count, top or 0
        calendar_ = self.dim("date")
        if calendar_ is None:
            fact = fact.withColumn("month", F.lit(None).cast("int"))
        else:  # bounded by the calendar
            months = F.broadcast(calendar_.select(F.col("date_sk").alias("_d"), (
                F.col("year") * 100 + F.col("month_number")).alias("month")))
            fact = fact.drop("month").join(months, F.col(day) == F.col("_d"), "left").drop("_d")
        store.write_batch(fact, self.root, "consumption", f"fact_{name}", v, also=["month"])
        found = (self._stored(f"fact_{name}", [v]).groupBy("month")
                 .agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("lo"), F.max(day).alias("hi"),
                      F.max(sk).alias("top")).collect())  # a row a month
        months = {str(r.month): [r.n, r.lo, r.hi] for r in found if r.month is not None}
        return {"months": months}, sum(r.n for r in found), max((r.top for r in found), default=0)

    def _write_index(self, name: str, v: int, run: str, kind: str, count: int) -> None:
        sk, key = FACTS[name][:2]
        rows = self._stored(f"fact_{name}", [v]).select(F.col(key).alias("key"), F.col(sk).alias("sk"))
        self.control.commit(f"keys_{name}", v, run, kind, parts=self._index(name).put(v, rows, count))

    def compact(self, name: str, run: str) -> None:
        """Rewrite a fact as one version: the rows that count now, by month,
        and one segment of its key index.  Readers see the old versions until
        the new one is committed.  Nothing happens if there is one version."""
        table = f"fact_{name}"
        v = self.control.version_for(table, run)
        last = self.control.before(table, v)
        if last is None or len(self._versions(table, v)) == 1:
            return
        parts, count, _ = self._write_fact(name, v, self.fact(name, before=v))
        self._write_index(name, v, run, "full", count)
        self.control.commit(table, v, run, "full", last.max_key, parts)

    def retire(self, name: str, keep: int = 1) -> list[int]:
        """Delete the versions of a fact that a full one superseded, but for
        the last ``keep`` full ones that went before it, which readers may
        still be at; returns the versions deleted."""
        table = f"fact_{name}"
        done = self.control.versions(table)
        full = [v.version for v in done if v.kind == "full"]
        if len(full) <= keep:
            return []
        gone = [v.version for v in done if v.version < full[-1 - keep]]
        for version in gone:
            for t in (f"keys_{name}", f"replaced_{name}", table):
                old = next((v for v in self.control.versions(t) if v.version == version), None)
                if old is None:
                    continue
                self.control.forget(t, version)  # first, so that no reader is sent to deleted files
                folder = f"v={old.parts['token']}" if "token" in old.parts else f"batch_id={version}"
                store.delete(self.spark, f"{store.table_path(self.root, 'consumption', t)}/{folder}")
        return gone

    def put_rating_persons(self, run: str) -> None:
        """Upsert the stored ratings whose delivery person differs after the
        deliveries that ``run`` wrote, linked or replaced; nothing else of
        them changes.  (No source names a rating's person itself.)"""
        sk, table, own = FACTS["rating"][0], "fact_rating", f"{run}:persons"
        wrote = next((v for v in self.control.versions("fact_delivery") if v.run == run), None)
        v = self.control.version_for(table, own)
        ratings = self.fact("rating", before=v)
        if wrote is None or ratings is None:
            return
        touched = self._stored("fact_delivery", [wrote.version]).select("order_sk")
        old = self.fact("delivery", before=wrote.version)
        if old is not None and wrote.kind != "full":
            replaced = [r.version for r in self.control.versions("replaced_delivery") if r.version == wrote.version]
            old = old.join(self._stored("replaced_delivery", replaced).select("delivery_sk"), "delivery_sk",
                           "left_semi") if replaced else None
        if old is not None:  # a delivery may have left an order
            touched = touched.unionByName(old.select("order_sk"))
        touched = materialize(touched.where("order_sk IS NOT NULL").distinct(), "touched-orders")
        person = facts.person_of_order(self.fact("delivery").join(touched, "order_sk", "left_semi"))
        ratings = ratings.join(touched, "order_sk", "left_semi")
        changed = (ratings.join(person, F.col("order_sk") == F.col("_osk"), "left")
                   .where(~F.col("delivery_person_sk").eqNullSafe(F.col("_person")))
                   .withColumn("delivery_person_sk", F.col("_person")).select(*ratings.columns))
        changed = materialize(changed, "rating-persons")
        if changed.isEmpty():
            return
        parts, count, _ = self._write_fact("rating", v, changed)
        store.write_batch(changed.select(sk), self.root, "consumption", "replaced_rating", v)
        self.control.commit("replaced_rating", v, own)
        self._write_index("rating", v, own, "delta", count)
        self.control.commit(table, v, own, max_key=self.control.before(table, v).max_key, parts=parts)

    @staticmethod
    def _newest(rows: DataFrame, key: str, latest: list[str]) -> DataFrame:
        """The rows of each business key that none is newer than: the latest,
        and with it those that the extract gives the same time."""
        order = [*latest, *(["_new"] if "_held" in rows.columns else [])]
        if "_held" in rows.columns:  # at the same time, a new row beats the one that waited
            rows = rows.withColumn("_new", ~F.col("_held"))
        top = F.max(F.struct(*order)).over(W.partitionBy(key))
        ranked = rows.where(F.col(key).isNotNull()).withColumn("_top", top)
        return (ranked.where(F.struct(*order).eqNullSafe(F.col("_top"))).drop("_top")
                .unionByName(rows.where(F.col(key).isNull())).drop("_new"))
