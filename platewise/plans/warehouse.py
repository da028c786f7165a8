"""Full batch build of the star schema (stage → clean → dimensions → facts).

``Star`` builds each table on first use and memoises it, so a view only pays
for the tables it reads.  With ``materialize=True`` (default) every built
table — clean, dimension, fact — is written once as Parquet under the shared
scratch folder and read back, exactly as a scheduled load writes its layers:
a fact is computed once however many children and views use it, every
consumer plan starts from stored tables, and lineage stays short.  Tables that
cost a projection only (clean tables of stored sources), and facts that have
one reader (``once``), are no copies of their own.  With
``materialize=False`` the tables stay lazy (the caller writes them, e.g. with
``sources.store``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import calendar, clean, dims, facts
from ..operators.keys import is_unique
from ..session import materialize as _write_scratch

# Fixed batch time for reproducible runs; jobs pass their own.
DEFAULT_BATCH_TS = "2025-01-01 00:00:00"

# Facts that no other fact is built from.
LEAVES = ("order_item", "rating")

CLEAN_OF_DIM = {"restaurant": "restaurants", "customer": "customers",
                "product": "products", "promotion": "promotions"}


class Star:
    """Lazy star schema over a dict of stage frames (source layout)."""

    def __init__(self, stage: dict[str, DataFrame], batch_ts: str = DEFAULT_BATCH_TS,
                 fact_key_mode: str = "ordered", materialize: bool = True,
                 joined: tuple[str, ...] = (), narrow: tuple[str, ...] = ()):
        self.stage = stage
        # stage frames that are joins or aggregates: written once, cleaned where they are read
        self.joined = joined
        # those that are projections of stored tables: read and cleaned in place
        self.narrow = narrow
        self.batch_ts = batch_ts
        # "stored" once the clean tables are read back from storage (see facts)
        self.fact_key_mode = fact_key_mode
        self.materialize = materialize
        self._memo: dict[tuple[str, str], DataFrame] = {}
        self._unique: dict[str, bool] = {}

    def _get(self, kind: str, name: str, make) -> DataFrame:
        k = (kind, name)
        if k not in self._memo:
            df = make()
            self._memo[k] = _write_scratch(df, f"{kind}-{name}") if self.materialize else df
        return self._memo[k]

    # ---------------------------------------------------------------- clean --
    def source(self, name: str) -> DataFrame:
        """A stage frame, for however many readers."""
        return self._get("stage", name, lambda: self.stage[name]) if name in self.joined else self.stage[name]

    def clean(self, name: str) -> DataFrame:
        source = "orders" if name == "ratings" else name

        def make():
            if name == "ratings":
                return clean.clean_ratings(self.source(source), self.batch_ts)
            return clean.CLEANERS[name](self.source(source), self.batch_ts)
        return make() if source in (*self.joined, *self.narrow) else self._get("clean", name, make)

    def calendar_dates(self) -> DataFrame:
        """Every date a fact looks up: order, pick-up, delivery, rating."""
        parts = [self.clean("orders").select(F.to_date("order_date").alias("d"))]
        if "delivery" in self.stage:
            dl = self.clean("delivery")
            parts += [dl.select(F.to_date("pickup_time").alias("d")),
                      dl.select(F.to_date("delivery_time").alias("d"))]
        parts.append(self.clean("ratings").select(F.to_date("created_at").alias("d")))
        u = parts[0]
        for p in parts[1:]:
            u = u.unionByName(p)
        return u

    # ----------------------------------------------------------- dimensions --
    def dim(self, name: str) -> DataFrame:
        def make():
            ts = self.batch_ts
            if name == "date":
                return calendar.dim_date_covering(self.calendar_dates())
            if name == "time":
                return calendar.dim_time(self.clean("orders").sparkSession)
            if name == "delivery_person":
                src = dims.delivery_person_source(self.clean("delivery"))
                return dims.merge_dimension(name, None, src, ts)
            d = dims.merge_dimension(name, None, self.clean(CLEAN_OF_DIM[name]), ts)
            if name in ("product", "promotion"):
                d = dims.with_restaurant_sk(d, self.dim("restaurant"))
            return d
        return self._get("dim", name, make)

    # ---------------------------------------------------------------- facts --
    def fact(self, name: str, once: bool = False) -> DataFrame:
        """``once``: the caller reads it in one place only, so a fact that no
        other one is built from is left as a plan, of the columns read."""
        def make():
            ts, km = self.batch_ts, self.fact_key_mode
            if name == "order":
                return facts.fact_order(self.clean("orders"), self.dim("customer"),
                                        self.dim("restaurant"), self.dim("promotion"),
                                        self.dim("date"), self.dim("time"), ts, key_mode=km)
            if name == "order_item":
                return facts.fact_order_item(self.clean("order_items"), self.fact("order"),
                                             self.dim("product"), ts, key_mode=km)
            if name == "delivery":
                return facts.fact_delivery(self.clean("delivery"), self.fact("order"),
                                           self.dim("delivery_person"), self.dim("date"),
                                           self.dim("time"), ts, key_mode=km)
            if name == "rating":
                return facts.fact_rating(self.clean("ratings"), self.fact("order"),
                                         self.dim("customer"), self.dim("restaurant"),
                                         self.dim("delivery_person"), self.dim("date"),
                                         self.dim("time"), ts, key_mode=km,
                                         fact_delivery_df=self.fact("delivery"))
            raise KeyError(name)
        if once and name in LEAVES and ("fact", name) not in self._memo:
            return make()
        return self._get("fact", name, make)

    def unique(self, name: str) -> bool:
        """Whether no business key comes twice in a fact; looked up once."""
        if name not in self._unique:
            self._unique[name] = is_unique(self.fact(name), f"{name}_id")
        return self._unique[name]

    def tables(self, once: bool = False) -> dict[str, DataFrame]:
        """Every table of the star, keyed ``clean_*``, ``dim_*``, ``fact_*``;
        ``once``: each is read in one place, as by the audits."""
        out = {f"clean_{n}": self.clean(n) for n in [*clean.CLEANERS, "ratings"]
               if n == "ratings" or n in self.stage}
        for n in ["date", "time", "restaurant", "customer", "product", "promotion",
                  "delivery_person"]:
            out[f"dim_{n}"] = self.dim(n)
        for n in ["order", "order_item", "delivery", "rating"]:
            out[f"fact_{n}"] = self.fact(n, once)
        return out
