"""Slowly changing dimensions, type 2 (D-SCD2, W3, W4, SK2).

Parquet has no MERGE, so the merge is a DataFrame plan:

* ``latest_per_key`` — one source row per key (the latest), via
  ``max_by(struct, order)``: a partial aggregate, so a hot key is combined
  map-side before the shuffle.
* ``scd2_merge`` — full outer join of that source with the *current* slice of
  the dimension on the business key (both sides have ≤ 1 row per key, so no
  key can be hot), then one pass that emits per key: the untouched current
  row, or the expired current row plus a new version, or a new key.  Closed
  history is never shuffled; it is unioned back as is.
* ``scd2_from_log`` — rebuild the whole version history from a change log
  by the change points of one sort, see ``changes``.

Changes are detected with a null-safe comparison of the tracked columns as one
struct, so a change to or from null is a change.  One batch timestamp is used
for expiry and the new version, so both always pair up.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .changes import change_points
from .keys import assign_keys

SCD_COLS = ["effective_from", "effective_to", "is_current"]


@dataclass(frozen=True)
class Scd2Spec:
    """How one dimension is versioned."""
    sk: str                      # surrogate key column
    key: str                     # business key column
    tracked: list[str]           # a change here opens a new version
    carried: list[str] = field(default_factory=list)  # copied, not compared

    @property
    def attrs(self) -> list[str]:
        return self.tracked + [c for c in self.carried if c not in self.tracked]

    @property
    def columns(self) -> list[str]:
        return [self.sk, self.key, *self.attrs, *SCD_COLS, "dw_created_at"]


def latest_per_key(df: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """Latest row per key (W3): ``max_by`` on the order columns."""
    payload = [c for c in df.columns if c != key]
    agg = df.groupBy(key).agg(
        F.max_by(F.struct(*payload), F.struct(*[F.col(c) for c in order_by])).alias("_r"))
    return agg.select(key, *[F.col("_r." + c).alias(c) for c in payload])


def latest_source(source: DataFrame, spec: Scd2Spec, order_by: list[str] | None) -> DataFrame:
    """One row (key and attributes) for each key of a batch: the latest by
    ``order_by``, full ties by content; rows without a key are left out."""
    src = source.select(*dict.fromkeys([spec.key, *spec.attrs, *(order_by or [])]))
    if order_by:
        # full ties are decided by content, so every evaluation picks the same row
        tie = F.xxhash64(*[c for c in src.columns if c != spec.key])
        src = latest_per_key(src.withColumn("_tie", tie), spec.key, [*order_by, "_tie"])
    return src.select(spec.key, *spec.attrs).where(F.col(spec.key).isNotNull())


def first_versions(src: DataFrame, spec: Scd2Spec, batch_ts: str, next_key: int = 0) -> DataFrame:
    """The versions of an initial load: every key is new, no join needed."""
    ts = F.lit(batch_ts).cast("timestamp_ntz")
    fresh = src.select(spec.key, *spec.attrs, ts.alias("effective_from"),
                       F.lit(None).cast("timestamp_ntz").alias("effective_to"),
                       F.lit(True).alias("is_current"), ts.alias("dw_created_at"))
    return assign_keys(fresh, spec.sk, [spec.key], offset=int(next_key)).select(*spec.columns)


def merged_rows(cur: DataFrame, src: DataFrame, spec: Scd2Spec, batch_ts: str, touched_only: bool = False
                ) -> tuple[DataFrame, DataFrame | None]:
    """What one batch makes of current rows: the rows that met the batch, some
    of them closed, and the versions it opens, which have no surrogate key yet
    (written); and with ``touched_only`` the current rows whose key the batch
    doesn't have, which never meet it (else None, they are among the first)."""
    ts = F.lit(batch_ts).cast("timestamp_ntz")
    passthrough = None
    if touched_only:
        keys = src.select(spec.key)
        passthrough = cur.join(keys, spec.key, "left_anti").select(*spec.columns)
        cur = cur.join(keys, spec.key, "left_semi")
    s = src.select(*[F.col(c).alias("s_" + c) for c in src.columns])
    c = cur.select(*[F.col(x).alias("c_" + x) for x in cur.columns])
    # with touched_only every current row left has a source row: a left join
    how = "left" if touched_only else "full_outer"
    j = s.join(c, s["s_" + spec.key] == c["c_" + spec.key], how)

    has_s = F.col("s_" + spec.key).isNotNull()
    has_c = F.col("c_" + spec.key).isNotNull()
    same = F.struct(*[F.col("s_" + a) for a in spec.tracked]).eqNullSafe(
        F.struct(*[F.col("c_" + a) for a in spec.tracked]))
    changed = has_s & has_c & ~same
    opens = has_s & (~has_c | changed)

    def row(prefix: str, sk, eff_from, eff_to, current, created):
        fields = [sk.cast("bigint").alias(spec.sk), F.col(prefix + spec.key).alias(spec.key)]
        fields += [F.col(prefix + a).alias(a) for a in spec.attrs]
        fields += [eff_from.alias("effective_from"), eff_to.alias("effective_to"),
                   current.alias("is_current"), created.alias("dw_created_at")]
        return F.struct(*fields)

    old = row("c_", F.col("c_" + spec.sk), F.col("c_effective_from"),
              F.when(changed, ts).otherwise(F.col("c_effective_to")),
              ~changed, F.col("c_dw_created_at"))
    new = row("s_", F.lit(None), ts, F.lit(None).cast("timestamp_ntz"),
              F.lit(True), ts)
    rows = j.select(F.explode(F.array_compact(F.array(
        F.when(has_c, old), F.when(opens, new)))).alias("r")).select("r.*")
    return materialize(rows, "scd2-rows"), passthrough  # join and classify once, for all readers


def scd2_merge(dim: DataFrame | None, source: DataFrame, spec: Scd2Spec, batch_ts: str,
               order_by: list[str] | None = None, next_key: int | None = None,
               touched_only: bool = False) -> DataFrame:
    """Apply one source batch to a type-2 dimension; returns the new snapshot.

    ``source`` may hold several rows per key; the latest by ``order_by``
    wins, full ties by content.
    Keys missing from the source stay current (no delete branch).
    ``next_key`` is the current maximum surrogate key; computed when omitted.

    ``touched_only=True`` suits small incremental batches against a large
    dimension: the current slice is split by a left-semi / left-anti join
    with the batch's keys (which the planner can broadcast), so untouched
    current rows are never shuffled and only the touched ones meet the batch.
    The default full outer join suits full extracts (most keys present).
    (A stored dimension is merged bucket by bucket: ``plans.live``.)
    """
    src = latest_source(source, spec, order_by)
    if dim is None:
        return first_versions(src, spec, batch_ts, next_key or 0)
    dim = dim.select(*spec.columns)
    if next_key is None:
        # one scalar to the driver: where the key sequence continues
        next_key = dim.agg(F.max(spec.sk)).first()[0] or 0
    rows, passthrough = merged_rows(dim.where(F.col("is_current")), src, spec, batch_ts, touched_only)
    fresh = assign_keys(rows.where(F.col(spec.sk).isNull()).drop(spec.sk), spec.sk,
                        [spec.key], offset=int(next_key))
    out = (dim.where(~F.col("is_current")).unionByName(rows.where(F.col(spec.sk).isNotNull()))
           .unionByName(fresh.select(*spec.columns)))
    return out if passthrough is None else out.unionByName(passthrough)


def scd2_from_log(log: DataFrame, spec: Scd2Spec, event_time: str, tie: list[str],
                  load_ts: str | None = None) -> DataFrame:
    """Build the full version history from a change log.

    A row opens a version when its tracked columns differ (null-safe) from the
    previous log row of the key; repeats of the same values are not versions.
    ``effective_to`` is the next version's ``effective_from``.  Keys follow
    (key, effective_from, tie) order: they come with the change points, from
    the one sort of the log (``changes``).
    """
    base = log.select(*dict.fromkeys([spec.key, *spec.attrs, event_time, *tie]))
    points = change_points(base, spec.key, event_time, tie, spec.tracked)
    created = F.lit(load_ts).cast("timestamp_ntz") if load_ts else F.col(event_time)
    return points.select(
        F.col("position").alias(spec.sk), spec.key, *spec.attrs,
        F.col(event_time).alias("effective_from"),
        F.col("next_time").alias("effective_to"),
        F.col("next_time").isNull().alias("is_current"),
        created.alias("dw_created_at")).select(*spec.columns)
