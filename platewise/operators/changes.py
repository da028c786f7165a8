"""Change points of a log in one sort.

A row is a change point when its tracked columns differ, null-safe, from the
row before it in its key's order; each change point lasts until the next one
of its key.  The log is sorted by range of (key, order), so that a key with a
third of all rows, or a day with most of one key's, lies in as many tasks as
its size asks for.  A task compares neighbours as its rows stream by, holds
one change point at a time and writes what it knows; what it can't know, the
row before its first one and the change point after its last one, follows
from one row a task: its edges, which are few and are put in order on the
driver.  That is one exchange for all change points, their ends and their
positions in the order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..session import materialize

# What a written row is: the first row of its task, a change point, or the last row of its task.
FIRST, POINT, LAST = 0, 1, 2


def differ(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Which rows, from the second on, differ from the row before, nulls and
    NaN being equal to themselves."""
    n = table.num_rows - 1
    out = np.zeros(n, bool)
    for c in columns:
        col = table.column(c).combine_chunks()
        a, b = col.slice(0, n), col.slice(1, n)
        ne = pc.fill_null(pc.not_equal(a, b), False)
        if pa.types.is_floating(col.type):
            ne = pc.and_(ne, pc.invert(pc.and_(pc.fill_null(pc.is_nan(a), False), pc.fill_null(pc.is_nan(b), False))))
        out |= ne.to_numpy(zero_copy_only=False)
        out |= a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False)
    return out


def change_points(log: DataFrame, key: str, time: str, tie: list[str], tracked: list[str]) -> DataFrame:
    """The rows of ``log`` that are change points, with ``next_time`` (the time
    of the key's next change point, null for the last) and ``position`` (from
    1, in the order of key, time and tie).  Rows that are equal in all of
    these must be equal in ``tracked`` too.  Written."""
    order = [key, time, *tie]
    columns = log.columns
    more = log.withColumns({"next_time": F.col(time), "_part": F.lit(0), "_kind": F.lit(0), "_at": F.lit(0).cast("long")})
    schema = StructType([StructField(f.name, f.dataType, True) for f in more.schema])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: pa.Table | None = None     # the row before
        point: pa.Table | None = None    # the change point whose end isn't known yet
        at = 0

        def written(rows: pa.Table, ends: pa.Array, kind: int, first_at: int) -> list[pa.RecordBatch]:
            n = rows.num_rows
            out = rows.append_column("next_time", ends.cast(arrow.field("next_time").type))
            out = out.append_column("_part", pa.array(np.full(n, part, np.int32)))
            out = out.append_column("_kind", pa.array(np.full(n, kind, np.int32)))
            out = out.append_column("_at", pa.array(np.arange(first_at, first_at + n)))
            return out.cast(arrow).to_batches()

        def nothing(n: int) -> pa.Array:
            return pa.nulls(n, arrow.field("next_time").type)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if last is None:
                yield from written(rows.slice(0, 1), nothing(1), FIRST, 0)
                both = rows
                new = np.empty(0, bool)
            else:
                both = pa.concat_tables([last, rows])
            new = differ(both, [key, *tracked])
            points = both.slice(1).filter(pa.array(new))
            last = rows.slice(rows.num_rows - 1)
            held = points if point is None else pa.concat_tables([point, points])
            if held.num_rows > 1:
                done, after = held.slice(0, held.num_rows - 1), held.slice(1)
                own = pa.array(~differ(held, [key]))
                yield from written(done, pc.if_else(own, after.column(time).combine_chunks(), None), POINT, at)
                at += done.num_rows
            if held.num_rows:
                point = held.slice(held.num_rows - 1)
        if point is not None:
            yield from written(point, nothing(1), POINT, at)
        if last is not None:
            yield from written(last, nothing(1), LAST, 0)

    by = [F.col(c).asc() for c in order]
    found = materialize(log.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema), "change-points")
    return _joined(found, columns, key, time, tracked)


def _joined(found: DataFrame, columns: list[str], key: str, time: str, tracked: list[str]) -> DataFrame:
    """Settle what tasks couldn't know of their neighbours: a few rows a task."""
    spark = found.sparkSession
    # per task: its first and last row, the first and last change point behind the first row, and their number
    edge = found.groupBy("_part").agg(
        F.max(F.when(F.col("_kind") == FIRST, F.struct(key, time, *tracked))).alias("first"),
        F.max(F.when(F.col("_kind") == LAST, F.struct(key, *tracked))).alias("last"),
        F.count_if(F.col("_kind") == POINT).alias("n"),
        F.min(F.when((F.col("_kind") == POINT) & (F.col("_at") == 0), F.struct(key, time))).alias("next"),
        F.max_by(F.struct(key), F.when(F.col("_kind") == POINT, F.col("_at"))).alias("tail"))
    edges = sorted(edge.collect(), key=lambda r: r["_part"])

    def same(a, b) -> bool:
        return all(x == y or (x != x and y != y) for x, y in zip(a, b))

    opens, before, start = [], None, 0
    starts = []
    for e in edges:
        values = [e["first"][c] for c in (key, *tracked)]
        opens.append(before is None or not same(before, values))
        before = [e["last"][c] for c in (key, *tracked)]
        starts.append(start)
        start += e["n"] + opens[-1]
    # from the end: the first change point at or after each task's first row
    ahead, settled = None, []
    for e, new, begin in zip(reversed(edges), reversed(opens), reversed(starts)):
        tail = (e["tail"] or e["first"])[key]
        after = ahead[1] if ahead is not None and ahead[0] == tail else None
        # a first row ends at the task's first change point, or at one behind it
        first_end = after if e["next"] is None else e["next"][time] if e["next"][key] == e["first"][key] else None
        settled.append((e["_part"], new, begin, after, first_end, e["n"]))
        if new:
            ahead = (e["first"][key], e["first"][time])
        elif e["next"] is not None:
            ahead = (e["next"][key], e["next"][time])
    schema = found.select("_part", F.lit(True).alias("_opens"), F.lit(0).cast("long").alias("_start"),
                          F.col("next_time").alias("_after"), F.col("next_time").alias("_first_end"),
                          F.lit(0).cast("long").alias("_n")).schema
    fix = F.broadcast(spark.createDataFrame(settled, schema))  # a row a task
    first = F.col("_kind") == FIRST
    tail = (F.col("_kind") == POINT) & (F.col("_at") == F.col("_n") - 1)
    return (found.where(F.col("_kind") != LAST).join(fix, "_part").where(~first | F.col("_opens"))
            .select(*columns,
                    F.when(first, F.col("_first_end")).when(tail, F.col("_after")).otherwise(F.col("next_time"))
                    .alias("next_time"),
                    (F.col("_start") + F.when(first, 1).otherwise(F.col("_at") + 1 + F.col("_opens").cast("long")))
                    .cast("long").alias("position")))
