"""As-of look-up: each fact row gets the version valid at its own time.

Facts and versions are put under each other and sorted once by range of (key,
time, versions first), so that a key with a third of all facts, or one instant
with most of them, lies in as many tasks as its size asks for.  A task walks
its sorted rows and carries the last version of the key it is at; no fact
meets more than one version and no time range is expanded.  Facts at the head
of a task whose version lies in an earlier task are settled by one row a task,
the version it ends with: few rows, put in order on the driver and broadcast.
That is one exchange, however versions and facts are spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..session import materialize
from .changes import differ

# What a sorted row is: a version, a fact, or (written only) what a task ends with.
VERSION, FACT, EDGE = 0, 1, 2
_KEY, _TIME, _KIND, _SK, _END, _PART, _OPEN = (f"_asof_{n}" for n in ("key", "time", "kind", "sk", "end", "part", "open"))


def with_version_as_of(facts: DataFrame, versions: DataFrame, key: str, time: str, version_key: str, sk: str,
                       start: str = "effective_from", end: str = "effective_to", alias: str | None = None
                       ) -> DataFrame:
    """``facts`` with ``sk`` (as ``alias``) of the version of ``key`` whose
    [start, end) holds ``time``.  Written.

    A null ``start`` is before all times, a null ``end`` after all.  Of
    versions that start together the one with the larger ``sk`` counts.  Facts
    with a null key or time, before the first version or in a gap between two
    get null; each fact row comes out once, repeated rows too.
    """
    ntz = "timestamp_ntz"
    rows = facts.withColumns({
        _KEY: F.col(key), _TIME: F.col(time).cast(ntz), _KIND: F.lit(FACT), _SK: F.lit(None).cast("bigint"),
        _END: F.lit(None).cast(ntz)})
    first = versions.where(F.col(version_key).isNotNull()).select(
        F.col(version_key).cast(facts.schema[key].dataType).alias(_KEY), F.col(start).cast(ntz).alias(_TIME),
        F.lit(VERSION).alias(_KIND), F.col(sk).cast("bigint").alias(_SK), F.col(end).cast(ntz).alias(_END))
    by = [F.col(c).asc_nulls_first() for c in (_KEY, _TIME, _KIND, _SK)]
    events = rows.unionByName(first, allowMissingColumns=True).repartitionByRange(*by).sortWithinPartitions(*by)

    more = events.withColumns({_PART: F.lit(0), _OPEN: F.lit(True)})
    schema = StructType([StructField(f.name, f.dataType, True) for f in more.schema])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: pa.Table | None = None  # the row before
        version: pa.Table | None = None  # of its key, if one was met in this task
        headed = True  # still at the key that the task starts with

        def written(table: pa.Table, kind: int, sk: pa.Array, end: pa.Array, open_: np.ndarray) -> list[pa.RecordBatch]:
            n = table.num_rows
            new = {_KIND: pa.array(np.full(n, kind, np.int32)), _SK: sk, _END: end,
                   _PART: pa.array(np.full(n, part, np.int32)), _OPEN: pa.array(open_)}
            columns = [new[f.name] if f.name in new else table.column(f.name) for f in arrow]
            return pa.Table.from_arrays(columns, names=arrow.names).cast(arrow).to_batches()

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            table = pa.Table.from_batches([batch])
            both = table if last is None else pa.concat_tables([last, table])
            new = differ(both, [_KEY])
            if last is None:
                new = np.concatenate([[False], new])
            at = np.arange(n)
            run_start = np.maximum.accumulate(np.where(new, at, 0))
            is_version = table.column(_KIND).to_numpy() == VERSION
            found = np.maximum.accumulate(np.where(is_version, at, -1))
            old = ~np.logical_or.accumulate(new)  # the key of the row before goes on
            own = found >= run_start
            # row 0 of ``known`` is the version that was carried into the batch
            known = table.select([_SK, _END]).combine_chunks()
            carried = version if version is not None else known.slice(0, 1)
            known = pa.concat_tables([carried, known])
            take = np.where(own, found + 1, 0)
            missing = ~own & ~(old & (version is not None))
            open_ = missing & old & headed
            index = pa.array(take, mask=missing)
            sk_, end_ = (known.column(c).combine_chunks().take(index) for c in (_SK, _END))
            facts_ = pa.array(~is_version)
            yield from written(table.filter(facts_), FACT, sk_.filter(facts_), end_.filter(facts_), open_[~is_version])
            headed = headed and bool(old[-1])
            version = None if missing[-1] else pa.table({_SK: sk_.slice(n - 1), _END: end_.slice(n - 1)})
            last = table.slice(n - 1)
        if last is not None:
            sk_, end_ = (pa.nulls(1, arrow.field(c).type) if version is None else version.column(c).combine_chunks()
                         for c in (_SK, _END))
            # open: no version of this key here, and it is the key that the task starts with
            yield from written(last, EDGE, sk_, end_, np.array([headed and version is None]))

    found = materialize(events.mapInArrow(run, schema), "as-of")
    edges = found.where(F.col(_KIND) == EDGE).select(_PART, _KEY, _SK, _END, _OPEN).collect()  # a row a task
    settled, before = [], None
    for e in sorted(edges, key=lambda r: r[_PART]):
        if before is not None:
            settled.append((e[_PART], *before))
        if e[_SK] is not None:
            before = (e[_KEY], e[_SK], e[_END])
        elif not e[_OPEN] or before is not None and before[0] != e[_KEY]:
            before = None
    fix = F.broadcast(facts.sparkSession.createDataFrame(settled, found.select(
        F.col(_PART).alias("_p"), F.col(_KEY).alias("_k"), F.col(_SK).alias("_s"), F.col(_END).alias("_e")).schema))
    joined = found.where(F.col(_KIND) == FACT).join(
        fix, F.col(_OPEN) & (F.col(_PART) == F.col("_p")) & (F.col(_KEY) == F.col("_k")), "left")
    until, chosen = F.coalesce(_END, F.when(F.col(_SK).isNull(), F.col("_e"))), F.coalesce(_SK, "_s")
    valid = F.col(_TIME).isNotNull() & (until.isNull() | (F.col(_TIME) < until))
    return joined.select(*facts.columns, F.when(valid, chosen).alias(alias or sk))
