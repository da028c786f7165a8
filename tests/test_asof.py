"""As-of look-up against the definition, over many partitions."""

import datetime as dt
import random

import pytest

from platewise.operators.asof import with_version_as_of

FACTS = "id int, k string, t timestamp_ntz, note string"
VERSIONS = "sk bigint, vk string, effective_from timestamp_ntz, effective_to timestamp_ntz"
DAY = dt.timedelta(days=1)
T0 = dt.datetime(2024, 1, 1)


def plain(facts, versions):
    out = []
    for f in facts:
        started = [v for v in versions if v[1] is not None and v[1] == f[1] and f[2] is not None
                   and (v[2] is None or v[2] <= f[2])]
        best = max(started, key=lambda v: (v[2] is not None, v[2] or T0, v[0]), default=None)
        held = best is not None and (best[3] is None or f[2] < best[3])
        out.append((*f, best[0] if held else None))
    return sorted(out, key=repr)


def data(seed, n_facts, n_versions):
    rng = random.Random(seed)
    names = ["hot"] * 8 + ["a", "b", "c", "never", *map(str, range(12))]
    facts = []
    for i in range(n_facts):
        k = rng.choice(names + [None])
        # most facts of the hot key share one instant
        t = T0 + 40 * DAY if k == "hot" and rng.random() < 0.7 else T0 + rng.randint(0, 60) * DAY
        facts.append((i // 2 if rng.random() < 0.1 else i, k, None if rng.random() < 0.05 else t, "x"))
    versions = []
    for s in range(n_versions):
        k = rng.choice([x for x in names if x != "never"] + [None])
        start = None if rng.random() < 0.05 else T0 + rng.randint(0, 60) * DAY
        end = None if rng.random() < 0.5 else (start or T0) + rng.randint(0, 30) * DAY
        versions.append((s + 1, k, start, end))
    return facts, versions


@pytest.mark.parametrize("seed,facts,versions,parts", [
    (1, 1500, 60, 17), (2, 300, 5, 41), (3, 40, 40, 29), (4, 0, 9, 3), (5, 30, 0, 7), (6, 200, 30, 1)])
def test_facts_get_the_version_of_their_time(spark, seed, facts, versions, parts):
    f, v = data(seed, facts, versions)
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled",
             "spark.sql.execution.arrow.maxRecordsPerBatch"]
    kept = {k: spark.conf.get(k) for k in names}
    for k, value in zip(names, [str(parts), "false", "7"]):
        spark.conf.set(k, value)
    try:
        got = with_version_as_of(spark.createDataFrame(f, FACTS), spark.createDataFrame(v, VERSIONS), "k", "t", "vk", "sk")
        assert got.columns == ["id", "k", "t", "note", "sk"]
        assert sorted(map(tuple, got.collect()), key=repr) == plain(f, v)
    finally:
        for k, value in kept.items():
            spark.conf.set(k, value)


def test_one_version_reaches_tasks_that_hold_none(spark):
    f = [(i, "k", T0 + DAY, "x") for i in range(400)] + [(400, "l", T0 + DAY, "x")]
    f += [(500 + i, "k", T0 + 2 * DAY + i * dt.timedelta(seconds=1), "y") for i in range(400)]
    v = [(7, "k", T0, None)]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = with_version_as_of(spark.createDataFrame(f, FACTS), spark.createDataFrame(v, VERSIONS), "k", "t", "vk",
                                 "sk", alias="found").collect()
    finally:
        for k, value in kept.items():
            spark.conf.set(k, value)
    assert len(out) == 801 and all(r.found == (7 if r.k == "k" else None) for r in out)
