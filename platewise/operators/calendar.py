"""Calendar dimensions (D-DATE, D-TIME, SK3).

Both are generated with ``spark.range`` — the row id *is* the sort order, so
``date_sk``/``time_sk`` equal ``ROW_NUMBER() OVER (ORDER BY …)`` without an
un-partitioned window.  Their size depends only on the calendar span (≤ 366
rows a year) or is fixed (1,440 minutes), never on the data volume, which is
what makes them safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as X

# Default calendar — five years (1,825 days) from 2020-01-01.
DEFAULT_START = "2020-01-01"
DEFAULT_DAYS = 1825
MINUTES_PER_DAY = 1440


def _date_columns(date_id, sk) -> list:
    d = F.col(date_id) if isinstance(date_id, str) else date_id
    return [
        sk.cast("bigint").alias("date_sk"),
        d.alias("date_id"),
        X.day_of_week0(d).alias("day_of_week"),
        F.date_format(d, "EEE").alias("day_of_week_name"),
        F.dayofmonth(d).alias("day_of_month"),
        F.dayofyear(d).alias("day_of_year"),
        F.weekofyear(d).alias("week_of_year"),
        F.month(d).alias("month_number"),
        F.date_format(d, "MMM").alias("month_name"),
        F.quarter(d).alias("quarter"),
        F.year(d).alias("year"),
        X.is_weekend(d).alias("is_weekend"),
        F.lit(False).alias("is_holiday"),
        F.lit(None).cast("string").alias("holiday_name"),
        F.year(d).alias("fiscal_year"),
        F.quarter(d).alias("fiscal_quarter"),
    ]


def dim_date(spark: SparkSession, start: str = DEFAULT_START,
             n_days: int = DEFAULT_DAYS, holidays: DataFrame | None = None) -> DataFrame:
    """Date dimension: ``n_days`` consecutive days from ``start``.

    ``holidays`` (optional: ``holiday_date date, holiday_name string``) fills
    the holiday columns through a broadcast left join.
    """
    days = spark.range(n_days).select(
        F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("d"),
        (F.col("id") + 1).alias("sk"))
    out = days.select(*_date_columns("d", F.col("sk")))
    return _with_holidays(out, holidays)


# Bounds of the calendar: days outside get no date key, so one stray date
# cannot blow the calendar up (it is broadcast in every date lookup).
CALENDAR_START, CALENDAR_END = "1900-01-01", "2099-12-31"


def dim_date_covering(dates: DataFrame, holidays: DataFrame | None = None,
                      start: str | None = None, origin: str | None = None) -> DataFrame:
    """Date dimension spanning whole calendar years around every date in the
    single date column of ``dates`` (those in 1900-2099) — computed lazily from a global
    min/max (one partial aggregate per task), so the calendar follows the data.

    ``start`` pins the first day, which gets key 1.  ``origin`` pins the day
    of key 1 only (and so every ``date_sk``) to an existing calendar: a later
    load extends it without renumbering, earlier days get keys from 0 downwards."""
    c = F.col(dates.columns[0])
    inside = dates.where(c.between(F.lit(CALENDAR_START).cast("date"), F.lit(CALENDAR_END).cast("date")))
    bounds = inside.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
    begin = F.trunc(F.col("lo"), "year") if start is None else F.lit(start).cast("date")
    end = F.date_add(F.add_months(F.trunc(F.col("hi"), "year"), 12), -1)
    days = (bounds.where(F.col("lo").isNotNull())
            .select(begin.alias("start"),
                    F.explode(F.sequence(begin, end)).alias("d")))
    first = F.col("start") if origin is None else F.lit(origin).cast("date")
    sk = F.datediff(F.col("d"), first) + 1
    out = days.select(*_date_columns("d", sk))
    return _with_holidays(out, holidays)


def _with_holidays(dim: DataFrame, holidays: DataFrame | None) -> DataFrame:
    if holidays is None:
        return dim
    h = holidays.select(F.col("holiday_date").alias("date_id"),
                        F.col("holiday_name").alias("_hname"))
    return (dim.join(h, "date_id", "left")
            .withColumn("is_holiday", F.col("_hname").isNotNull())
            .withColumn("holiday_name", F.col("_hname"))
            .drop("_hname")
            .select(*dim.columns))


def dim_time(spark: SparkSession) -> DataFrame:
    """Time dimension at minute grain: 1,440 rows, key = minute of day + 1."""
    m = F.col("id").cast("int")
    hour = (m / 60).cast("int")
    return spark.range(MINUTES_PER_DAY).select(
        (F.col("id") + 1).alias("time_sk"),
        X.clock_text(m).alias("time_id"),
        m.alias("minute_of_day"),
        hour.alias("hour_of_day"),
        (m % 60).alias("minute_of_hour"),
        F.lit(0).alias("second_of_minute"),
        X.am_pm(hour).alias("am_pm"),
        X.day_part(hour).alias("time_of_day_category"),
    )
