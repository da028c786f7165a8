"""Column helpers (X1–X27).  All are built-in expressions, so they stay inside
whole-stage codegen; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- calendar parts (X4–X13) ---------------------------------------------------

def day_of_week0(d) -> Column:
    """0 = Sunday … 6 = Saturday (Spark's dayofweek is 1 = Sunday)."""
    return (F.dayofweek(_c(d)) - 1).cast("int")


def is_weekend(d) -> Column:
    return day_of_week0(d).isin(0, 6)


def am_pm(hour) -> Column:
    return F.when(_c(hour) < 12, F.lit("AM")).otherwise(F.lit("PM"))


def day_part(hour) -> Column:
    """5–11 Morning, 12–16 Afternoon, 17–20 Evening, otherwise Night."""
    h = _c(hour)
    return (F.when(h.between(5, 11), F.lit("Morning"))
            .when(h.between(12, 16), F.lit("Afternoon"))
            .when(h.between(17, 20), F.lit("Evening"))
            .otherwise(F.lit("Night")))


def minute_of_day(ts) -> Column:
    """``TIME(ts)`` truncated to the minute, as an int key."""
    t = _c(ts)
    return (F.hour(t) * 60 + F.minute(t)).cast("int")


def clock_text(minute_col) -> Column:
    """Minute-of-day → ``HH:mm:00``."""
    m = _c(minute_col)
    return F.format_string("%02d:%02d:00", (m / 60).cast("int"), m % 60)


# --- differences (X15, X24) ---------------------------------------------------

def minute_boundaries(a, b) -> Column:
    """``DATEDIFF(MINUTE, a, b)`` as warehouses define it: the number of minute
    boundaries crossed, i.e. the difference of the minute-truncated values.
    10:00:59 → 10:01:01 is 1, not 0 (Spark's timestampdiff counts whole
    elapsed minutes)."""
    return F.timestamp_diff("MINUTE", F.date_trunc("MINUTE", _c(a)),
                            F.date_trunc("MINUTE", _c(b)))


def micros_between(a, b) -> Column:
    return F.timestamp_diff("MICROSECOND", _c(a), _c(b))


# --- text to value (X16, X17, X23) --------------------------------------------

def parse_money(s) -> Column:
    """'$12.50' → 12.5, '$1,250' → 1250.0, 'abc' → null."""
    cleaned = F.trim(F.regexp_replace(_c(s), r"[$,]", ""))
    return cleaned.try_cast("double")


def parse_clock_seconds(s) -> Column:
    """'HH:mm:ss' (or 'HH:mm') → seconds of day; bad text → null."""
    t = F.trim(_c(s))
    ok = t.rlike(r"^([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?$")
    parts = F.split(t, ":")
    secs = (F.try_element_at(parts, F.lit(1)).try_cast("int") * 3600
            + F.try_element_at(parts, F.lit(2)).try_cast("int") * 60
            + F.coalesce(F.try_element_at(parts, F.lit(3)).try_cast("double"), F.lit(0.0)).cast("int"))
    return F.when(ok, secs)


def parse_day(s) -> Column:
    """Order dates arrive as 'dd-MM-yyyy' or ISO 'yyyy-MM-dd'."""
    t = F.trim(_c(s))
    return F.coalesce(F.when(t.rlike(r"^\d{2}-\d{2}-\d{4}$"),
                             F.try_to_date(t, "dd-MM-yyyy")),
                      F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"),
                             F.try_to_date(t, "yyyy-MM-dd")))


def day_plus_seconds(day, secs) -> Column:
    """Combine a date and seconds-of-day into a timestamp_ntz."""
    base = _c(day).cast("timestamp_ntz")
    return F.timestamp_add("SECOND", _c(secs), base)


# --- measures (X25, X27) -------------------------------------------------------

def clip_abs(x, lo, hi) -> Column:
    """abs then clip to [lo, hi]; null stays null (greatest(5, null) is 5)."""
    v = _c(x)
    return F.when(v.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), F.abs(v))))


# Traffic density levels in their display order.
TRAFFIC_ORDER = ["Low", "Medium", "High", "Jam"]


def ordinal(x, levels: list[str]) -> Column:
    """Value → position in ``levels``; unknown → null."""
    v = _c(x)
    out = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(levels))):
        out = F.when(v == F.lit(name), F.lit(i)).otherwise(out)
    return out


def money_sum(x) -> Column:
    """Sum money through decimal(18,2) so the result does not depend on the
    order rows are added in; returned as double."""
    return F.sum(_c(x).cast("decimal(18,2)")).cast("double")


def money_avg(x) -> Column:
    """Mean of money values: exact decimal sum ÷ count of non-null values."""
    v = _c(x)
    return F.try_divide(F.sum(v.cast("decimal(18,2)")).cast("double"),
                        F.count(v).cast("double"))


def mean(x) -> Column:
    """Mean as sum ÷ count of non-null values (exact for integer inputs, so
    the result does not depend on how rows are partitioned)."""
    v = _c(x)
    return F.try_divide(F.sum(v).cast("double"), F.count(v).cast("double"))
