"""Reusable column expressions (all built-in, JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c) -> Column:
    return col_(c).cast("double")


def safe_div(num, den) -> Column:
    """``num / NULLIF(den, 0)`` in double precision (NULL instead of an error)."""
    return dbl(num) / F.nullif(dbl(den), F.lit(0.0))


def safe_ratio(num, den, scale: float = 100.0, digits: int = 2) -> Column:
    """``ROUND(num / NULLIF(den, 0) * scale, digits)``."""
    return F.round(safe_div(num, den) * F.lit(float(scale)), digits)


def rnd(c, digits: int = 2) -> Column:
    return F.round(dbl(c), digits)


def clamp(c, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col_(c), F.lit(lo)), F.lit(hi))


def count_if(pred: Column) -> Column:
    """``COUNT(CASE WHEN pred THEN 1 END)``."""
    return F.count(F.when(pred, F.lit(1)))


def sum_if(pred: Column, value) -> Column:
    return F.sum(F.when(pred, col_(value)).otherwise(F.lit(0)))


def as_date(c) -> Column:
    return F.to_date(col_(c))


def month_start(c) -> Column:
    """First day of the month as DATE."""
    return F.trunc(F.to_date(col_(c)), "MM")


def week_start(c) -> Column:
    """Monday of the ISO week as DATE."""
    return F.date_trunc("week", col_(c).cast("timestamp")).cast("date")


def iso_yearweek(c) -> Column:
    """ISO year * 100 + ISO week (Monday weeks)."""
    d = F.to_date(col_(c))
    return F.extract(F.lit("YEAROFWEEK"), d) * 100 + F.weekofyear(d)


def dow_sunday0(c) -> Column:
    """Day of week with Sunday = 0 .. Saturday = 6."""
    return F.dayofweek(F.to_date(col_(c))) - 1


def add_days_ts(ts, days) -> Column:
    return F.timestamp_add("DAY", col_(days) if not isinstance(days, int) else F.lit(days), col_(ts))


def add_seconds_ts(ts, secs) -> Column:
    return F.timestamp_add("SECOND", col_(secs) if not isinstance(secs, int) else F.lit(secs), col_(ts))


def url_domain(url) -> Column:
    """Host part of an URL: text between ``://`` and the next ``/``."""
    return F.split_part(F.split_part(col_(url), F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))


# Session duration buckets (upper bounds in seconds, label).
DURATION_BUCKETS = [
    (60, "under_1_min"),
    (300, "1_to_5_mins"),
    (900, "5_to_15_mins"),
    (1800, "15_to_30_mins"),
]
DURATION_BUCKET_OVER = "over_30_mins"
DURATION_BUCKET_UNKNOWN = "unknown"


def duration_bucket(sec) -> Column:
    s = col_(sec)
    out = F.when(s.isNull(), F.lit(DURATION_BUCKET_UNKNOWN))
    for bound, label in DURATION_BUCKETS:
        out = out.when(s < bound, F.lit(label))
    return out.otherwise(F.lit(DURATION_BUCKET_OVER))


def kv_extract(text, key: str) -> Column:
    """Value of ``key=value`` inside ``k=v|k=v`` text, NULL when absent."""
    return F.nullif(F.regexp_extract(col_(text), key + r"=([^|\s]+)", 1), F.lit(""))


def initials(name, max_words: int = 3) -> Column:
    """Upper-case first letters of the first ``max_words`` words."""
    words = F.filter(F.split(F.trim(col_(name)), r"\s+"), lambda w: F.length(w) > 0)
    return F.array_join(F.transform(F.slice(words, 1, max_words), lambda w: F.upper(F.substring(w, 1, 1))), "")


def pct_change(cur, prev, digits: int = 2) -> Column:
    """Period-over-period growth in percent, NULL when the prior value is 0/NULL."""
    return F.round((dbl(cur) - dbl(prev)) / F.nullif(dbl(prev), F.lit(0.0)) * 100.0, digits)


def cents_to_usd(c) -> Column:
    return F.round(col_(c).cast("double") / 100.0, 2)


def exact_sum(c, digits: int) -> Column:
    """Order-independent sum of values carrying ``digits`` decimals.

    Floating-point sums depend on the order rows arrive in (which differs per
    run and per engine); summing scaled integers and dividing once does not.
    """
    scale = 10 ** digits
    return F.sum(F.round(dbl(c) * scale).cast("long")) / float(scale)


def exact_avg(c, digits: int) -> Column:
    """Order-independent mean of values carrying ``digits`` decimals."""
    return exact_sum(c, digits) / F.nullif(F.count(col_(c)), F.lit(0))


def ts_on_or_after(ts, as_of: str, days_back: int) -> Column:
    """``to_date(ts) >= as_of - days_back`` written on the raw timestamp, so the
    bound reaches the Parquet scan as a pushed filter (row-group skipping)."""
    import datetime as _dt
    d = _dt.date.fromisoformat(as_of) - _dt.timedelta(days=days_back)
    return col_(ts) >= F.lit(f"{d.isoformat()} 00:00:00").cast("timestamp_ntz")
