"""Reusable DataFrame shapes from which the data products are composed.

Each shape is written so that it stays distributed and skew-tolerant:

* per-key picks (latest / first row) use ``max_by`` / ``min_by`` aggregates,
  which Spark evaluates with map-side partial aggregation, so even a key that
  holds a third of all rows is reduced to one row per map task before the
  shuffle;
* spines are generated per row with ``explode(sequence(...))`` (work
  proportional to output, no cross join + range filter);
* dense spines over sparse facts fill the gaps after the last exchange: facts
  travel, filled rows never do;
* trailing distinct counts add one event where an entity begins to count and one
  where it stops, and sum the events over the calendar;
* interval (as-of) and overlap joins are equi-joins on (entity, calendar month)
  with the range as a residual predicate, so a hot entity is split by month and
  only rows meeting in the same month become candidates;
* per-key windows over unbounded histories are two-level: inside time buckets,
  then over one summary row per bucket (calendar-bounded);
* exact percentiles are read off a (group, value) histogram instead of
  gathering every value of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Order = Sequence[tuple[str, str]]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _window_order(order: Order):
    return [(F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last()) for c, d in order]


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """Keep the first row per ``keys`` under ``order`` (list of (column, 'asc'|'desc')).

    NULLs sort last in either direction.  The order must end in a unique
    tie-breaker.  The pick is an aggregate (``max_by``/``min_by`` over a
    struct), which is skew-safe thanks to partial aggregation; where directions
    differ, numbers and times are turned round.  Only texts ordered in both
    directions fall back to ``row_number() = 1`` (planned with a
    WindowGroupLimit, i.e. a partial top-1 before the shuffle).
    """
    cols = df.columns
    fixed = {d for c, d in order if not isinstance(df.schema[c].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))}
    if len(fixed) <= 1:
        desc = (fixed or {d for _, d in order[:1]}) == {"desc"}
        parts = []
        for c, d in order:
            parts += [F.col(c).isNotNull() if desc else F.col(c).isNull(), F.col(c) if (d == "desc") == desc else _reversed(c, df.schema[c].dataType)]
        ord_struct = F.struct(*parts)
        row = F.struct(*[F.col(c) for c in cols])
        pick = F.max_by(row, ord_struct) if desc else F.min_by(row, ord_struct)
        return df.groupBy(*keys).agg(pick.alias("_r")).select(*[F.col(f"_r.{c}").alias(c) for c in cols])
    w = Window.partitionBy(*keys).orderBy(*_window_order(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def _reversed(c: str, dtype: T.DataType) -> Column:
    """A number whose order is the opposite of the column's."""
    if isinstance(dtype, T.DateType):
        return -F.unix_date(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return -F.unix_micros(F.col(c).cast("timestamp"))
    if isinstance(dtype, T.IntegralType):
        return F.bitwise_not(F.col(c))  # unlike the negative, defined for the smallest one
    return -F.col(c)


def rank_within(df: DataFrame, keys: Sequence[str], order: Order, name: str = "rn") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*_window_order(order))
    return df.withColumn(name, F.row_number().over(w))


def explode_months(df: DataFrame, start, end, cap=None, name: str = "bucket_month") -> DataFrame:
    """One row per calendar month touched by ``[start, end]`` (end capped at ``cap``).

    Intervals whose end month precedes their start month produce no rows.
    Used to turn interval joins into equi-joins on (key, month): a hot key is
    split by month and only pairs sharing a month become join candidates.
    """
    s = F.trunc(F.to_date(_c(start)), "MM")
    e = F.trunc(F.to_date(_c(end)), "MM")
    if cap is not None:
        e = F.least(e, F.trunc(F.to_date(_c(cap)), "MM"))
    return (df.filter(s <= e)
            .withColumn(name, F.explode(F.sequence(s, e, F.expr("INTERVAL 1 MONTH")))))


def date_spine(bounds: DataFrame, start, end, name: str = "date_day") -> DataFrame:
    """Day series between two date expressions evaluated on a one-row frame."""
    return bounds.select(F.explode(F.sequence(_c(start), _c(end), F.expr("INTERVAL 1 DAY"))).alias(name))


def month_series(bounds: DataFrame, start, end, name: str = "month_start") -> DataFrame:
    return bounds.select(F.explode(F.sequence(F.trunc(_c(start), "MM"), F.trunc(_c(end), "MM"),
                                              F.expr("INTERVAL 1 MONTH"))).alias(name))


def entity_day_spine(entities: DataFrame, key: str, start, end, name: str = "date_day") -> DataFrame:
    """``entity x day`` from each entity's start date to ``end`` (per-row explode).

    Rows whose start is after ``end`` produce no days.  Output-sized work; the
    explode runs where the entity row lives (no shuffle).
    """
    s, e = F.to_date(_c(start)), F.to_date(_c(end))
    return (entities.filter(s <= e)
            .select(F.col(key), F.explode(F.sequence(s, e, F.expr("INTERVAL 1 DAY"))).alias(name)))


def bucketed_lead(df: DataFrame, keys: Sequence[str], order: str, tie: str, bucket, name: str) -> DataFrame:
    """``lead(order) over (partition by keys order by order, tie)`` computed in two levels.

    Level 1 runs the window inside (keys, bucket) partitions, so a hot key is
    split across its time buckets; level 2 bridges bucket boundaries with a
    window over one summary row per (key, bucket) -- at most one row per
    bucket, i.e. bounded by the calendar, not by the data volume.
    """
    b = "__bucket"
    d = df.withColumn(b, bucket)
    w1 = Window.partitionBy(*keys, b).orderBy(F.col(order).asc_nulls_last(), F.col(tie).asc_nulls_last())
    d = d.withColumn("__next_in", F.lead(order).over(w1))
    firsts = d.groupBy(*keys, b).agg(F.min(order).alias("__first"))
    w2 = Window.partitionBy(*keys).orderBy(F.col(b))
    firsts = firsts.withColumn("__next_bucket_first", F.lead("__first").over(w2)).drop("__first")
    d = d.join(firsts, [*keys, b], "left")
    return d.withColumn(name, F.coalesce("__next_in", "__next_bucket_first")) \
        .drop(b, "__next_in", "__next_bucket_first")


def close_intervals(df: DataFrame, keys: Sequence[str], start: str, raw_end: str, order: Order,
                    gap: str = "INTERVAL 1 SECOND", name: str = "effective_end") -> DataFrame:
    """Effective end = least(raw end, next start - gap) within ``keys``.

    ``raw_end`` NULL means open-ended; the last interval keeps its raw end.
    ``order`` is (start, tie-breaker); the next start is found with a
    month-bucketed two-level ``lead`` so one key with a huge history is not
    sorted inside a single task.
    """
    tie = order[-1][0]
    d = bucketed_lead(df, keys, start, tie, F.trunc(F.to_date(F.col(start)), "MM"), "__next_start")
    nxt = F.col("__next_start") - F.expr(gap)
    return d.withColumn(name, F.when(nxt.isNull(), F.col(raw_end))
                        .when(F.col(raw_end).isNull(), nxt)
                        .otherwise(F.least(F.col(raw_end), nxt))).drop("__next_start")


def period_growth(df: DataFrame, keys: Sequence[str], period: str, value: str, name: str) -> DataFrame:
    """Period-over-period % growth via ``lag`` (NULL when the prior is 0/NULL)."""
    w = Window.partitionBy(*keys).orderBy(F.col(period))
    prev = F.lag(F.col(value)).over(w)
    return df.withColumn(name, F.round((F.col(value).cast("double") - prev.cast("double"))
                                       / F.nullif(prev.cast("double"), F.lit(0.0)) * 100.0, 2))


def union_calendar(*frames_and_cols) -> DataFrame:
    """Distinct union of date columns of several frames: ``(df, col), ...``."""
    parts = [df.select(F.to_date(_c(c)).alias("d")) for df, c in frames_and_cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("d").isNotNull()).distinct()


def percentile_cont(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles (``PERCENTILE_CONT``) per group, rounded to 2.

    Instead of gathering every value of a group into one task, values are first
    reduced to a (group, value) -> count histogram with partial aggregation
    (skew-safe), then a cumulative count over the *distinct* values of each
    group locates the two ranks around ``p * (n - 1)`` and interpolates.
    """
    v = F.col(value).cast("double")
    h = (df.select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull())
         .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")))
    w_run = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w_all = Window.partitionBy(*keys)
    h = h.withColumn("_cum", F.sum("_n").over(w_run)).withColumn("_tot", F.sum("_n").over(w_all))
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_tot") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [F.min(F.when(F.col("_cum") > lo, F.col("_v"))).alias(f"_{name}_lo"),
                 F.min(F.when(F.col("_cum") > hi, F.col("_v"))).alias(f"_{name}_hi"),
                 F.max(pos - lo).alias(f"_{name}_fr")]
    out = h.groupBy(*keys).agg(*aggs)
    sel = [F.col(k) for k in keys]
    for name in probs:
        lo_v, hi_v, fr = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), F.col(f"_{name}_fr")
        sel.append(F.round(lo_v + fr * (hi_v - lo_v), 2).alias(name))
    return out.select(*sel)


def percentile_select(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], ranges: int = 256) -> DataFrame:
    """``percentile_cont`` for values of any cardinality, by distributed selection.

    A sketch per group (merged map-side) yields at most ``ranges`` splitters;
    exact counts of the ranges between them say in which range every wanted rank
    lies, and only that range is looked into.  Neither a hot group nor its
    distinct values meet in one task: the widest window sees a group's ranges,
    then the distinct values of a single range, a ``ranges``-th of the group's
    apart from the sketch's error, which moves work but never the result.
    """
    # NULL keys are groups of their own; they take part in joins as a struct.
    rows = df.select(F.struct(*keys).alias("__g"), F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    histogram = rows.groupBy("__g", "__v").agg(F.count(F.lit(1)).alias("__n"))
    at = [i / ranges for i in range(1, ranges)]
    # The sketch weighs values by their rows, so a frequent value cannot crowd a range.
    splitters = rows.groupBy("__g").agg(F.percentile_approx("__v", at, 20 * ranges).alias("__s"))
    ranged = histogram.join(splitters, histogram["__g"].eqNullSafe(splitters["__g"])).select(
        histogram["__g"], "__v", "__n", F.size(F.filter("__s", lambda s: s <= F.col("__v"))).alias("__r"))
    counts = ranged.groupBy("__g", "__r").agg(F.sum("__n").alias("__c"))
    w_run = Window.partitionBy("__g").orderBy("__r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("__before", F.sum("__c").over(w_run) - F.col("__c")).withColumn("__tot", F.sum("__c").over(Window.partitionBy("__g")))
    asked = [F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("__tot") - 1)).alias("pos")) for name, p in probs.items()]
    ranks = counts.select("__g", "__r", "__c", "__before", F.explode(F.array(*asked)).alias("a")).select(
        "__g", "__r", "__before", "a.name", "a.pos", F.explode(F.array(F.floor("a.pos"), F.ceil("a.pos"))).alias("rank"), F.col("__c"))
    ranks = ranks.filter((F.col("rank") >= F.col("__before")) & (F.col("rank") < F.col("__before") + F.col("__c"))).select(
        F.col("__g").alias("__h"), F.col("__r").alias("__q"), "__before", "name", "pos", "rank").distinct()
    needed = ranks.select("__h", "__q").distinct()
    inside = ranged.join(needed, ranged["__g"].eqNullSafe(needed["__h"]) & (ranged["__r"] == needed["__q"]), "left_semi")
    cum = F.sum("__n").over(Window.partitionBy("__g", "__r").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = inside.withColumn("__cum", cum)
    found = inside.join(ranks, inside["__g"].eqNullSafe(ranks["__h"]) & (inside["__r"] == ranks["__q"])
                        & (F.col("__before") + F.col("__cum") > F.col("rank")) & (F.col("__before") + F.col("__cum") - F.col("__n") <= F.col("rank")))
    lo, hi = F.min("__v"), F.max("__v")  # the values at both ranks around the position
    wide = found.groupBy("__g", "name").agg((lo + (F.max("pos") - F.floor(F.max("pos"))) * (hi - lo)).alias("x"))
    out = wide.groupBy("__g").agg(*[F.round(F.max(F.when(F.col("name") == n, F.col("x"))), 2).alias(n) for n in probs])
    return out.select(*[F.col(f"__g.{k}").alias(k) for k in keys], *probs)


def gap_filled(sparse: DataFrame, key: str, period: str, until, unit: str = "DAY", start: str = "__start",
               own: Sequence[str] = (), carried: Sequence[str] = (), same: Sequence[str] = (), before: Sequence[str] = ()) -> DataFrame:
    """One row per ``key`` and ``period`` from the key's start to ``until``, from one row per period with facts.

    ``sparse`` has one row per (key, period); ``start`` is set on the key's row
    at its first period (a key without one has no spine) and NULL elsewhere.
    ``own`` columns belong to their period and are NULL in the periods filled in
    after it; ``carried`` columns are changes whose running sum holds until the
    next row; ``same`` columns are copied.  The result also has ``__prior``, the
    carried sums before the period as a struct, and ``__before``, the values of
    the ``own`` columns named in ``before`` in the period before (NULL if that is
    filled or not on the spine).

    Only the sparse rows cross the network: a window per key finds the next row
    and the sums, and the periods in between are generated behind it.  A key's
    rows are bounded by the calendar.
    """
    rows = gap_rows(sparse, key, period, until, unit, start, own, carried, same, before)
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in rows.schema}
    told = {**{c: F.col(c) for c in [*own, *same]}, **{c: F.col(f"__upto_{c}") for c in carried}}
    empty, after = {c: nothing[c] for c in own}, {}
    if carried:
        told["__prior"], empty["__prior"] = (F.struct(*[F.col(f"__{when}_{c}").alias(c) for c in carried]) for when in ("ahead", "upto"))
    if before:
        told["__before"], empty["__before"], after["__before"] = F.col("__lag"), nothing["__lag"], F.struct(*before)
    return gap_spread(rows, key, period, unit, told, empty, after)


def gap_rows(sparse: DataFrame, key: str, period: str, until, unit: str = "DAY", start: str = "__start",
             own: Sequence[str] = (), carried: Sequence[str] = (), same: Sequence[str] = (), before: Sequence[str] = (),
             figures: dict[str, Column] | None = None) -> DataFrame:
    """The rows of ``sparse`` on their key's spine, with what ``gap_filled`` knows at each.

    Beside ``own`` and ``same``: ``__upto_<c>`` and ``__ahead_<c>``, the carried
    sums with and without the row; ``__lag``, the ``before`` columns of the period
    before (NULL if it has no row on the spine); ``__n``, how many periods follow without a row.
    ``figures`` are added, made from ``own``, ``same`` and the sums between the
    two windows, as one generated method for all would be too long to be compiled by the JVM.
    """
    w = Window.partitionBy(key).orderBy(period)
    upto, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    rows = sparse.select(
        key, period, start, *own, *same,
        *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"__upto_{c}") for c in carried],
        *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"__ahead_{c}") for c in carried],
        *([F.lag(F.struct(period, *before)).over(w).alias("__lag")] if before else []),
        F.lead(period).over(w).alias("__next"))
    rows = rows.select("*", *[c.alias(n) for n, c in (figures or {}).items()]).withColumn("__first", F.max(start).over(Window.partitionBy(key)))
    here = F.col(period)
    last = F.least(_moved(F.col("__next"), -1, unit), _c(until))
    apart = F.datediff(last, here) if unit == "DAY" else F.floor(F.months_between(last, here)).cast("int")
    lag = []
    if before:
        known = (here > F.col("__first")) & (_moved(F.col(f"__lag.{period}"), 1, unit) == here)
        lag = [F.when(known, F.struct(*[F.col(f"__lag.{c}").alias(c) for c in before])).alias("__lag")]
    sums = [f"__{when}_{c}" for when in ("upto", "ahead") for c in carried]
    return rows.filter((here >= F.col("__first")) & (here <= last)).select(key, period, *own, *same, *sums, *lag, *(figures or {}), apart.alias("__n"))


def gap_spread(rows: DataFrame, key: str, period: str, unit: str, told: dict[str, Column], empty: dict[str, Column],
               after: dict[str, Column] | None = None) -> DataFrame:
    """Every period of ``gap_rows``: ``told`` columns where there is a row, ``empty`` ones in the periods
    filled in after it (those not named are copied), ``after`` ones in the first of them.

    All are computed once a row, before the periods are generated: what is done
    for a generated row is to pick a value.
    """
    kinds = {"t": told, "e": empty, "a": after or {}}
    each = rows.select(key, period, "__n", *[c.alias(f"__{k}_{n}") for k, cols in kinds.items() for n, c in cols.items()])
    past = F.col("__past")

    def picked(n: str) -> Column:
        if n not in empty:
            return F.col(f"__t_{n}")
        value = F.when(past == 0, F.col(f"__t_{n}"))
        return (value.when(past == 1, F.col(f"__a_{n}")) if n in kinds["a"] else value).otherwise(F.col(f"__e_{n}"))

    each = each.withColumn("__past", F.explode(F.sequence(F.lit(0), F.col("__n"))))
    return each.select(key, _moved(F.col(period), past, unit).alias(period), *[picked(n).alias(n) for n in told])


def _moved(day: Column, n, unit: str) -> Column:
    return {"DAY": F.date_add, "MONTH": F.add_months}[unit](day, n)


def dated_measures(df: DataFrame, measures: Sequence[tuple[str, dict[str, Column]]], grain: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per date and row of ``df``: (``keys``, ``name``, measures), the date cut to ``grain`` ("MM", "DD").

    ``measures`` lists ``(date column, {measure: amount})``.  ``df`` is planned
    and read once however many of its dates are asked about; rows are not yet
    summed, so results of several frames can be united and aggregated together.
    A date that is NULL gives no row; amounts a date does not have are NULL.
    """
    amounts = list(dict.fromkeys(n for _, parts in measures for n in parts))
    rows = [F.struct(F.trunc(F.to_date(F.col(date)), grain).alias(name) if grain != "DD" else F.to_date(F.col(date)).alias(name),
                     *[(parts[n] if n in parts else F.lit(None)).cast("long").alias(n) for n in amounts]) for date, parts in measures]
    return df.select(*keys, F.explode(F.array(*rows)).alias("__r")).select(*keys, "__r.*").filter(F.col(name).isNotNull())


def referenced(dimension: DataFrame, key: str, *uses: tuple[DataFrame, str]) -> DataFrame:
    """The rows of ``dimension`` that a use refers to, one per key.

    The distinct references are found by map-side aggregation, so a handful of
    hot keys in large facts leaves a handful of rows, small enough at run time
    to be joined without shuffling the facts by those keys.
    """
    asked = [f.select(F.col(c).alias(key)) for f, c in uses]
    keys = asked[0]
    for a in asked[1:]:
        keys = keys.unionByName(a)
    return dimension.join(keys.distinct(), key, "left_semi")


def bucketed_asof(facts: DataFrame, intervals: DataFrame, key: str, ts: str, start: str, end: str,
                  keep: Sequence[str]) -> DataFrame:
    """Match each fact to the interval of the same ``key`` containing ``ts``.

    ``intervals`` must be disjoint per key (e.g. closed by ``close_intervals``),
    so at most one interval matches.  Intervals are exploded to the calendar
    months they touch, open ends up to the latest fact (a scalar subquery, so
    no fact is out of reach), and joined on (key, month) with the range as a
    residual: a key with a huge history is split by month, and a fact
    only meets the intervals of its own month.  ``keep`` are interval columns
    carried to the output (NULL when nothing matches).
    """
    cap = facts.agg(F.max(F.col(ts))).scalar()
    iv = explode_months(intervals, start, end, cap, "__m").select(
        F.col(key).alias("__k"), "__m", F.col(start).alias("__s"), F.col(end).alias("__e"), *keep)
    f = facts.withColumn("__fm", F.trunc(F.to_date(F.col(ts)), "MM"))
    j = f.join(iv, (f[key] == iv["__k"]) & (f["__fm"] == iv["__m"]) & (f[ts] >= iv["__s"]) & (f[ts] <= iv["__e"]),
               "left")
    return j.drop("__k", "__m", "__s", "__e", "__fm")


def bucketed_overlap(left: DataFrame, right: DataFrame, key: str, l_start: str, l_end: str, r_start: str, r_end: str,
                     keep: Sequence[str]) -> DataFrame:
    """Pairs (left row, right interval) of the same ``key`` whose ranges overlap
    (``r_start <= l_end and r_end >= l_start``), each pair exactly once.

    Both sides are exploded to calendar months; a pair is joined only on the
    first month they share, ``greatest(month(l_start), month(r_start))``, so
    candidate pairs are limited to ranges meeting in the same month.  Open
    ends on the right are exploded up to the latest left end.  Inner join:
    left rows without an overlapping interval are not returned.
    """
    lm = explode_months(left, l_start, l_end, None, "__lm")
    cap = left.agg(F.max(F.col(l_end))).scalar()
    rm = explode_months(right, r_start, r_end, cap, "__rm").select(
        F.col(key).alias("__k"), "__rm", F.col(r_start).alias("__rs"), F.col(r_end).alias("__re"), *keep)
    first = F.greatest(F.trunc(F.to_date(F.col(l_start)), "MM"), F.trunc(F.to_date(F.col("__rs")), "MM"))
    j = lm.join(rm, (lm[key] == rm["__k"]) & (lm["__lm"] == rm["__rm"]) & (lm["__lm"] == first)
                & (rm["__rs"] <= lm[l_end]) & (rm["__re"] >= lm[l_start]), "inner")
    return j.withColumnRenamed("__rs", f"{r_start}").withColumnRenamed("__re", f"{r_end}") \
        .drop("__k", "__rm", "__lm")


def trailing_distinct_multi(activity: DataFrame, entity: str, day: str, windows: dict[str, int],
                            calendar: DataFrame | None = None) -> DataFrame:
    """Several trailing distinct counts from one start and one end event per active day.

    An entity active on a day counts from that day until the window runs out or
    its next active day takes over, so each (entity, day) pair adds one at the
    day and takes one away at ``least(day + n, next day)``.  The events are
    summed per day and window, and a running sum over days (bounded by the
    calendar, not by the data) gives the exact counts: two rows per pair and
    window instead of ``n``.  Days without events keep the count before them;
    only days of ``calendar`` (default: all from the first active day on) that have an active
    entity are returned.
    """
    pairs = activity.select(F.col(entity), F.col(day)).filter(F.col(entity).isNotNull() & F.col(day).isNotNull()).distinct()
    pairs_next = pairs.withColumn("__next", F.lead(day).over(Window.partitionBy(entity).orderBy(day)))
    steps = [x for n in windows.values() for x in (
        F.struct(F.col(day).alias("d"), F.lit(n).alias("n"), F.lit(1).alias("v")),
        F.struct(F.least(F.date_add(day, n), F.col("__next")).alias("d"), F.lit(n).alias("n"), F.lit(-1).alias("v")))]
    events = pairs_next.withColumn("__e", F.explode(F.array(*steps))).groupBy(F.col("__e.d").alias(day)).agg(
        *[F.sum(F.when(F.col("__e.n") == n, F.col("__e.v")).otherwise(0)).alias(name) for name, n in windows.items()])
    if calendar is None:
        ends = pairs.agg(F.min(day).alias("a"), F.date_add(F.max(day), max(windows.values())).alias("z"))
        calendar = date_spine(ends, "a", "z", day)
    days = calendar.select(day).distinct()
    seen = events.withColumn("__asked", F.lit(0)).unionByName(
        days.select(day, *[F.lit(0).cast("long").alias(name) for name in windows], F.lit(1).alias("__asked")))
    run = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    daily = seen.groupBy(day).agg(*[F.sum(name).alias(name) for name in windows], F.max("__asked").alias("__asked"))
    summed = daily.select(day, "__asked", *[F.sum(name).over(run).alias(name) for name in windows])
    some = F.greatest(*[F.col(name) for name in windows], F.lit(0)) > 0
    return summed.filter((F.col("__asked") == 1) & some).drop("__asked")
