"""Sharding by sampled splitters (DataFrame functions only).

Records are ordered by the key ``(hash of the text, doc_id, ...)``, so equal
texts are neighbours.  A size-weighted sample of hashes gives the quantile
boundaries of many narrow ranges; every record finds its range by a binary
search in the boundary array.  Ranges holding more rows than a task should
sort are subdivided in key order: a hot text gets ranges of its own by a second
hash over ``doc_id``, the rest is cut by the first hash.  Exact byte and row totals per range
turn range-local running sums into global ones, so shard sizes are equal up to
one record even where the sample was unlucky.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Expected sampled keys per range; bounds the sample whatever the input size.
SAMPLE_PER_RANGE = 64
#: Rows of a range to aim for, and the most boundaries held as a constant (ranges then grow).
ROWS_PER_RANGE, MOST_RANGES = 500_000, 8192
#: A range is subdivided when it holds this many times its even share of rows.
OVERFULL = 2


def shard(docs: DataFrame, shards: int = 16, ranges: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Assign every record to one of ``shards`` shards of near-equal bytes.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.
    ``size`` is the UTF-8 length plus one (null text: 1, its ``text_crc32`` is
    null); the law is ``bytes``: shard ``k`` takes the records whose running
    size falls into the k-th equal part of the total, so shard sizes differ by
    less than the two records at their borders.  ``slot`` numbers a shard's
    records from 0 without gaps; ``grown_shard`` is null under this law.
    Equal texts are neighbours and share a shard unless a border falls between
    them.  Fully repeated rows are separate records.  An empty table gives no
    rows; null ids sort first.
    """
    rows = stored(
        docs.select(
            docs[doc_id].cast("long").alias("doc_id"),
            F.coalesce(F.octet_length(docs[text].cast("string")).cast("long"), F.lit(0)).__add__(1).alias("size"),
            F.crc32(docs[text].cast("binary")).alias("text_crc32"),
            F.xxhash64(docs[text].cast("string")).alias("k1"),
        ).withColumn("k2", F.xxhash64("doc_id", "size")),
        "shard-keys",
    )
    total = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    if not total["n"]:
        return _labelled(rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}))
    ranges = ranges or min(MOST_RANGES, max(256, total["n"] // ROWS_PER_RANGE))
    borders = _splitters(rows, total["bytes"], ranges)
    coarse = rows.withColumn("r", _range_of(F.col("k1"), borders))
    # Exact totals decide which ranges are overfull and into how many parts they go.
    limit = OVERFULL * max(1, total["n"] // ranges)
    full = {row["r"]: row["n"] for row in coarse.groupBy("r").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).collect()}
    sub = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("part"))
    if full:
        in_full = F.get(F.array(*[F.lit(r in full) for r in range(len(borders) + 1)]), F.col("r"))
        # At most one hot text for every ``limit`` rows.
        hot = coarse.where(in_full).groupBy("r", "k1").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).orderBy("k1").collect()
        for row in hot:
            full[row["r"]] -= row["n"]
        sub = _subdivided(borders, {r: -(-n // limit) for r, n in full.items()}, [(row["k1"], -(-row["n"] // limit)) for row in hot])
    keyed = coarse.withColumn("s", sub)
    by_range = keyed.groupBy("r", "s").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("c"))
    ahead = Window.orderBy("r", "s").rowsBetween(Window.unboundedPreceding, -1)
    before = by_range.select("r", "s", F.coalesce(F.sum("b").over(ahead), F.lit(0)).alias("b0"), F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("c0"))
    order = Window.partitionBy("r", "s").orderBy("k1", "k2", "doc_id", "size", "text_crc32")
    local = keyed.withColumn("i", F.row_number().over(order)).withColumn(
        "b", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = stored(
        local.join(F.broadcast(before), ["r", "s"]).select(  # one row per range: bounded by ranges and parts
            "doc_id", "size", "text_crc32", (F.col("c0") + F.col("i") - 1).alias("at"),
            F.least(F.lit(shards - 1), F.floor((F.col("b0") + F.col("b") - F.col("size")) * shards / F.lit(total["bytes"]))).cast("int").alias("shard"),
        ),
        "shard-rows",
    )
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return _labelled(placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("at") - F.col("first")))


def _labelled(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _splitters(rows: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantile boundaries of a sample in which a record's chance is its share of all bytes.

    The draw is a hash of the record, so a recomputed task draws the same rows.
    """
    draw = (F.xxhash64(F.lit("draw"), "k1", "k2").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53)))
    wanted = ranges * SAMPLE_PER_RANGE
    sample = rows.where(draw < F.col("size") * (wanted / total)).select("k1")
    at = [i / ranges for i in range(1, ranges)]
    found = sample.agg(F.percentile_approx("k1", at, 20 * ranges).alias("q")).first()["q"] if at else None
    return sorted(set(found or []))


def _subdivided(borders: list[int], parts: dict[int, int], hot: list[tuple[int, int]]):
    """``at, part`` in the order of ``(k1, k2)`` inside a range: which hot texts lie before, and the cut of a hot text or of the rest."""
    k1, r = F.col("k1"), F.col("r")
    lows, highs = [-(2.0**63), *map(float, borders)], [*map(float, borders), 2.0**63]
    per_range = [F.array(*map(F.lit, x)) for x in (lows, highs, [parts.get(i, 1) for i in range(len(lows))])]
    low, high, cuts = (F.get(x, r) for x in per_range)
    rest = F.floor((k1.cast("double") - low) / (high - low) * cuts)
    if not hot:
        return F.struct(F.lit(0).alias("at"), rest.cast("long").alias("part"))
    upto = _range_of(k1, [k for k, _ in hot])
    own = F.coalesce(F.get(F.array(*[F.lit(k).cast("long") for k, _ in hot]), upto - 1) == k1, F.lit(False))
    unit = (F.shiftright("k2", 11) + F.lit(1 << 52)) / F.lit(float(1 << 53))  # 0 to 1, in the order of k2
    mine = F.floor(unit * F.get(F.array(*[F.lit(n) for _, n in hot]), upto - 1))
    return F.struct((2 * upto - own.cast("int")).alias("at"), F.when(own, mine).otherwise(rest).cast("long").alias("part"))


def _range_of(key, borders: list[int]):
    """Number of borders at or below the key, by binary search over a constant array."""
    if not borders:
        return F.lit(0)
    const = F.array(*[F.lit(b).cast("long") for b in borders])
    top = len(borders).bit_length()
    steps = F.array(*[F.lit(1 << k) for k in range(top - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda lo, w: F.when((lo + w <= len(borders)) & (F.get(const, lo + w - 1) <= key), lo + w).otherwise(lo))
