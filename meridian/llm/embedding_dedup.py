"""Near-duplicate vectors by a PCA-ordered tiled comparison.

Vectors are rotated so that the leading coordinates carry the most energy, put
in order of the first one and cut into tiles.  Two tiles whose first
coordinates are too far apart never meet.  Inside a pair of tiles the products
of the leading coordinates are accumulated first; by Cauchy-Schwarz the rest
adds at most the product of the suffix norms, and a pair stops as soon as that
cannot reach the threshold.  Survivors get the full cosine in double precision.

A pair of tiles returns counts and a spanning forest of its links, one row per
vector at most, never the pairs themselves; equal vectors are one class before
any comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored

#: Vectors of a tile, rows and columns compared at once, vectors in the sample that fits the rotation.
TILE, ROWS, COLUMNS, SAMPLE = 8192, 512, 2048, 10_000
#: Leading coordinates after which the bound is applied, as shares of the dimension.
STOPS = (0.125, 0.25, 0.5)
#: Slack of the bound over rounding in the rotated coordinates.
SLACK = 1e-9


def links(vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector.

    Vectors link at a cosine of ``threshold`` (above 0) or more, computed in
    double precision; only vectors of one length are compared.  Null, empty and
    zero vectors and those with null or non-finite components link with
    nothing.  Copies of a vector link with each other.  A repeated id is
    another vector of that name; a null id takes part in counts but in no
    component.  An empty table gives no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[embedding].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    classes = stored(
        rows.where("usable").groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()),  # fixed by being written
        "vectors")
    found = None
    for size in classes.groupBy(F.size("v").alias("n")).count().where("count > 1").orderBy("n").collect():
        part = _compare(classes.where(F.size("v") == size["n"]), size["n"], size["count"], threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        linked = classes.select("node", F.lit(0).cast("long").alias("n"), F.col("node").alias("component"))
    else:
        found = stored(found, "vector-links")
        counts = found.groupBy("node").agg(F.sum("n").alias("n"))
        linked = counts.join(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "node", "left")
    named = classes.join(linked, "node", "left").select("v", "least", "copies", "n", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    valid = rows.where("usable").join(named, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return valid.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _compare(classes: DataFrame, size: int, count: int, threshold: float) -> DataFrame:
    """``node, n, root``: links counted and a local root for every vector with links, per pair of tiles."""
    sample = np.array([r["v"] for r in classes.orderBy(F.xxhash64("v"), "least").limit(SAMPLE).collect()], float)  # bounded: only fits the rotation
    sample /= np.abs(sample).max(axis=1, keepdims=True)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    _, axes = np.linalg.eigh(sample.T @ sample)
    axes = np.ascontiguousarray(axes[:, ::-1])  # columns by falling energy
    tiles = -(-count // TILE)
    borders = np.quantile(sample @ axes[:, 0], [i / tiles for i in range(1, tiles)]) if tiles > 1 else np.array([])
    ranges = len(borders) + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_matrix(batch.column("v"), size))
            at = np.searchsorted(borders, unit @ axes[:, 0], side="right")
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column("node"), batch.column("copies"), batch.column("v")], ["r", "node", "copies", "v"])

    placed = stored(classes.select("node", "copies", "v").mapInArrow(place, "r int, node long, copies long, v array<double>"), "vector-ranges")
    # A range that ties or an unlucky sample overfilled goes to several tiles.
    held = {r["r"]: r["n"] for r in placed.groupBy("r").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per range
    parts = [max(1, -(-held.get(r, 0) // TILE)) for r in range(ranges)]
    first = np.concatenate([[0], np.cumsum(parts)]).astype(int)
    # The tiles a range's vectors can link into: those whose first coordinates are near enough.
    reach = np.sqrt(2 - 2 * threshold) + 1e-6
    last = [int(first[ranges if r + 1 == ranges else np.searchsorted(borders, borders[r] + reach, side="right") + 1]) - 1 for r in range(ranges)]
    pick = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("r") + 1)
    numbered = placed.withColumn("tile", pick(first[:-1]) + F.pmod(F.xxhash64("node"), pick(parts)).cast("int")).withColumn("last", pick(last))

    def pack(keys, table):
        table = table.combine_chunks()
        v = _matrix(table.column("v").chunk(0), size)
        return pa.table({
            "tile": pa.array([keys[0].as_py()], pa.int32()), "last": pa.array([table.column("last")[0].as_py()], pa.int32()),
            "nodes": pa.array([table.column("node").to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "copies": pa.array([table.column("copies").to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "v": pa.array([v.tobytes()], pa.binary())})

    packed = stored(numbered.select("tile", "last", "node", "copies", "v").groupBy("tile").applyInArrow(pack, "tile int, last int, nodes binary, copies binary, v binary"), "vector-tiles")
    partner = packed.select("nodes", "copies", "v", F.col("tile").alias("left_tile"), F.explode(F.sequence("tile", "last")).alias("tile"))
    right = packed.select("tile", F.col("nodes").alias("nodes2"), F.col("copies").alias("copies2"), F.col("v").alias("v2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                a = _tile(row["nodes"], row["copies"], row["v"], size)
                same = row["left_tile"] == row["tile"]
                b = a if same else _tile(row["nodes2"], row["copies2"], row["v2"], size)
                nodes, n, root = _pair(a, b, same, axes, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(n, pa.int64()), pa.array(root, pa.int64())], ["node", "n", "root"])

    pairs = partner.join(right.hint("shuffle_hash"), "tile")
    # One pair of tiles is a heavy row: deal the pairs out one by one, not by tile.
    spread = pairs.repartition(max(1, min(4000, tiles * (tiles + 1) // 2)), F.xxhash64("left_tile", "tile"))
    return spread.mapInArrow(run, "node long, n long, root long")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def _unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(axis=1, keepdims=True)  # keeps huge and tiny components out of overflow
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _tile(nodes: bytes, copies: bytes, v: bytes, size: int):
    return np.frombuffer(nodes, np.int64), np.frombuffer(copies, np.int64), _unit(np.frombuffer(v, float).reshape(-1, size))


def _pair(a, b, same: bool, axes: np.ndarray, threshold: float):
    """Links between two tiles (or inside one): ``(nodes, counts, local roots)`` of the linked."""
    (na, ca, ua), (nb, cb, ub) = a, b
    size = axes.shape[0]
    stops = sorted({max(1, int(size * s)) for s in STOPS})
    ra, rb = ua @ axes, ua @ axes if same else ub @ axes
    suffix = lambda r: [np.sqrt(np.maximum(0, 1 - (r[:, :k] ** 2).sum(1))) for k in stops]
    sa, sb = suffix(ra), suffix(rb)
    shift = 0 if same else len(na)
    label = np.arange(len(na) + (0 if same else len(nb)))
    count = np.zeros(len(label), np.int64)
    for i in range(0, len(na), ROWS):
        for j in range(i // COLUMNS * COLUMNS if same else 0, len(nb), COLUMNS):
            part = ra[i : i + ROWS, : stops[0]] @ rb[j : j + COLUMNS, : stops[0]].T
            bound = part + np.multiply.outer(sa[0][i : i + ROWS], sb[0][j : j + COLUMNS])
            x, y = np.nonzero(bound >= threshold - SLACK)
            if same:
                keep = x + i < y + j
                x, y = x[keep], y[keep]
            got = part[x, y]
            for n in range(1, len(stops)):
                if not len(x):
                    break
                lo, hi = stops[n - 1], stops[n]
                got = got + np.einsum("ij,ij->i", ra[x + i, lo:hi], rb[y + j, lo:hi])
                keep = got + sa[n][x + i] * sb[n][y + j] >= threshold - SLACK
                x, y, got = x[keep], y[keep], got[keep]
            if not len(x):
                continue
            x, y = x + i, y + j
            keep = np.einsum("ij,ij->i", ua[x], ub[y]) >= threshold
            x, y = x[keep], y[keep]
            np.add.at(count, x, cb[y])
            np.add.at(count, y + shift, ca[x])
            label = _join(label, x, y + shift)
    nodes = na if same else np.concatenate([na, nb])
    least = np.full(len(label), np.iinfo(np.int64).max)
    np.minimum.at(least, label, nodes)
    hit = count > 0
    return nodes[hit], count[hit], least[label][hit]


def _join(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after linking the positions ``x`` with ``y``."""
    while True:
        a, b = label[x], label[y]
        if (a == b).all():
            return label
        m = np.minimum(a, b)
        label = label.copy()
        np.minimum.at(label, a, m)
        np.minimum.at(label, b, m)
        while (label != label[label]).any():
            label = label[label]
