"""Merkle manifest of a table: a digest a row, a tree a group, one root.

A row's place in its group is the number of smaller ids.  Ids are not sorted
for it: every group keeps a bitmap of its ids, compressed to the 64-bit words
that are not empty, and words are merged from partial ones by ``bit_or`` before
the shuffle.  Popcounts of words are summed into directories over 16 more bits
of the id each, so that every running sum sees at most 65,536 rows; a rank is
the sum of a row's directory entries plus the popcount of its word below its bit.

Rows are then dealt by the place's high digits into slot arrays, one row for 512
neighbouring nodes with every node in the slot its place names.  A slot array
is reduced three levels at once; the digests that remain are the nodes of the
next round.  On the way back every slot gets the siblings above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, stored

#: Children of a node; levels reduced in one slot array.
ARITY, LEVELS = 8, 3
SLOTS = ARITY**LEVELS
#: Bits of the id that name a bit in a word, and a directory entry in the one above it.
WORD_BITS, DIRECTORY_BITS = 6, 16
#: A word that no id has: the place of null ids, before all others.
NULL_WORD = -(1 << (63 - WORD_BITS)) - 1
#: Copies of one row written by one task.
COPIES_AT_ONCE = 1 << 16


def field(c: Column) -> Column:
    """A value as ``length:value`` in bytes, null as a dash."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: list[Column]) -> Column:
    """Lower-case hexadecimal SHA-256 of a row's fields, one after the other."""
    return F.sha2(F.concat(*map(field, columns)), 256)


def group_key(c: Column) -> Column:
    """A text for every group that keeps its order, null first."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), text))


# -- places -----------------------------------------------------------------


def _word() -> Column:
    return F.coalesce(F.shiftright("id", WORD_BITS), F.lit(NULL_WORD))


def _bit() -> Column:
    return F.coalesce(F.col("id").bitwiseAND((1 << WORD_BITS) - 1), F.lit(0)).cast("int")


def words(ids: DataFrame) -> DataFrame:
    """``g, key, bits, n``: the non-empty words of every group's bitmap of ``id`` and the rows in each.

    ``n`` exceeds the popcount where ids repeat.
    """
    one = F.expr("shiftleft(1L, bit)")
    return ids.select("g", _word().alias("key"), _bit().alias("bit")).groupBy("g", "key").agg(F.bit_or(one).alias("bits"), F.count(F.lit(1)).alias("n"))


def directory(entries: DataFrame, bits: int) -> DataFrame:
    """``g, key, before, total``: rows of the group in entries of smaller keys, and in all.

    ``entries`` has ``g, key, n`` with keys of ``bits`` bits.  Entries that share
    all but 16 bits are summed into one of the level above, which comes first.
    """
    ahead = lambda *by: Window.partitionBy(*by).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    inside = lambda *by: F.coalesce(F.sum("n").over(ahead(*by)), F.lit(0))
    if bits <= DIRECTORY_BITS:
        return entries.select("g", "key", inside("g").alias("before"), F.sum("n").over(Window.partitionBy("g")).alias("total"))
    entries = entries.withColumn("parent", F.shiftright("key", DIRECTORY_BITS))
    above = directory(entries.groupBy("g", F.col("parent").alias("key")).agg(F.sum("n").alias("n")), bits - DIRECTORY_BITS)
    above = above.select("g", F.col("key").alias("parent"), F.col("before").alias("above"), "total")
    return entries.select("g", "key", "parent", inside("g", "parent").alias("inside")).join(above, ["g", "parent"]).select(
        "g", "key", (F.col("above") + F.col("inside")).alias("before"), "total")


def places(leaves: DataFrame) -> DataFrame:
    """``leaves`` (``g, id, leaf, bad``) with ``place``, the number of the group's rows before, and ``total``.

    Rows with one id come in the order of their digests.
    """
    found = stored(words(leaves), "manifest-words")
    at = stored(found.join(directory(found.select("g", "key", "n"), 64 - WORD_BITS), ["g", "key"]), "manifest-directory")
    single = F.bit_count("bits") == F.col("n")
    below = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.expr("shiftleft(-1L, bit)"))))
    keyed = leaves.withColumns({"key": _word(), "bit": _bit()})
    plain = keyed.join(at.where(single), ["g", "key"]).select("g", "id", "leaf", "bad", (F.col("before") + below).alias("place"), "total")
    several = at.where(~single)
    return plain if several.isEmpty() else plain.unionByName(_repeated(keyed.join(several, ["g", "key"])))


def _repeated(rows: DataFrame) -> DataFrame:
    """Places of rows in words with repeated ids.  Equal rows are counted first and written out again last."""
    kinds = stored(rows.groupBy("g", "key", "id", "leaf", "bad", "before", "total").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.substring("leaf", 1, 2)), "manifest-repeats")
    ahead = lambda *by: Window.partitionBy("g", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    inside = lambda *by: F.coalesce(F.sum("n").over(ahead(*by)), F.lit(0))
    # At most 64 ids a word, 65,536 prefixes an id; digests spread evenly over prefixes.
    by_prefix = kinds.groupBy("g", "key", "id", "p").agg(F.sum("n").alias("n"))
    by_id = by_prefix.groupBy("g", "key", "id").agg(F.sum("n").alias("n")).select("g", "key", F.col("id").alias("i"), inside("key", "id").alias("of_id"))
    by_prefix = by_prefix.select("g", "key", F.col("id").alias("i"), F.col("p").alias("q"), inside("key", "id", "p").alias("of_prefix"))
    first = kinds.select("*", F.col("id").alias("i"), F.col("p").alias("q"), inside("key", "id", "p", "leaf").alias("of_leaf"))
    for more in (by_id, by_prefix):
        same = [c for c in ("g", "key", "i", "q") if c in more.columns]
        left, right = first.alias("x"), more.alias("y")
        on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in same]
        first = left.join(right, on).select("x.*", *[c for c in more.columns if c not in same])
    first = first.withColumn("first", F.col("before") + F.col("of_id") + F.col("of_prefix") + F.col("of_leaf"))
    blocks = first.select("g", "id", "leaf", "bad", "first", "n", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES_AT_ONCE).cast("long"))).alias("b"))
    copy = F.explode(F.sequence("b", F.least(F.col("b") + COPIES_AT_ONCE, "n") - 1)).alias("copy")
    return blocks.repartition("leaf", "b").select("g", "id", "leaf", "bad", "first", "total", copy).select(
        "g", "id", "leaf", "bad", (F.col("first") + F.col("copy")).alias("place"), "total")


# -- trees ------------------------------------------------------------------


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(nodes: list[str], total: int) -> list[list[str]]:
    """A slot array's nodes, level by level, up to its last one in this round.

    ``total`` nodes of the whole group decide how many levels it has left.
    """
    out = [nodes]
    while len(out) <= LEVELS and total > 1:
        out.append([_sha("".join(nodes[i:i + ARITY])) for i in range(0, len(nodes), ARITY)])
        nodes, total = out[-1], -(-total // ARITY)
    return out


def _siblings(levels: list[list[str]], slot: int) -> list[tuple[str, str]]:
    """What stands left and right of a slot's way up, level by level."""
    out = []
    for level in levels[:-1]:
        start = slot - slot % ARITY
        out.append(("".join(level[start:slot]), "".join(level[slot + 1:start + ARITY])))
        slot //= ARITY
    return out


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list, list[list[str]]]]:
    """Rows of slot arrays: the row, its entries in any order and its levels."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            nodes = [""] * len(row["slots"])
            for s in row["slots"]:
                nodes[s["slot"]] = s["leaf"].hex()
            yield row, row["slots"], _levels(nodes, row["total"])


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, _, levels in _arrays(batches):
        (digest,) = levels[-1]
        yield pa.RecordBatch.from_pylist([{"g": row["g"], "place": row["place"], "total": -(-row["total"] // SLOTS), "leaf": bytes.fromhex(digest)}])


_STEPS = "array<struct<left:string,right:string>>"
_STEPS_ARROW = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every slot's way up: its own steps, then those of its array."""
    schema = pa.schema([("g", pa.string()), ("place", pa.int64()), ("subroot", pa.string()), ("root", pa.string()), ("steps", _STEPS_ARROW)])
    for row, slots, levels in _arrays(batches):
        rows = [{"g": row["g"], "place": row["place"] * SLOTS + s["slot"], "subroot": row["subroot"], "root": row["root"],
                 "steps": [{"left": a, "right": b} for a, b in _siblings(levels, s["slot"])] + row["steps"]} for s in slots]
        yield pa.RecordBatch.from_pylist(rows, schema)


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every leaf's proof, and the root its (tampered) digest folds to."""
    schema = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
                        ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])
    for row, slots, levels in _arrays(batches):
        above = "".join(s["left"] + s["right"] for s in row["steps"])
        folded: dict[str, str] = {}  # all intact leaves fold to the array's own digest
        rows = []
        for s in slots:
            leaf = s["leaf"].hex()
            now, proof = (s["bad"] or s["leaf"]).hex(), []
            for left, right in _siblings(levels, s["slot"]):
                proof += (left, right)
                now = _sha(left + now + right)
            if now not in folded:
                up = now
                for step in row["steps"]:
                    up = _sha(step["left"] + up + step["right"])
                folded[now] = up
            rows.append((s["id"], leaf, row["subroot"], row["root"], _sha("".join(proof) + above), folded[now], folded[now] == row["root"]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _rounds(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Slot arrays of every round from the nodes up, and the last node of every group (``g, leaf``).

    ``nodes`` has ``g, place, total, leaf`` and, for the rows of the table, ``id`` and ``bad``.
    """
    arrays = []
    while True:
        entry = F.struct((F.col("place") % SLOTS).cast("int").alias("slot"), "leaf", "id", "bad")
        # A group is a slot array: 512 entries at most.
        slots = stored(nodes.withColumn("up", F.shiftright("place", ARITY.bit_length() * LEVELS - LEVELS)).groupBy("g", "up", "total").agg(F.collect_list(entry).alias("slots"))
                       .withColumnRenamed("up", "place"), f"manifest-slots{len(arrays)}")
        arrays.append(slots)
        above = stored(slots.mapInArrow(_reduce, "g string, place long, total long, leaf binary"), f"manifest-nodes{len(arrays)}")
        if (above.agg(F.max("total")).first()[0] or 0) <= 1:
            return arrays, above.select("g", "leaf")
        nodes = above.withColumns({"id": F.lit(None).cast("long"), "bad": F.lit(None).cast("binary")})


def build(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", doc_id: str = "doc_id",
          tampered: Column | None = None, tamper: dict[str, Column] | None = None) -> DataFrame:
    """Manifest of a table: a row's leaf, its group's subroot, the root and the leaf's inclusion proof.

    A leaf is the SHA-256 of the row's ``columns`` as ``length:value`` (null: a
    dash).  Leaves of one ``group`` ascend by ``doc_id`` (null first; rows with
    one id by their digests), subroots by group (null first, then bytewise);
    every eight consecutive nodes become one.  Where ``tampered`` holds, the
    proof is checked against the leaf of the row with the columns in ``tamper``
    replaced; elsewhere against the leaf itself.  Returns ``doc_id, leaf,
    subroot, root, proof_sha256, folded_root, verified``.  Repeated rows are
    leaves of their own; empty texts have length 0; columns not named are not
    covered; an empty table gives no rows.
    """
    cols = {c: docs[c] for c in columns}
    leaf = leaf_digest(list(cols.values()))
    bad = F.when(tampered, leaf_digest([(tamper or {}).get(c, v) for c, v in cols.items()])) if tampered is not None else F.lit(None).cast("string")
    digests = docs.select(group_key(docs[group]).alias("g"), docs[doc_id].cast("long").alias("id"), F.unhex(leaf).alias("leaf"), F.unhex(bad).alias("bad"))
    arrays, subroots = _rounds(places(stored(digests, "manifest-leaves")))
    ordered, groups = numbered(subroots, [F.asc("g")], "manifest-groups")
    none = {"id": F.lit(None).cast("long"), "bad": F.lit(None).cast("binary")}
    tops = ordered.select(F.lit("").alias("g"), F.col("nth").alias("place"), F.lit(groups).alias("total"), "leaf").withColumns(none)
    top_arrays, root = _rounds(tops)
    root = root.first()
    root = root["leaf"].hex() if root else None
    # Down again, from the last round's only array of every group.
    steps = F.lit(None).cast(_STEPS)
    way = top_arrays[-1].select("g", "place", F.lit(None).cast("string").alias("subroot"), F.lit(root).alias("root"), F.coalesce(steps, F.array().cast(_STEPS)).alias("steps"))
    form = f"g string, place long, subroot string, root string, steps {_STEPS}"
    for slots in reversed(top_arrays):
        way = slots.join(way, ["g", "place"]).mapInArrow(_descend, form)
    way = way.withColumnRenamed("place", "nth").drop("g", "subroot").join(ordered, "nth").select(
        "g", F.lit(0).cast("long").alias("place"), F.lower(F.hex("leaf")).alias("subroot"), "root", "steps")
    for slots in reversed(arrays[1:]):
        way = stored(slots.join(way, ["g", "place"]).mapInArrow(_descend, form), "manifest-ways")
    return arrays[0].join(way, ["g", "place"]).mapInArrow(
        _prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
