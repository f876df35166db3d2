"""Mixing sources to target weights by Pfair scheduling.

A source of weight w is a task of utilisation w on one processor whose slots
each take one block of BLOCK documents. Its block i (from 0) has the release time
floor(i / w) and the deadline ceil((i + 1) / w); earliest deadline first, among
released blocks, then meets every deadline, so at every slot each source is less
than one block away from its share.

The weights are whole parts of a period. The schedule of one period depends on the
weights alone, so the driver works it out as a table of PERIOD slots at most, and
block i is looked up by its remainder. All rows stay in the engine: ranks within a source come
from counts of hash ranges, so a source with a third of all rows is ranked by many
tasks. Sources that run out leave their slots empty and the others keep their order.
"""

from __future__ import annotations

import heapq
import math
import warnings
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents of a block.
BLOCK = 16
#: Slots of a period at most (a table of a few MB, which is broadcast), and sources at most.
PERIOD = 1 << 17
SOURCES = 1 << 15
#: Hash ranges that the rows of a source are ranked in, as a power of two at least, and rows that a range should have at most.
RANGE_BITS, RANGE_ROWS = 12, 1 << 16
#: Parts that :func:`tempered` shares out.
PARTS = 1000
#: Columns that :func:`mix` adds.
ADDED = ("_block", "_release", "_deadline", "_slot", "_place")


def _exact(weight: float | Fraction) -> Fraction:
    """A weight as a fraction; a float counts as the decimal number that it prints as."""
    if not math.isfinite(weight) or weight <= 0:
        raise ValueError(f"every source needs a positive weight, not {weight}")
    return Fraction(repr(weight)) if isinstance(weight, float) else Fraction(weight)


def whole_parts(weights: Mapping[str | None, float | Fraction]) -> dict[str | None, int]:
    """Weights as whole parts of a period.

    The parts are exact where the least period is of PERIOD slots or fewer. Else they are rounded to parts of PERIOD by largest remainder,
    one at least, which a warning tells with the largest change.
    """
    if not weights:
        raise ValueError("there is no source")
    if len(weights) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    shares = {k: _exact(w) for k, w in weights.items()}
    total = sum(shares.values())
    shares = {k: w / total for k, w in shares.items()}
    period = math.lcm(*(w.denominator for w in shares.values()))
    if period <= PERIOD:
        return {k: int(w * period) for k, w in shares.items()}
    parts = {k: max(1, int(w * PERIOD)) for k, w in shares.items()}
    order = sorted(shares, key=lambda k: (parts[k] - shares[k] * PERIOD, str(k)))
    for k in order[: max(0, PERIOD - sum(parts.values()))]:
        parts[k] += 1
    made = sum(parts.values())
    change = max(abs(Fraction(parts[k], made) / shares[k] - 1) for k in shares)
    warnings.warn(f"weights rounded to parts of {made}; a share changes by {float(change):.2%} at most", stacklevel=2)
    return parts


def tempered(docs: DataFrame, exponent: float = 0.5, source_col: str = "source") -> dict[str | None, int]:
    """A weight for each source: its number of rows to the power ``exponent``, in whole parts of about PARTS, one at least."""
    rows = docs.groupBy(F.col(source_col).cast("string").alias("source")).count().limit(SOURCES + 1).collect()  # bounded
    if len(rows) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    total = sum(r["count"] ** exponent for r in rows)
    return {r["source"]: max(1, round(PARTS * r["count"] ** exponent / total)) for r in rows}


def schedule(parts: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """One period by earliest deadline first: (source, block, release, deadline, slot)."""
    period = sum(parts.values())
    blocks = lambda s, i: (i * period // parts[s], -(-(i + 1) * period // parts[s]))
    coming = [(*blocks(s, 0), s, 0) for s in sorted(parts)]
    heapq.heapify(coming)
    ready: list[tuple[int, int, str, int]] = []
    out = []
    for slot in range(period):
        while coming and coming[0][0] <= slot:
            release, deadline, s, i = heapq.heappop(coming)
            heapq.heappush(ready, (deadline, release, s, i))
        deadline, release, s, i = heapq.heappop(ready)
        out.append((s, i, release, deadline, slot))
        if i + 1 < parts[s]:
            heapq.heappush(coming, (*blocks(s, i + 1), s, i + 1))
    return out


def _comparable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_comparable(f.dataType) for f in kind.fields)
    return _comparable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def _content(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed."""
    return F.xxhash64(F.lit(5), *[docs[f"`{f.name.replace('`', '``')}`"] for f in docs.schema.fields if _comparable(f.dataType)])


def _placed(docs: DataFrame, weights: Mapping[str | None, float | Fraction], default_weight: float | Fraction, id_col: str, source_col: str) -> DataFrame:
    """(row, then the columns of ADDED): each row as one value, so that no name of it can clash."""
    spark = docs.sparkSession
    name = F.coalesce(F.concat(F.lit("="), docs[source_col].cast("string")), F.lit("null"))
    packed = docs.select(F.struct("*").alias("row"), name.alias("source"), F.xxhash64(F.lit(9), docs[id_col], _content(docs)).alias("hash"))
    sizes = {r[0]: r[1] for r in packed.groupBy("source").count().limit(SOURCES + 1).collect()}  # bounded
    if not sizes:
        kinds = zip(ADDED, ("long", "long", "long", "long", "int"), strict=True)
        return packed.select("row", *[F.lit(None).cast(k).alias(n) for n, k in kinds])
    parts = whole_parts({s: weights.get(s[1:] if s[0] == "=" else None, default_weight) for s in sizes})
    # A place doesn't depend on the ranges: they cut the order of hashes, the finer the larger a source is.
    bits = max(RANGE_BITS, (max(sizes.values()) // RANGE_ROWS).bit_length())
    tagged = packed.withColumn("range", F.shiftrightunsigned("hash", 64 - bits))
    counts = tagged.groupBy("source", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))

    period = sum(parts.values())
    blocks = lambda s, i: (i * period // parts[s], -(-(i + 1) * period // parts[s]))
    coming = [(*blocks(s, 0), s, 0) for s in sorted(parts)]
    heapq.heapify(coming)
    ready: list[tuple[int, int, str, int]] = []
    out = []
    for slot in range(period):
        while coming and coming[0][0] <= slot:
            release, deadline, s, i = heapq.heappop(coming)
            heapq.heappush(ready, (deadline, release, s, i))
        deadline, release, s, i = heapq.heappop(ready)
        out.append((s, i, release, deadline, slot))
        if i + 1 < parts[s]:
            heapq.heappush(coming, (*blocks(s, i + 1), s, i + 1))
    return out


def _comparable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_comparable(f.dataType) for f in kind.fields)
    return _comparable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def _content(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed."""
    return F.xxhash64(F.lit(5), *[docs[f"`{f.name.replace('`', '``')}`"] for f in docs.schema.fields if _comparable(f.dataType)])


def _placed(docs: DataFrame, weights: Mapping[str | None, float | Fraction], default_weight: float | Fraction, id_col: str, source_col: str) -> DataFrame:
    """(row, then the columns of ADDED): each row as one value, so that no name of it can clash."""
    spark = docs.sparkSession
    name = F.coalesce(F.concat(F.lit("="), docs[source_col].cast("string")), F.lit("null"))
    packed = docs.select(F.struct("*").alias("row"), name.alias("source"), F.xxhash64(F.lit(9), docs[id_col], _content(docs)).alias("hash"))
    tagged = packed.withColumn("range", F.shiftrightunsigned("hash", 52).cast("int"))
    counts = tagged.groupBy("source", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))

    found = [r[0] for r in tagged.select("source").distinct().limit(SOURCES + 1).collect()]  # bounded
    if not found:
        kinds = zip(ADDED, ("long", "long", "long", "long", "int"), strict=True)
        return packed.select("row", *[F.lit(None).cast(k).alias(n) for n, k in kinds])
    parts = whole_parts({s: weights.get(s[1:] if s[0] == "=" else None, default_weight) for s in found})
    period = sum(parts.values())
    slots = spark.createDataFrame(schedule(parts), "source string, at long, r long, d long, s long")
    share = spark.createDataFrame(list(parts.items()), "source string, parts long")

    within = Window.partitionBy("source", "range").orderBy("hash")
    ranked = (
        tagged.withColumn("rank", F.row_number().over(within))
        .join(starts, ["source", "range"])
        .withColumn("rank", F.col("start") + F.col("rank") - 1)
        .join(F.broadcast(share), "source")  # at most SOURCES rows
        .withColumn("block", F.floor(F.col("rank") / BLOCK))
        .withColumn("at", F.col("block") % F.col("parts"))
        .withColumn("cycle", F.floor(F.col("block") / F.col("parts")) * F.lit(period))
        .join(F.broadcast(slots), ["source", "at"])  # at most PERIOD + SOURCES rows
    )
    return ranked.select(
        "row",
        F.col("block").alias("_block"),
        (F.col("cycle") + F.col("r")).alias("_release"),
        (F.col("cycle") + F.col("d")).alias("_deadline"),
        (F.col("cycle") + F.col("s")).alias("_slot"),
        (F.col("rank") % BLOCK).cast("int").alias("_place"),
    )


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float | Fraction] | None = None,
    default_weight: float | Fraction = 1,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """Give every row its place in the mixed order; adds columns to those of ``docs``.

    Adds _block (number within the source), _release, _deadline and _slot of the block, and _place
    within it; (_slot, _place) is unique and sorts the mix. Columns of ``docs`` with these names are replaced; no other
    name clashes. Sources that ``weights`` doesn't list have ``default_weight``; a weight of zero is refused, as rows
    are never dropped. A null source is a source of its own, listed as None. Rows of a source are dealt in an order by hash of the
    identifier and the other columns, so that repeated and null identifiers spread too; rows that are equal
    throughout follow each other. No rows give no rows.
    """
    placed = _placed(docs, weights or {}, default_weight, id_col, source_col)
    return placed.select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ADDED], *ADDED)


def in_mixed_order(
    docs: DataFrame,
    weights: Mapping[str | None, float | Fraction] | None = None,
    default_weight: float | Fraction = 1,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` sorted by the mix; columns stay as they are, whatever their names."""
    return _placed(docs, weights or {}, default_weight, id_col, source_col).orderBy("_slot", "_place").select("row.*")
