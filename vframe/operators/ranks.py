"""Exact order statistics without a buffer of a column's values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vframe.operators.apply import col

#: Values of a bracket that are ranked on the driver, at most, and the accuracy of a bracket's ends.
RANKED, ACCURACY = 20_000, 5_000


def _same(a: float, b: float) -> bool:
    return a == b or math.isnan(a) and math.isnan(b)


def _halved(df: DataFrame, c: str, rank: int, low: float, high: float) -> tuple[float, float]:
    """A bracket that a sketch can't narrow, cut at about its middle value: what is below that, that value, or what is above."""
    x = col(c).cast("double")
    middle = df.agg(F.percentile_approx(F.when((x >= F.lit(low)) & (x <= F.lit(high)), x), 0.5, ACCURACY)).first()[0]
    at = F.lit(middle)
    below, upto, before, after = df.agg(F.count_if(x < at), F.count_if(x <= at), F.max(F.when(x < at, x)), F.min(F.when(x > at, x))).first()
    return (low, before) if rank < below else (middle, middle) if rank < upto else (after, high)


def order_statistics(df: DataFrame, asked: dict[str, list[int]], sizes: dict[str, int]) -> dict[str, list[float | None]]:
    """The values at given ranks (from 0) among the non-null values of columns, of which there are ``sizes``; NaN is the largest. None where there is no such rank.

    A sketch brackets each rank; one pass counts what lies below and inside the brackets. Where a bracket holds at most RANKED distinct values
    they are ranked on the driver, else it is bracketed anew inside. So no buffer holds a column's values.
    """
    found: dict[tuple[str, int], float | None] = {}
    todo = {(c, k): (None, None) for c, ranks in asked.items() for k in dict.fromkeys(ranks)}
    while todo:
        keys = list(todo)

        def inside(c: str, low: float | None, high: float | None) -> Column:
            x = col(c).cast("double")
            return x.isNotNull() if low is None else (x >= F.lit(low)) & (x <= F.lit(high))

        if None in next(iter(todo.values())):  # the first round: nothing is bracketed
            counts = [n for c, _ in keys for n in (sizes[c], 0)]
        else:
            below_low = lambda c, k: F.count_if(col(c).cast("double") < F.lit(todo[c, k][0]))
            counts = df.agg(*[n for c, k in keys for n in (F.count_if(inside(c, *todo[c, k])), below_low(c, k))]).first()
        sketches, small = [], []
        for i, (c, k) in enumerate(keys):
            n, below = counts[2 * i], counts[2 * i + 1]
            low, high = todo[c, k]
            if not 0 <= k - below < n:
                found[c, k] = None
            elif low is not None and _same(low, high):
                found[c, k] = low
            elif n <= RANKED:
                small.append((c, k, k - below))
            else:
                q, slack = (k - below + 0.5) / n, 2.0 / ACCURACY
                ends = F.percentile_approx(F.when(inside(c, low, high), col(c).cast("double")), [max(0.0, q - slack), min(1.0, q + slack)], ACCURACY)
                sketches.append(((c, k), ends))
        if small:
            rows = F.array(*[F.struct(F.lit(i).alias("i"), F.when(inside(c, *todo[c, k]), col(c).cast("double")).alias("x")) for i, (c, k, _) in enumerate(small)])
            values = df.select(F.explode(rows).alias("r")).where("r.x is not null").groupBy("r.i", "r.x").count().collect()  # at most RANKED for each rank
            for i, (c, k, rank) in enumerate(small):
                for x, n in sorted(((r["x"], r["count"]) for r in values if r["i"] == i), key=lambda v: (math.isnan(v[0]), v[0])):
                    if rank < n:
                        found[c, k] = x
                        break
                    rank -= n
        fresh = df.agg(*[e for _, e in sketches]).first() if sketches else []
        after = {}
        for (key, _), ends in zip(sketches, fresh, strict=True):
            low, high = ends
            if todo[key][0] is not None and _same(low, todo[key][0]) and _same(high, todo[key][1]):
                low, high = _halved(df, *key, low, high)
            after[key] = (low, high)
        todo = after
    return {c: [found[c, k] for k in ranks] for c, ranks in asked.items()}


def median_of(values: list[float | None]) -> float | None:
    """The median from the values at the two middle ranks."""
    low, high = values
    return None if low is None else low if low == high else low / 2 + high / 2
