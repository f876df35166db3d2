"""Read-only profiles as small frames: schema report, statistics, association, distributions, fits."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vframe.functions.caps import PREVIEW_COLUMNS, SCHEMA_COLUMNS, STRING, capped_rows
from vframe.operators import linalg
from vframe.operators.apply import col
from vframe.operators.fit import kinds, unknown
from vframe.operators.ranks import median_of, order_statistics
from vframe.plans.specs import StepError

TOP_VALUES = 20
#: Rows of the Monte-Carlo fit, its resamples, and the least rows of any fit.
MC_ROWS, MC_RESAMPLES, LEAST_ROWS, LEAST_EXPECTED = 5000, 199, 8, 5.0


def _rows(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def _stacked(wide: DataFrame, names: list[str], fields: dict[str, str], tag: str = "column") -> DataFrame:
    """One row for each name from a one-row frame with columns <field>_<i>."""
    entries = [F.struct(F.lit(n).alias(tag), *[F.col(f"{f}_{i}").cast(t).alias(f) for f, t in fields.items()]) for i, n in enumerate(names)]
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def schema_report(df: DataFrame) -> DataFrame:
    """(column, dtype, null_count, null_rate, n_unique) of all columns; null is a value of its own."""
    names = df.columns
    stats = [F.count("*").alias("total")]
    for i, n in enumerate(names):
        c = col(n)
        stats += [F.count_if(c.isNull()).alias(f"null_count_{i}"), (F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))).alias(f"n_unique_{i}")]
    wide = df.agg(*stats).withColumns({f"null_rate_{i}": F.when(F.col("total") > 0, F.round(F.col(f"null_count_{i}") / F.greatest("total", F.lit(1)), 4)).otherwise(0.0) for i in range(len(names))})
    wide = wide.withColumns({f"dtype_{i}": F.lit(df.schema[n].dataType.simpleString()) for i, n in enumerate(names)})
    return _stacked(wide, names, {"dtype": "string", "null_count": "long", "null_rate": "double", "n_unique": "long"})


def head_samples(df: DataFrame, rows: int = 3) -> list[dict]:
    """The first rows as plain dictionaries, for a report."""
    return [{k: rendered(v) for k, v in r.asDict().items()} for r in df.select(*[col(c) for c in df.columns[:PREVIEW_COLUMNS]]).limit(rows).collect()]


def rendered(value: object) -> object:
    """A value for a report: null, NaN and infinities as None, floats to 6 places, others as (cut) text."""
    if value is None or isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, int) or hasattr(value, "as_tuple"):
        return int(value)
    text = str(value)
    return text if len(text) <= STRING else f"{text[:STRING]}…[+{len(text) - STRING} chars]"


def report(df: DataFrame, rows: int = 3) -> dict:
    """Size, columns and head samples of a frame; columns past SCHEMA_COLUMNS are counted and not shown."""
    shown, note = capped_rows(schema_report(df.select(*[col(c) for c in df.columns[: SCHEMA_COLUMNS + 1]])), SCHEMA_COLUMNS)
    note = note and note | {"total": len(df.columns)}
    return {"rows": df.count(), "cols": len(df.columns), "columns": shown, "samples": head_samples(df, rows)} | (note or {})


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, count, null_count, mean, median, std, min, q1, q3, max) of numeric columns; quartiles by nearest rank."""
    problems = unknown(df, columns or [])
    if problems:
        raise StepError(*problems)
    names = [n for n in (columns or df.columns) if kinds(df)[n] == "numeric"]
    if not names:
        raise StepError("no numeric column")
    stats = []
    for c in names:
        x = col(c)
        stats += [F.count(x), F.count_if(x.isNull()), F.avg(x), F.stddev_samp(x), F.min(x).cast("double"), F.max(x).cast("double")]
    got = list(df.agg(*stats).first())
    by_column = {c: got[6 * i : 6 * i + 6] for i, c in enumerate(names)}
    nearest = lambda n, q: math.floor((n - 1) * q + 0.5)
    ranks = {c: [nearest(n, 0.25), nearest(n, 0.75), (n - 1) // 2, n // 2] for c, (n, *_) in by_column.items() if n}
    at = order_statistics(df, ranks, {c: n for c, (n, *_) in by_column.items()})
    rows = []
    for c, (n, nulls, mean, std, low, high) in by_column.items():
        q1, q3, *middle = at.get(c, [None] * 4)
        rows.append((c, n, nulls, *[None if v is None else float(v) for v in (mean, median_of(middle), std, low, q1, q3, high)]))
    return _rows(df, rows, "column string, count long, null_count long, mean double, median double, std double, min double, q1 double, q3 double, max double")


def pearson(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(column_a, column_b, value); rows with a null in either don't count; null where a column is constant."""
    stats = []
    for i, (a, b) in enumerate(pairs):
        both = col(a).isNotNull() & col(b).isNotNull()
        x, y = (F.when(both, col(c).cast("double")) for c in (a, b))
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        stats.append(F.try_divide(F.covar_pop(x, y), F.nullif(spread, F.lit(0.0))).alias(f"v{i}"))
    entries = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"v{i}").alias("value")) for i, (a, b) in enumerate(pairs)]
    return df.agg(*stats).select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def _long(df: DataFrame, entries: list[Column]) -> DataFrame:
    """A row for each row and entry: one scan serves all entries, and the aggregate that follows combines before its shuffle."""
    return df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def _named(found: DataFrame, pairs: list[tuple[str, str]], value: Column) -> DataFrame:
    names = _rows(found, [(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, column_a string, column_b string")
    return names.join(found.select("pair", value.alias("value")), "pair", "left").select("column_a", "column_b", "value")  # a row for each pair


def cramers_v_of(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Cramér's V of pairs of columns over the observed cells, without bias correction; one scan for all pairs."""
    text = lambda c: col(c).cast("string")
    each = _long(df, [F.struct(F.lit(i).alias("pair"), text(a).alias("a"), text(b).alias("b")) for i, (a, b) in enumerate(pairs)])
    cells = each.where("a is not null and b is not null").groupBy("pair", "a", "b").agg(F.count("*").cast("double").alias("n"))
    rows, cols = cells.groupBy("pair", "a").agg(F.sum("n").alias("r")), cells.groupBy("pair", "b").agg(F.sum("n").alias("c"))
    totals = rows.groupBy("pair").agg(F.sum("r").alias("t"), F.count("*").alias("n_a")).join(cols.groupBy("pair").agg(F.count("*").alias("n_b")), "pair")
    wide = cells.join(rows, ["pair", "a"]).join(cols, ["pair", "b"]).join(F.broadcast(totals), "pair")  # a row for each pair
    e = F.col("r") * F.col("c") / F.col("t")
    got = wide.groupBy("pair").agg(F.sum((F.col("n") - e) * (F.col("n") - e) / e).alias("x"), F.first("t").alias("t"), F.first(F.least("n_a", "n_b")).alias("m"))
    return _named(got, pairs, F.when((F.col("t") > 0) & (F.col("m") > 1), F.sqrt(F.col("x") / (F.col("t") * (F.col("m") - 1)))))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cramér's V of two columns."""
    return cramers_v_of(df, [(a, b)])


def eta_squared_of(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Share of a number's variation between the categories, for pairs of a category and a number; null where there is none. One scan for all pairs."""
    each = _long(df, [F.struct(F.lit(i).alias("pair"), col(c).cast("string").alias("k"), col(n).cast("double").alias("x")) for i, (c, n) in enumerate(pairs)])
    found = each.where("k is not null and x is not null").groupBy("pair", "k")
    groups = found.agg(F.count("*").cast("double").alias("n"), F.avg("x").alias("m"), F.coalesce(F.var_pop("x"), F.lit(0.0)).alias("v"))
    whole = groups.groupBy("pair").agg(F.sum(F.col("n") * F.col("v")).alias("w"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    apart = groups.join(F.broadcast(whole), "pair")  # a row for each pair
    between = apart.groupBy("pair").agg(F.sum(F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g"))).alias("b"), F.first("w").alias("w"))
    return _named(between, pairs, F.try_divide(F.col("b"), F.nullif(F.col("b") + F.col("w"), F.lit(0.0))))


def eta_squared(df: DataFrame, category: str, number: str) -> DataFrame:
    """Eta squared of a category and a number."""
    return eta_squared_of(df, [(category, number)])


def correlation(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(method, column_a, column_b, value, rank) for all pairs: Pearson, Cramér's V or Eta² by the columns' types;
    ranks are by strength within the method."""
    names = columns or df.columns
    problems = unknown(df, names) + ([] if len(names) > 1 else ["at least two columns are needed"])
    if problems:
        raise StepError(*problems)
    number = [n for n in names if kinds(df)[n] == "numeric"]
    other = [n for n in names if n not in number]
    parts = []
    if len(number) > 1:
        parts.append(pearson(df, list(combinations(number, 2))).withColumn("method", F.lit("pearson")))
    if len(other) > 1:
        parts.append(cramers_v_of(df, list(combinations(other, 2))).withColumn("method", F.lit("cramers_v")))
    if other and number:
        parts.append(eta_squared_of(df, [(c, n) for c in other for n in number]).withColumn("method", F.lit("eta_squared")))
    strongest = Window.partitionBy("method").orderBy(F.desc(F.abs(F.coalesce("value", F.lit(0.0)))), "column_a", "column_b")
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(strongest))
    return ranked.select("method", "column_a", "column_b", "value", "rank")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, count, label): equal-width, right-closed bins, the first with its minimum; empty bins stay.
    A constant column has one bin, a column without values none."""
    if unknown(df, [column]) or kinds(df)[column] != "numeric" or bins < 1:
        raise StepError(f"a histogram needs a numeric column and at least 1 bin, not {column!r} and {bins}")
    x = col(column).cast("double")
    ends = df.agg(F.min(x).alias("a"), F.max(x).alias("b")).first()
    schema = "bin int, low double, high double, count long, label string"
    if ends["a"] is None:
        return _rows(df, [], schema)
    edges = [ends["a"], ends["b"]] if ends["a"] == ends["b"] else [ends["a"] + i * (ends["b"] - ends["a"]) / bins for i in range(bins + 1)]
    n = len(edges) - 1
    counts = [F.count_if((x <= edges[i + 1] if i < n - 1 else x.isNotNull()) & (x > edges[i] if i else x.isNotNull())).alias(f"count_{i}") for i in range(n)]
    label = [f"{'(' if i else '['}{round(edges[i], 6)}, {round(edges[i + 1], 6)}]" for i in range(n)]
    entries = [F.struct(F.lit(i).alias("bin"), F.lit(edges[i]).alias("low"), F.lit(edges[i + 1]).alias("high"), F.col(f"count_{i}").alias("count"), F.lit(label[i]).alias("label")) for i in range(n)]
    return df.agg(*counts).select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def frequencies(df: DataFrame, column: str, top: int = TOP_VALUES) -> DataFrame:
    """(value, count, proportion): the most frequent values, null among them; ties by value."""
    counts = df.groupBy(col(column).cast("string").alias("value")).agg(F.count("*").alias("count"))
    total = df.agg(F.count("*").alias("total"))
    best = counts.orderBy(F.desc("count"), F.asc_nulls_first("value")).limit(top)
    return best.join(F.broadcast(total)).select("value", "count", F.round(F.col("count") / F.col("total"), 4).alias("proportion"))


def distribution(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """The histogram of a numeric column, the frequency table of another."""
    if unknown(df, [column]):
        raise StepError(*unknown(df, [column]))
    return histogram(df, column, bins) if kinds(df)[column] == "numeric" else frequencies(df, column)


def fit_method(name: str | None) -> str:
    """Names of the fit methods; what is unknown means chi2."""
    key = "".join(c for c in (name or "").lower() if c.isalnum())
    return "monte_carlo" if key in ("montecarlo", "mc", "ks", "bootstrap", "kolmogorovsmirnov") else "chi2"


def merge_low(observed: list[float], expected: list[float], least: float = LEAST_EXPECTED) -> tuple[list[float], list[float]]:
    """Neighbouring bins joined from the left until each expects ``least``; what is left joins the last."""
    out: list[list[float]] = []
    o = e = 0.0
    for x, y in zip(observed, expected, strict=True):
        o, e = o + x, e + y
        if e >= least:
            out.append([o, e])
            o = e = 0.0
    if (o or e) and out:
        out[-1] = [out[-1][0] + o, out[-1][1] + e]
    elif o or e:
        out.append([o, e])
    return [x[0] for x in out], [x[1] for x in out]


def _chi2(name: str, params: tuple[float, ...], bins: list) -> tuple[float, float]:
    n = sum(b["count"] for b in bins)
    at = [0.0, *(linalg.cdf(name, b["high"], params) for b in bins[:-1]), 1.0]
    observed, expected = merge_low([b["count"] for b in bins], [n * (y - x) for x, y in zip(at, at[1:], strict=False)])
    dof = len(observed) - 1 - len(params)
    if dof < 1:
        raise ValueError("too few bins for its parameters")
    statistic = sum((o - e) ** 2 / e for o, e in zip(observed, expected, strict=True))
    return statistic, linalg.chi2_sf(statistic, dof)


def _monte_carlo(name: str, x: np.ndarray) -> tuple[float, float, tuple[float, ...]]:
    rng = np.random.default_rng(0)
    params = linalg.fit_distribution(name, linalg.stats_of(x))
    statistic, worse = linalg.ks(name, x, params), 0
    for _ in range(MC_RESAMPLES):
        y = linalg.sample_of(name, params, len(x), rng)
        worse += linalg.ks(name, y, linalg.fit_distribution(name, linalg.stats_of(y))) >= statistic
    return statistic, (worse + 1) / (MC_RESAMPLES + 1), params


def fit_distributions(df: DataFrame, column: str, bins: int = 10, method: str | None = None) -> DataFrame:
    """(distribution, statistic, p_value, parameters, skipped): best p-value first. Lognormal and gamma need positive values."""
    bars = histogram(df, column, bins).collect()
    x = col(column).cast("double")
    logs = F.when(x > 0, F.ln(x))
    got = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(logs).alias("log_mean"), F.stddev_pop(logs).alias("log_std")).first()
    if got["n"] < LEAST_ROWS:
        raise StepError(f"a fit needs {LEAST_ROWS} values")
    sample = None
    if fit_method(method) == "monte_carlo":
        # By value and count, and not by row, so that the sample doesn't depend on how rows are dealt to tasks.
        counts = df.where(x.isNotNull()).groupBy(x.alias("x")).count()
        copies = counts.select("x", F.explode(F.sequence(F.lit(1), F.least("count", F.lit(MC_ROWS)).cast("int"))).alias("copy"))
        rows = copies.orderBy(F.xxhash64("x", "copy"), "x", "copy").limit(MC_ROWS).collect()
        sample = np.array([r["x"] for r in rows])
    out = []
    for name in linalg.CANDIDATES:
        try:
            if name in ("lognormal", "gamma") and got["min"] <= 0:
                raise ValueError("it needs positive values")
            if sample is not None:
                statistic, p, params = _monte_carlo(name, sample)
            else:
                params = linalg.fit_distribution(name, got.asDict())
                statistic, p = _chi2(name, params, bars)
            named = ", ".join(f"{k}={v:.6g}" for k, v in zip(linalg.PARAMETERS[name], params, strict=True))
            out.append((name, float(statistic), float(p), named, None))
        except (ValueError, ZeroDivisionError) as problem:
            out.append((name, None, None, None, str(problem)))
    out.sort(key=lambda r: (r[2] is None, -(r[2] or 0), r[1] or 0))
    return _rows(df, out, "distribution string, statistic double, p_value double, parameters string, skipped string")
