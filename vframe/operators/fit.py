"""Fit steps: check the request, take the statistics, freeze them in a step."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vframe.functions import exprs
from vframe.operators.apply import col
from vframe.operators import linalg
from vframe.operators.ranks import median_of, order_statistics
from vframe.plans.specs import Step, StepError
from vframe.sources.io import shared_path

ZERO = {"numeric": 0, "string": "0", "boolean": False}
#: Entries of a map that a step holds itself; a longer one is a Parquet table that it names.
MAP_LIMIT = 100_000
#: Columns that one-hot makes of one column, at most: a schema is held on the driver.
DUMMY_LIMIT = 10_000


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "numeric"
    return {"string": "string", "boolean": "boolean"}.get(dtype.typeName(), "other")


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def unknown(df: DataFrame, names: list[str]) -> list[str]:
    return [f"no column {n!r}" for n in dict.fromkeys(names) if n not in df.columns]


def _plain(value: object) -> object:
    return float(value) if hasattr(value, "as_tuple") else value


def _raise(problems: list[str]) -> None:
    if problems:
        raise StepError(*problems)


def breaks(low: float | None, high: float | None, bins: int) -> list[float] | None:
    """Interior edges of equal-width bins; None where there is nothing to cut."""
    if low is None or low == high:
        return None
    return [low + i * (high - low) / bins for i in range(1, bins)]


def _mode(df: DataFrame, name: str) -> object:
    """The most frequent value that isn't null, the smallest on ties."""
    top = df.where(col(name).isNotNull()).groupBy(col(name).alias("v")).count().orderBy(F.desc("count"), "v").first()
    return _plain(top["v"]) if top else None


def fill_missing(df: DataFrame, pairs: list[dict]) -> Step:
    """Fill or delete nulls: each pair has column, action (zero, avg, median, mode, delete) and optionally
    add_indicator, group_by and group_bins. NaN is not null. One aggregate job fits all global statistics."""
    types, problems = kinds(df), unknown(df, [x for p in pairs for x in (p["column"], p.get("group_by")) if x])
    names = [p["column"] for p in pairs]
    problems += [f"{n!r} is named twice" for n in dict.fromkeys(names) if names.count(n) > 1]
    for p in pairs if not problems else []:
        name, action, by, bins = p["column"], p["action"], p.get("group_by"), p.get("group_bins")
        if action not in ("zero", "avg", "median", "mode", "delete"):
            problems.append(f"unknown action {action!r}")
        if action in ("avg", "median") and types[name] != "numeric":
            problems.append(f"{action} needs a numeric column, {name!r} is not")
        if by == name:
            problems.append(f"{name!r} can't be grouped by itself")
        if bins is not None and (bins < 2 or by and types[by] != "numeric"):
            problems.append("group_bins needs a numeric group column and at least 2 bins")
        if p.get("add_indicator") and f"{name}_is_missing" in df.columns:
            problems.append(f"{name}_is_missing is taken")
    _raise(problems)

    stats = []
    for i, p in enumerate(pairs):
        c = col(p["column"])
        stats.append(F.count_if(c.isNull()).alias(f"nulls{i}"))
        if p["action"] in ("avg", "median"):
            stats.append((F.avg(c) if p["action"] == "avg" else F.count(c)).cast("double").alias(f"stat{i}"))
        if p.get("group_by") and p.get("group_bins"):
            stats += [F.min(col(p["group_by"])).cast("double").alias(f"low{i}"), F.max(col(p["group_by"])).cast("double").alias(f"high{i}")]
    got = df.agg(*stats).first().asDict()
    middle = {p["column"]: int(got[f"stat{i}"]) for i, p in enumerate(pairs) if p["action"] == "median"}
    at = order_statistics(df, {c: [(n - 1) // 2, n // 2] for c, n in middle.items() if n}, middle) if any(middle.values()) else {}
    for i, p in enumerate(pairs):
        if p["action"] == "median":
            got[f"stat{i}"] = median_of(at.get(p["column"], [None, None]))

    fills, indicators, deletes = [], [], []
    for i, p in enumerate(pairs):
        name, action = p["column"], p["action"]
        if p.get("add_indicator") and action != "delete" and got[f"nulls{i}"]:
            indicators.append([name, f"{name}_is_missing"])
        if action == "delete":
            deletes.append(name)
        elif action == "zero":
            if types[name] in ZERO:
                fills.append({"column": name, "type": "zero", "value": ZERO[types[name]]})
        else:
            stat = _mode(df, name) if action == "mode" else got[f"stat{i}"]
            fill = {"column": name, "type": {"avg": "mean"}.get(action, action), "global_stat": stat}
            if p.get("group_by"):
                cuts = breaks(got[f"low{i}"], got[f"high{i}"], p["group_bins"]) if p.get("group_bins") else None
                fill |= {"group_col": p["group_by"], "group_breaks": cuts} | _group_stats(df, name, action, p["group_by"], cuts)
            if stat is not None:
                fills.append(fill)
    return Step("fill_missing", {"indicators": indicators, "fills": fills, "delete_columns": deletes})


def _group_stats(df: DataFrame, name: str, action: str, by: str, cuts: list[float] | None) -> dict:
    """The statistic of each group as a map, or as the name of a table where it is long."""
    key = exprs.bin_index(col(by), cuts) if cuts is not None else col(by)
    rows = df.select(key.alias("k"), col(name).alias("v")).where("k is not null and v is not null")
    if action == "mode":
        counts = rows.groupBy("k", "v").count()
        stats = counts.groupBy("k").agg(F.min(F.struct((-F.col("count")).alias("n"), "v")).alias("s")).select("k", F.col("s.v").alias("s"))
    else:
        stats = rows.groupBy("k").agg((F.avg("v") if action == "avg" else F.median("v")).cast("double").alias("s"))
    found = stats.limit(MAP_LIMIT + 1).collect()
    if len(found) > MAP_LIMIT:
        return {"group_table": _stored(stats.withColumnRenamed("s", "v"))}
    return {"group_map": sorted(([_plain(r["k"]), _plain(r["s"])] for r in found), key=lambda p: p[0])}


def _stored(pairs: DataFrame) -> str:
    """Write a map (k, v) as a table that all executors share, and give its name."""
    path = shared_path(pairs.sparkSession)
    pairs.write.parquet(path)
    return path


def _codes(values: DataFrame) -> tuple[str, int]:
    """Codes of many values (k) in their order, as a stored table (k, v), and how many there are: ranks within sorted ranges plus the ranges' starts."""
    spark, path = values.sparkSession, shared_path(values.sparkSession)
    parts = values.orderBy("k").select("k", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    parts.write.parquet(path)
    ranked = spark.read.parquet(path)
    starts, total = [], 0
    for r in ranked.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first")).orderBy("part").collect():  # one for each range
        starts.append((r["part"], total - r["first"]))
        total += r["n"]
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, shift long"))
    return _stored(ranked.join(offsets, "part").select("k", (F.col("at") + F.col("shift")).alias("v"))), total


def encode(df: DataFrame, pairs: list[tuple[str, str]], first_category: str = "lexical", order_by: str | None = None) -> Step:
    """One-hot (drop first) or label codes. The category that one-hot drops is the smallest, or with
    ``first_category="appearance"`` the one that comes first by ``order_by``."""
    problems = unknown(df, [n for n, _ in pairs]) + [f"unknown action {a!r}" for _, a in pairs if a not in ("one_hot", "label")]
    if first_category == "appearance" and order_by not in df.columns:
        problems.append("appearance needs order_by, a column")
    _raise(problems)
    specs, drop = [], []
    for name, action in pairs:
        rows = df.where(col(name).isNotNull()).groupBy(col(name).alias("v"))
        first = F.min(col(order_by)) if first_category == "appearance" and order_by else F.lit(0)
        most = MAP_LIMIT if action == "label" else DUMMY_LIMIT
        found = rows.agg(first.alias("at")).orderBy("v").limit(most + 1).collect()
        values = [_plain(r["v"]) for r in found]
        if len(found) > most and action == "label":
            path, size = _codes(rows.agg(F.lit(0)).select(F.col("v").alias("k")))
            specs.append({"column": name, "type": "label", "mapping_table": path, "size": size})
        elif len(found) > most:
            raise StepError(f"one-hot would make more than {most} columns of {name!r}")
        elif action == "label":
            specs.append({"column": name, "type": "label", "mapping": [[v, i] for i, v in enumerate(values)]})
        else:
            if found:
                values.remove(_plain(min(found, key=lambda r: r["at"])["v"]))
            made = [[v, f"{name}_{str(v).lower() if isinstance(v, bool) else v}"] for v in values]
            _raise([f"{n!r} is taken" for _, n in made if n in df.columns])
            specs.append({"column": name, "type": "one_hot", "values": made})
            drop.append(name)
    return Step("encode", {"specs": specs, "drop_columns": drop})


def standardize(df: DataFrame, columns: list[str]) -> Step:
    """z-scores in place with the sample deviation; numeric columns without nulls."""
    columns = list(dict.fromkeys(columns))
    problems = unknown(df, columns)
    problems += [f"{c!r} isn't numeric" for c in columns if kinds(df).get(c, "numeric") != "numeric"]
    _raise(problems or ([] if columns else ["no column is named"]))
    got = df.agg(*[f for c in columns for f in (F.avg(col(c)).cast("double").alias(f"m_{c}"), F.stddev_samp(col(c)).alias(f"s_{c}"), F.count_if(col(c).isNull()).alias(f"n_{c}"))]).first()
    _raise([f"{c!r} has nulls" for c in columns if got[f"n_{c}"]])
    return Step("standardize", {"stats": [{"column": c, "mean": got[f"m_{c}"], "std": got[f"s_{c}"]} for c in columns]})


def drop_columns(df: DataFrame, columns: list[str]) -> Step:
    columns = list(dict.fromkeys(columns))
    _raise(unknown(df, columns) or ([] if columns else ["no column is named"]))
    return Step("drop_columns", {"columns": columns})


def _check_conditions(df: DataFrame, groups: list[dict], group_logic: str) -> list[str]:
    types, problems = kinds(df), [] if groups else ["no condition group"]
    if group_logic not in ("and", "or"):
        problems.append(f"unknown logic {group_logic!r}")
    fits = {"numeric": lambda v: type(v) in (int, float), "string": lambda v: type(v) is str, "boolean": lambda v: type(v) is bool}
    for g in groups:
        if g.get("logic", "and") not in ("and", "or"):
            problems.append(f"unknown logic {g['logic']!r}")
        if not g.get("conditions"):
            problems.append("a group has no condition")
        for c in g.get("conditions", []):
            name, op = c["column"], c["op"]
            if name not in types:
                problems.append(f"no column {name!r}")
            elif op not in exprs.COMPARISONS:
                problems.append(f"unknown comparison {op!r}")
            elif op not in ("is_null", "is_not_null") and not fits.get(types[name], lambda v: False)(c.get("value")):
                problems.append(f"{c.get('value')!r} can't be compared with {name!r}, which is {types[name]}")
    return problems


def filter_rows(df: DataFrame, groups: list[dict], group_logic: str = "and", action: str = "keep") -> Step:
    """Keep the rows where the condition is true, or delete them; where it is unknown, delete spares them."""
    _raise(_check_conditions(df, groups, group_logic) + ([] if action in ("keep", "delete") else [f"unknown action {action!r}"]))
    return Step("filter_rows", {"groups": groups, "group_logic": group_logic, "action": action})


def create_indicator(df: DataFrame, groups: list[dict], group_logic: str, output_name: str) -> Step:
    """A 0/1 column from a condition; unknown counts as 0."""
    taken = [f"{output_name!r} is empty or taken"] if not output_name.strip() or output_name in df.columns else []
    _raise(_check_conditions(df, groups, group_logic) + taken)
    return Step("create_indicator", {"groups": groups, "group_logic": group_logic, "output_name": output_name})


def mono_name(spec: dict) -> str:
    """The default name of a transformed column."""
    prefix = spec["method"]
    if prefix == "power":
        prefix += f"{float(spec.get('exponent', 2.0)):g}".replace(".", "_")
    return f"{prefix}_{spec['column']}"


def transform_mono(df: DataFrame, specs: list[dict]) -> Step:
    """Append a unary function of a numeric column for each spec."""
    problems, taken, done = unknown(df, [s["column"] for s in specs]), set(df.columns), []
    for s in specs:
        if s["method"] not in exprs.UNARY:
            problems.append(f"unknown method {s['method']!r}")
        if kinds(df).get(s["column"], "numeric") != "numeric":
            problems.append(f"{s['column']!r} isn't numeric")
        name = s.get("output_name") or mono_name(s)
        if name in taken:
            problems.append(f"{name!r} is taken")
        taken.add(name)
        done.append({k: v for k, v in s.items() if v is not None} | {"output_name": name})
    _raise(problems or ([] if specs else ["no transformation is named"]))
    return Step("transform_mono", {"specs": done})


def transform_combination(df: DataFrame, columns: list[str], method: str, output_name: str) -> Step:
    """Append an n-ary combination of numeric columns."""
    columns = list(dict.fromkeys(columns))
    problems = unknown(df, columns) + [f"{c!r} isn't numeric" for c in columns if kinds(df).get(c, "numeric") != "numeric"]
    if len(columns) < 2:
        problems.append("at least two columns are needed")
    if method not in exprs.COMBINE:
        problems.append(f"unknown method {method!r}")
    if not output_name.strip() or output_name in df.columns:
        problems.append(f"{output_name!r} is empty or taken")
    _raise(problems)
    return Step("transform_combination", {"columns": columns, "method": method, "output_name": output_name})


def _moments(df: DataFrame, names: list[str], by: str | None = None) -> list:
    """Counts, sums of columns and of products, by class; one job."""
    x = [col(n).cast("double") for n in names]
    sums = [F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)]]
    sums += [F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    return (df.groupBy(col(by).alias("k")).agg(*sums).orderBy("k") if by else df.agg(*sums)).collect()


def _unpacked(row, p: int) -> tuple[int, np.ndarray, np.ndarray]:
    cov = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    return row["n"], np.array([row[f"m{i}"] for i in range(p)], float), cov


def dim_reduct(df: DataFrame, method: str, n_components: int, target: str | None = None, standardize: bool = True, columns: list[str] | None = None) -> Step:
    """PCA over all numeric columns, or LDA towards a target; aggregates in the engine, eigenvectors on the driver."""
    types = kinds(df)
    names = columns or [c for c in df.columns if types[c] == "numeric" and not (method == "lda" and c == target)]
    problems = unknown(df, names + ([target] if target else []))
    if method not in ("pca", "lda"):
        problems.append(f"unknown method {method!r}")
    if method == "lda" and not target:
        problems.append("lda needs a target")
    if not names:
        problems.append("no numeric column")
    _raise(problems)
    bad = df.agg(*[F.count_if(col(n).isNull() | F.isnan(col(n).cast("double"))).alias(n) for n in names]).first()
    _raise([f"{n!r} has nulls or NaN" for n in names if bad[n]])
    if method == "pca":
        _raise([] if 1 <= n_components <= len(names) else [f"n_components must be 1 to {len(names)}"])
        n, mean, cov = _unpacked(_moments(df, names)[0], len(names))
        weights, biases, ratio = linalg.pca(n, mean, cov, n_components, standardize)
    else:
        rows = _moments(df.where(col(target).isNotNull()), names, target)
        most = min(len(rows) - 1, len(names))
        _raise([] if len(rows) >= 2 and 1 <= n_components <= most else [f"lda needs 2 classes and n_components of 1 to {most}"])
        weights, biases, ratio = linalg.lda([_unpacked(r, len(names)) for r in rows], n_components, standardize)
    made = [f"{'pc' if method == 'pca' else 'ld'}{i + 1}" for i in range(n_components)]
    kept = [c for c in df.columns if c not in names]
    _raise([f"{m!r} is taken" for m in made if m in kept])
    parts = [{"bias": float(b), "weights": [float(x) for x in w]} for w, b in zip(weights, biases, strict=True)]
    return Step("dim_reduct", {"method": method, "components": parts, "numeric_cols": names, "out_cols": made, "final_cols": kept + made, "explained": [round(float(r), 6) for r in ratio]} | ({"target": target} if method == "lda" else {}))
