"""Apply fitted steps: pure frame-to-frame functions that never compute a statistic."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vframe.functions import exprs
from vframe.plans.specs import Step, StepError

Op = Callable[[DataFrame], DataFrame]
#: Longer maps are joined rather than written into the plan.
LITERAL_MAP = 200


def col(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def _mapped(df: DataFrame, key: Column, pairs: list[list] | str, out: str) -> DataFrame:
    """``df`` with the value of a frozen map, or of the stored table of that name, in column ``out``; null where it has none."""
    if isinstance(pairs, str):
        side = df.sparkSession.read.parquet(pairs).select(F.col("k").alias("_map_key"), F.col("v").alias(out))
        return df.join(side, key == side["_map_key"], "left").drop("_map_key")
    pairs = [p for p in pairs if p[0] is not None]
    if len(pairs) <= LITERAL_MAP:
        if not pairs:
            return df.withColumn(out, F.lit(None))
        value = reduce(lambda c, p: c.when(key == F.lit(p[0]), F.lit(p[1])), pairs[1:], F.when(key == F.lit(pairs[0][0]), F.lit(pairs[0][1])))
        return df.withColumn(out, value)
    side = df.sparkSession.createDataFrame([tuple(p) for p in pairs], ["_map_key", out])
    return df.join(side, key == side["_map_key"], "left").drop("_map_key")


def _fill(params: dict) -> Op:
    def op(df: DataFrame) -> DataFrame:
        names = df.columns
        out: dict[str, Column] = {}
        wide = df
        for i, fill in enumerate(params["fills"]):
            name, value = fill["column"], fill.get("value", fill.get("global_stat"))
            choices = [col(name)]
            if fill.get("group_col"):
                key = col(fill["group_col"])
                if fill.get("group_breaks") is not None:
                    key = exprs.bin_index(key, fill["group_breaks"])
                wide = _mapped(wide, key, fill.get("group_table") or fill["group_map"], f"_fill{i}")
                choices.append(F.col(f"_fill{i}"))
            if value is not None:
                choices.append(F.lit(value))
            out[name] = F.coalesce(*choices) if len(choices) > 1 else choices[0]
        flags = [col(source).isNull().cast("tinyint").alias(name) for source, name in params["indicators"]]
        filled = wide.select(*[out.get(c, col(c)).alias(c) for c in names], *flags)
        return filled.where(reduce(lambda a, b: a & b, [col(c).isNotNull() for c in params["delete_columns"]])) if params["delete_columns"] else filled

    return op


def _encode(params: dict) -> Op:
    def op(df: DataFrame) -> DataFrame:
        wide, labels, dummies = df, {}, []
        for i, spec in enumerate(params["specs"]):
            name = spec["column"]
            if spec["type"] == "label":
                wide = _mapped(wide, col(name), spec.get("mapping_table") or spec["mapping"], f"_label{i}")
                labels[name] = F.col(f"_label{i}").cast("long")
            else:
                dummies += [(col(name) == F.lit(v)).alias(n) for v, n in spec["values"]]
        kept = [labels.get(c, col(c)).alias(c) for c in df.columns if c not in params["drop_columns"]]
        return wide.select(*kept, *dummies)

    return op


def _filter(params: dict) -> Op:
    pred = exprs.condition(params["groups"], params["group_logic"])
    # The bare predicate and its negation reach the scan; coalesce(pred, false) would not.
    return lambda df: df.where(pred if params["action"] == "keep" else ~pred | pred.isNull())


def _project(params: dict) -> Op:
    def component(c: dict) -> Column:
        terms = [F.lit(w) * col(n).cast("double") for n, w in zip(params["numeric_cols"], c["weights"], strict=True) if w != 0]
        return reduce(lambda a, b: a + b, terms, F.lit(c["bias"]))

    made = [component(c).alias(n) for c, n in zip(params["components"], params["out_cols"], strict=True)]
    kept = [c for c in params["final_cols"] if c not in params["out_cols"]]
    known = lambda df: df.where(col(params["target"]).isNotNull()) if params.get("target") else df
    return lambda df: known(df).select(*[col(c) for c in kept], *made)


def _mono(params: dict) -> Op:
    options = ("base", "exponent", "a", "b")
    made = {s["output_name"]: exprs.unary(col(s["column"]), s["method"], **{k: s[k] for k in options if k in s}) for s in params["specs"]}
    return lambda df: df.withColumns(made)


def op_of(step: Step) -> Op:
    """The frame-to-frame function of a fitted step."""
    p = step.params
    match step.kind:
        case "fill_missing":
            return _fill(p)
        case "encode":
            return _encode(p)
        case "standardize":
            return lambda df: df.withColumns({s["column"]: exprs.ieee_div(col(s["column"]) - F.lit(s["mean"]), F.lit(s["std"])) for s in p["stats"]})
        case "drop_columns":
            return lambda df: df.drop(*p["columns"])
        case "filter_rows":
            return _filter(p)
        case "create_indicator":
            pred = F.coalesce(exprs.condition(p["groups"], p["group_logic"]), F.lit(False))
            return lambda df: df.withColumn(p["output_name"], pred.cast("tinyint"))
        case "dim_reduct":
            return _project(p)
        case "transform_mono":
            return _mono(p)
        case "transform_combination":
            made = exprs.combine([col(c) for c in p["columns"]], p["method"])
            return lambda df: df.withColumn(p["output_name"], made)
    raise StepError(f"a {step.kind} step has no parent to apply to")
