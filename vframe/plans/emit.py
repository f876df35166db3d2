"""Write a chain of steps as a stand-alone PySpark script: plain code for each step, with its constants as exact literals.

The script imports PySpark alone, so that it runs where this package isn't installed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from vframe.plans.specs import Node, Step, StepError

HEADER = '''"""Rebuilds one version of a dataset from its source; written by vframe."""

import math

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def divided(a, b):
    """a / b in doubles, with infinities and NaN at zero."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def logarithm(x):
    """Natural logarithm, -Inf at zero and NaN below."""
    x = x.cast("double")
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN))


def bin_of(x, edges):
    """How many edges lie below x."""
    out = F.lit(0)
    for edge in edges:
        out = out + F.when(x > F.lit(edge), 1).otherwise(0)
    return F.when(x.isNotNull(), out)


def looked_up(df, key, pairs, name):
    """df with the value of a map, or of a stored table (k, v), in a new column."""
    if not pairs:
        return df.withColumn(name, F.lit(None))
    side = (spark.read.parquet(pairs) if isinstance(pairs, str) else spark.createDataFrame(pairs, ["k", "v"])).toDF("map_key", name)
    return df.join(side, key == side["map_key"], "left").drop("map_key")


def typed(text):
    """CSV columns as long, double or boolean where every value reads so."""
    tests = {"bigint": INTEGERS, "double": NUMBERS, "boolean": BOOLEANS}
    fits = text.agg(*[F.coalesce(F.bool_and(F.col(f"`{c}`").rlike(p)), F.lit(False)).alias(f"{i}_{t}") for i, c in enumerate(text.columns) for t, p in tests.items()]).first()
    kinds = [next((t for t in tests if fits[f"{i}_{t}"]), "string") for i in range(len(text.columns))]
    return text.select(*[F.col(f"`{c}`").cast(k).alias(c) for c, k in zip(text.columns, kinds)])


spark = SparkSession.builder.getOrCreate()
'''


def literal(value: object) -> str:
    """A value as Python text that reads back as the same value."""
    if isinstance(value, float) and not math.isfinite(value):
        return "NAN" if math.isnan(value) else "INF" if value > 0 else "-INF"
    if isinstance(value, (list, tuple)):
        inner = ", ".join(map(literal, value))
        return f"[{inner}]" if isinstance(value, list) else f"({inner},)"
    return repr(value)


def _col(name: str) -> str:
    return f"F.col({'`' + name.replace('`', '``') + '`'!r})"


def _pairs(pairs: list[list]) -> str:
    return literal([tuple(p) for p in pairs if p[0] is not None])


def _fill(p: dict) -> list[str]:
    lines = ["names = df.columns"]
    filled: dict[str, str] = {}
    for i, f in enumerate(p["fills"]):
        choices = [_col(f["column"])]
        if f.get("group_col"):
            key = _col(f["group_col"])
            if f.get("group_breaks") is not None:
                key = f"bin_of({key}, {literal(f['group_breaks'])})"
            pairs = repr(f["group_table"]) if f.get("group_table") else _pairs(f["group_map"])
            lines.append(f"df = looked_up(df, {key}, {pairs}, 'fill_{i}')")
            choices.append(f"F.col('fill_{i}')")
        value = f.get("value", f.get("global_stat"))
        if value is not None:
            choices.append(f"F.lit({literal(value)})")
        filled[f["column"]] = f"F.coalesce({', '.join(choices)})"
    lines.append("filled = {" + ", ".join(f"{c!r}: {e}" for c, e in filled.items()) + "}")
    lines.append("flags = [" + ", ".join(f"{_col(c)}.isNull().cast('tinyint').alias({n!r})" for c, n in p["indicators"]) + "]")
    lines.append("df = df.select(*[filled.get(c, F.col(f'`{c}`')).alias(c) for c in names], *flags)")
    return lines + [f"df = df.where({_col(c)}.isNotNull())" for c in p["delete_columns"]]


def _encode(p: dict) -> list[str]:
    lines, labels, made = ["names = df.columns"], {}, []
    for i, s in enumerate(p["specs"]):
        if s["type"] == "label":
            pairs = repr(s["mapping_table"]) if "mapping_table" in s else _pairs(s["mapping"])
            lines.append(f"df = looked_up(df, {_col(s['column'])}, {pairs}, 'label_{i}')")
            labels[s["column"]] = f"F.col('label_{i}').cast('long')"
        else:
            made += [f"({_col(s['column'])} == F.lit({literal(v)})).alias({n!r})" for v, n in s["values"]]
    lines.append("labels = {" + ", ".join(f"{c!r}: {e}" for c, e in labels.items()) + "}")
    lines.append(f"kept = [labels.get(c, F.col(f'`{{c}}`')).alias(c) for c in names if c not in {literal(p['drop_columns'])}]")
    return [*lines, f"df = df.select(*kept, {', '.join(made)})" if made else "df = df.select(*kept)"]


def condition(groups: list[dict], logic: str) -> str:
    """A condition tree as code."""
    signs = {"gt": ">", "lt": "<", "ge": ">=", "le": "<=", "eq": "==", "ne": "!="}

    def one(c: dict) -> str:
        if c["op"] in signs:
            return f"({_col(c['column'])} {signs[c['op']]} {literal(c['value'])})"
        return f"{_col(c['column'])}.{'isNull' if c['op'] == 'is_null' else 'isNotNull'}()"

    join = {"and": " & ", "or": " | "}
    return "(" + join[logic].join("(" + join[g.get("logic", "and")].join(map(one, g["conditions"])) + ")" for g in groups) + ")"


def _mono(s: dict) -> str:
    x = f"{_col(s['column'])}.cast('double')"
    match s["method"]:
        case "log":
            return f"logarithm({x})" + (f" / F.lit(math.log({literal(s['base'])}))" if s.get("base") is not None else "")
        case "square":
            return f"{x} * {x}"
        case "power":
            return f"F.pow({x}, F.lit({literal(float(s.get('exponent', 2.0)))}))"
        case "linear":
            return f"F.lit({literal(float(s.get('a', 1.0)))}) * {x} + F.lit({literal(float(s.get('b', 0.0)))})"
        case "reciprocal":
            return f"divided(F.lit(1.0), {x})"
    return f"F.{s['method']}({x})"


def _combined(columns: list[str], method: str) -> str:
    terms = [f"{_col(c)}.cast('double')" for c in columns]
    if method == "ratio":
        out = terms[0]
        for term in terms[1:]:
            out = f"divided({out}, {term})"
        return out
    sign = {"product": " * ", "difference": " - "}.get(method, " + ")
    joined = "(" + sign.join(terms) + ")"
    return f"{joined} / F.lit({float(len(terms))})" if method == "mean" else joined


def _projected(p: dict) -> list[str]:
    out = []
    for c, name in zip(p["components"], p["out_cols"], strict=True):
        terms = [f"F.lit({literal(c['bias'])})"] + [f"F.lit({literal(w)}) * {_col(n)}.cast('double')" for n, w in zip(p["numeric_cols"], c["weights"], strict=True) if w != 0]
        out.append(f"({' + '.join(terms)}).alias({name!r})")
    kept = [_col(c) for c in p["final_cols"] if c not in p["out_cols"]]
    rows = [f"df = df.where({_col(p['target'])}.isNotNull())"] if p.get("target") else []
    return [*rows, f"df = df.select({', '.join(kept + out)})"]


CODE: dict[str, Callable[[dict], list[str]]] = {
    "fill_missing": _fill,
    "encode": _encode,
    "standardize": lambda p: [f"df = df.withColumn({s['column']!r}, divided({_col(s['column'])} - F.lit({literal(s['mean'])}), F.lit({literal(s['std'])})))" for s in p["stats"]],
    "drop_columns": lambda p: [f"df = df.drop({', '.join(map(repr, p['columns']))})"],
    "filter_rows": lambda p: [f"keep = {condition(p['groups'], p['group_logic'])}", "df = df.where(keep)" if p["action"] == "keep" else "df = df.where(~keep | keep.isNull())"],
    "create_indicator": lambda p: [f"df = df.withColumn({p['output_name']!r}, F.coalesce({condition(p['groups'], p['group_logic'])}, F.lit(False)).cast('tinyint'))"],
    "dim_reduct": _projected,
    "transform_mono": lambda p: ["df = df.withColumns({" + ", ".join(f"{s['output_name']!r}: {_mono(s)}" for s in p["specs"]) + "})"],
    "transform_combination": lambda p: [f"df = df.withColumn({p['output_name']!r}, {_combined(p['columns'], p['method'])})"],
}


def code(step: Step) -> list[str]:
    """The lines that apply a fitted step to ``df``."""
    if step.kind not in CODE:
        raise StepError(f"a {step.kind} step has no parent to apply to")
    return CODE[step.kind](step.params)


def source_code(step: Step) -> list[str]:
    """The lines that read a source into ``df``."""
    from vframe.sources.io import CSV_KINDS

    path = step.params["path"]
    if step.params["format"] == "parquet":
        return [f"df = spark.read.parquet({path!r})"]
    names = {"bigint": "INTEGERS", "double": "NUMBERS", "boolean": "BOOLEANS"}
    return [*[f"{names[k]} = {p!r}" for k, p in CSV_KINDS.items()], f"df = typed(spark.read.csv({path!r}, header=True))"]


def script(chain: list[Node], output: str | None = None, fmt: str = "csv") -> str:
    """The script of a chain from its source to the version to rebuild; without an output the line that writes is a comment."""
    if not chain or chain[0].step.kind != "source":
        raise StepError("a script starts at a source that can be read again")
    lines = [HEADER, *source_code(chain[0].step)]
    for n, node in enumerate(chain[1:], 1):
        lines += [f"\n# Step {n}: {node.step.kind}", *code(node.step)]
    write = f"df.write.mode('overwrite').{'csv' if fmt == 'csv' else 'parquet'}({output or 'output'!r}{', header=True' if fmt == 'csv' else ''})"
    return "\n".join([*lines, "", write if output else f"# {write}", ""])
