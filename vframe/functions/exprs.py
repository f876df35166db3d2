"""Column expressions with IEEE arithmetic and three-valued conditions, the same under any ANSI setting."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
UNARY = ("cos", "sin", "tan", "exp", "log", "sqrt", "square", "power", "linear", "reciprocal", "abs")
COMBINE = ("product", "sum", "mean", "difference", "ratio")
COMPARISONS = ("gt", "lt", "ge", "le", "eq", "ne", "is_null", "is_not_null")


def ieee_div(a: Column, b: Column) -> Column:
    """a / b in doubles: x/0 is an infinity by the signs of x and of the zero, 0/0 is NaN, null stays null."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))  # the power of a zero is an infinity of its sign


def ieee_log(x: Column, base: float | None = None) -> Column:
    """Logarithm with -Inf at zero and NaN below."""
    x = x.cast("double")
    out = F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN))
    return out if base is None else out / F.lit(math.log(base))


def unary(x: Column, method: str, *, base: float | None = None, exponent: float = 2.0, a: float = 1.0, b: float = 0.0) -> Column:
    """One of UNARY over a numeric column."""
    x = x.cast("double")
    match method:
        case "cos" | "sin" | "tan" | "exp" | "sqrt" | "abs":
            return getattr(F, method)(x)
        case "log":
            return ieee_log(x, base)
        case "square":
            return x * x
        case "power":
            return F.pow(x, F.lit(float(exponent)))
        case "linear":
            return F.lit(float(a)) * x + F.lit(float(b))
        case "reciprocal":
            return ieee_div(F.lit(1.0), x)
    raise ValueError(f"unknown method {method!r}; one of {', '.join(UNARY)}")


def combine(columns: list[Column], method: str) -> Column:
    """One of COMBINE over numeric columns, from left to right; null if any is null."""
    columns = [c.cast("double") for c in columns]
    match method:
        case "product":
            return reduce(lambda a, b: a * b, columns)
        case "sum":
            return reduce(lambda a, b: a + b, columns)
        case "mean":
            return reduce(lambda a, b: a + b, columns) / F.lit(float(len(columns)))
        case "difference":
            return reduce(lambda a, b: a - b, columns)
        case "ratio":
            return reduce(ieee_div, columns)
    raise ValueError(f"unknown method {method!r}; one of {', '.join(COMBINE)}")


def compare(x: Column, op: str, value: object = None) -> Column:
    """One of COMPARISONS; null compares as unknown."""
    tests = {
        "gt": lambda: x > value, "lt": lambda: x < value, "ge": lambda: x >= value, "le": lambda: x <= value,
        "eq": lambda: x == value, "ne": lambda: x != value, "is_null": x.isNull, "is_not_null": x.isNotNull,
    }
    return tests[op]()


def condition(groups: list[dict], group_logic: str = "and") -> Column:
    """A two-level tree of comparisons: each group folds by its logic, the groups by ``group_logic``."""
    join = {"and": lambda a, b: a & b, "or": lambda a, b: a | b}
    folded = [
        reduce(join[g.get("logic", "and")], [compare(F.col(f"`{c['column']}`"), c["op"], c.get("value")) for c in g["conditions"]])
        for g in groups
    ]
    return reduce(join[group_logic], folded)


def bin_index(x: Column, edges: list[float]) -> Column:
    """Right-closed bin: how many interior edges lie below x; null stays null."""
    counts = [F.when(x > F.lit(float(e)), 1).otherwise(0) for e in edges]
    return F.when(x.isNotNull(), reduce(lambda a, b: a + b, counts, F.lit(0)))
