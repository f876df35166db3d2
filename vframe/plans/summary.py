"""What a fitted step does, in words and numbers, for the one who asked for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vframe.functions.caps import COLUMN_LIST, DUMMIES, MAPPING, capped
from vframe.operators.apply import col, op_of
from vframe.plans.specs import Step

SIGNS = {"gt": ">", "lt": "<", "ge": ">=", "le": "<=", "eq": "=", "ne": "!=", "is_null": "is null", "is_not_null": "is not null"}


def in_words(groups: list[dict], logic: str = "and") -> str:
    """A condition tree as text; groups of several conditions stand in brackets."""

    def one(c: dict) -> str:
        value = c.get("value")
        shown = f" {value!r}" if isinstance(value, str) else f" {value}"
        return f"{c['column']} {SIGNS[c['op']]}" + ("" if c["op"].endswith("null") else shown)

    said = []
    for g in groups:
        text = f" {g.get('logic', 'and')} ".join(map(one, g["conditions"]))
        said.append(f"({text})" if len(g["conditions"]) > 1 else text)
    return f" {logic} ".join(said)


def _nulls(df: DataFrame, names: list[str]) -> dict[str, int]:
    """Null counts of columns and the number of rows (under an empty name), by one job."""
    names = list(dict.fromkeys(names))
    row = df.agg(F.count("*"), *[F.count_if(col(n).isNull()) for n in names]).first()
    return dict(zip(["", *names], row, strict=True))


def _fills(p: dict, before: DataFrame) -> list[dict]:
    fills, deletes, flags = p["fills"], p["delete_columns"], p["indicators"]
    names = [f["column"] for f in fills]
    was = _nulls(before, names + deletes + [c for c, _ in flags])
    now = _nulls(op_of(Step("fill_missing", p))(before), names)
    kept = _nulls(op_of(Step("fill_missing", p | {"delete_columns": []}))(before), names) if deletes else now
    out = []
    for f in fills:
        name = f["column"]
        method = {"mean": "avg"}.get(f["type"], f["type"])
        if f.get("group_col"):
            bins = f" in {len(f['group_breaks']) + 1} bins" if f.get("group_breaks") is not None else ""
            method += f" by {f['group_col']}{bins}"
        made = {"column": name, "method": method, "nulls_before": was[name], "nulls_filled": was[name] - kept[name]}
        out.append(made | ({"nulls_remaining": kept[name]} if kept[name] else {}))
    out += [{"column": c, "method": "delete", "nulls_before": was[c], "rows_deleted": was[""] - now[""]} for c in deletes]
    return out + [{"column": c, "indicator_column": made, "action": "add_indicator", "nulls_flagged": was[c]} for c, made in flags]


def _encodings(p: dict) -> list[dict]:
    out = []
    for s in p["specs"]:
        if s["type"] == "one_hot":
            shown, note = capped([n for _, n in s["values"]], DUMMIES)
            made = {"column": s["column"], "method": "one_hot", "new_columns": shown}
        elif "mapping_table" in s:
            shown, note = [], {"truncated": True, "shown": 0, "total": s["size"]}
            made = {"column": s["column"], "method": "label", "mapping": shown}
        else:
            shown, note = capped(s["mapping"], MAPPING)
            made = {"column": s["column"], "method": "label", "mapping": shown}
        out.append(made | (note or {}))
    return out


def of_step(step: Step, before: DataFrame) -> list[dict]:
    """One entry for each thing that a step does to a frame."""
    p = step.params
    match step.kind:
        case "fill_missing":
            return _fills(p, before)
        case "encode":
            return _encodings(p)
        case "standardize":
            return [dict(s) for s in p["stats"]]
        case "drop_columns":
            left, note = capped([c for c in before.columns if c not in p["columns"]], COLUMN_LIST)
            return [{"dropped": p["columns"], "remaining_columns": left} | (note or {})]
        case "filter_rows":
            return [{"action": p["action"], "condition": in_words(p["groups"], p["group_logic"])}]
        case "create_indicator":
            return [{"column": p["output_name"], "condition": in_words(p["groups"], p["group_logic"])}]
        case "dim_reduct":
            used, note = capped(p["numeric_cols"], COLUMN_LIST)
            return [{"method": p["method"], "new_columns": p["out_cols"], "explained": p["explained"], "original_features": used} | (note or {})]
        case "transform_mono":
            return [dict(s) for s in p["specs"]]
    return [dict(p)]
