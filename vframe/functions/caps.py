"""Limits of what a report shows. Results themselves are never cut: what is left out is counted beside what is shown."""

from __future__ import annotations

from pyspark.sql import DataFrame

# What a report shows at most.
STRING, SCHEMA_COLUMNS, PREVIEW_COLUMNS, PAIRS, MAPPING, DUMMIES, COLUMN_LIST, ENTRIES, DESCRIBED = 200, 200, 60, 100, 50, 50, 100, 200, 100


def capped(items: list, limit: int) -> tuple[list, dict | None]:
    """The first ``limit`` items, and a note with truncated, shown and total where there are more."""
    note = {"truncated": True, "shown": limit, "total": len(items)} if len(items) > limit else None
    return items[:limit], note


def capped_rows(df: DataFrame, limit: int) -> tuple[list[dict], dict | None]:
    """The first rows of a result as dictionaries, and the same note; the rest is counted in the engine and never collected."""
    rows = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
    note = {"truncated": True, "shown": limit, "total": df.count()} if len(rows) > limit else None
    return rows[:limit], note
