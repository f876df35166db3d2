"""Frozen chains over streams: applying a fitted step is stateless, so it holds for unbounded tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from vframe.operators.apply import op_of
from vframe.plans.specs import Step


def apply_chain(stream: DataFrame, steps: Iterable[Step]) -> DataFrame:
    """A stream (or table) with every step applied in order."""
    for step in steps:
        stream = stream.transform(op_of(step))
    return stream
