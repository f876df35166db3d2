"""Readers, writers and the path sandbox."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vframe.operators.apply import col

# Formats, and the suffixes that name them.
FORMATS = ("csv", "parquet")
SUFFIXES = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet", ".py": "py", "": "csv"}

#: Kinds of CSV columns by what all their values look like; what looks like none of them is text.
CSV_KINDS = {"bigint": r"^[+-]?\d{1,18}$", "double": r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+|NaN|inf|-inf)$", "boolean": "^(true|false)$"}
#: Names and rows of a source that a name is made from.
HEAD_COLUMNS, HEAD_ROWS = 15, 5


def shared_path(spark: SparkSession) -> str:
    """A new name in the folder that executors share, spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="vframe-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/vframe-{uuid.uuid4().hex}"


def read(spark: SparkSession, path: str, fmt: str = "csv", schema: str | None = None) -> DataFrame:
    """A table of a known format. CSV columns become long, double or boolean where every value reads so; dates stay text."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    if fmt == "parquet":
        return spark.read.parquet(path)
    if schema:
        return spark.read.schema(schema).csv(path, header=True)
    text = spark.read.csv(path, header=True)
    if not text.columns:
        return text
    tests = CSV_KINDS
    fits = [F.coalesce(F.bool_and(col(c).rlike(p)), F.lit(False)).alias(f"{i}_{t}") for i, c in enumerate(text.columns) for t, p in tests.items()]
    got = text.agg(*fits).first()
    typed = [col(c).cast(next((t for t in tests if got[f"{i}_{t}"]), "string")).alias(c) for i, c in enumerate(text.columns)]
    return text.select(*typed)


def resolve_format(path: str, fmt: str | None = None) -> str:
    """The format asked for, else that of the suffix; no suffix means csv."""
    found = fmt.lower() if fmt else SUFFIXES.get(Path(path).suffix.lower())
    if found not in (*FORMATS, "py"):
        raise ValueError(f"unknown format of {path!r}")
    return found


def write(df: DataFrame, path: str, fmt: str | None = None, single: bool = False) -> None:
    """Write a folder of part files, by all tasks.

    ``single`` writes one file of the name ``path`` instead, folders above it made where they lack; it is for results of a known small
    size, as one task writes it.
    """
    kind = resolve_format(path, fmt)
    place = f"{path}.parts-{uuid.uuid4().hex}" if single else path
    out = (df.coalesce(1) if single else df).write.mode("overwrite")
    out.csv(place, header=True) if kind == "csv" else out.parquet(place)
    if not single:
        return
    context = df.sparkSession.sparkContext
    paths = context._jvm.org.apache.hadoop.fs.Path
    folder, target = paths(place), paths(path)
    files = folder.getFileSystem(context._jsc.hadoopConfiguration())
    parts = [f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-")]
    files.delete(target, True)
    files.rename(parts[0], target)
    files.delete(folder, True)


def head(df: DataFrame) -> tuple[list[str], list[dict]]:
    """The first columns' names and a few rows of them, for naming a dataset; one short scan."""
    names = df.columns[:HEAD_COLUMNS]
    return names, [r.asDict() for r in df.select(*[col(c) for c in names]).limit(HEAD_ROWS).collect()]


def within(root: str, path: str) -> Path | None:
    """``path`` inside ``root``, or None where it leads out."""
    base = Path(root).resolve()
    full = (base / path).resolve()
    return full if full == base or base in full.parents else None


def listing(folder: str, cap: int = 200) -> tuple[list[tuple[str, bool, str]], int]:
    """(name, is_folder, size) of at most ``cap`` entries, folders first, and how many there are."""

    def sized(n: float) -> str:
        for unit in ("B", "KB", "MB", "GB"):
            if n < 1024:
                return f"{n:.0f}B" if unit == "B" else f"{n:.1f}{unit}"
            n /= 1024
        return f"{n:.1f}TB"

    found = sorted(os.scandir(folder), key=lambda e: (not e.is_dir(), e.name.lower()))
    return [(e.name, e.is_dir(), "" if e.is_dir() else sized(e.stat().st_size)) for e in found[:cap]], len(found)
