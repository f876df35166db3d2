"""The version graph: immutable versions, branches, a head, and a bounded number of cached ones."""

from __future__ import annotations

import warnings
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vframe.operators import profile
from vframe.operators.apply import Op, op_of
from vframe.plans import emit, summary
from vframe.plans.ledger import Ledger
from vframe.plans.specs import Node, Step, StepError, dumps, loads
from vframe.sources import io


@dataclass
class Version:
    node: Node | None
    parent: int | None
    op: Op | None
    loader: Callable[[], DataFrame] | None
    description: str = ""
    pinned: bool = False


class VersionStore:
    """Versions of one dataset. Frames are lazy: a chain is one plan, and caching is a hint, never a result."""

    def __init__(self, spark: SparkSession, max_cached: int = 3, sink: Callable[[Node, str], None] | None = None) -> None:
        self.spark, self.max_cached, self.sink = spark, max_cached, sink
        self.versions: dict[int, Version] = {}
        self.frames: dict[int, DataFrame] = {}
        self.cached: OrderedDict[int, None] = OrderedDict()
        self.head: int | None = None

    def _known(self, v: int) -> Version:
        if v not in self.versions:
            raise KeyError(f"no version {v}")
        return self.versions[v]

    def _register(self, v: int, version: Version, tell: bool) -> int:
        self.versions[v], self.head = version, v
        if tell and self.sink and version.node:
            self.sink(version.node, version.description)
        return v

    def _next(self) -> int:
        return max(self.versions, default=-1) + 1

    def load(self, path: str, fmt: str = "csv") -> int:
        """Register a source that can be read again."""
        v = self._next()
        node = Node(v, Step("source", {"format": fmt, "path": path}))
        return self._register(v, Version(node, None, None, lambda: io.read(self.spark, path, fmt), "initial load", True), True)

    def add_source(self, loader: Callable[[], DataFrame], description: str = "", pinned: bool = True) -> int:
        """Register any frame as a source; it can't be restored elsewhere."""
        return self._register(self._next(), Version(None, None, None, loader, description, pinned), False)

    def derive(self, step: Step, parent: int | None = None, description: str = "") -> int:
        """A new version from a fitted step; it becomes the head."""
        parent = self.head if parent is None else parent
        self._known(parent)
        v = self._next()
        return self._register(v, Version(Node(v, step, (parent,)), parent, op_of(step), None, description), True)

    def derive_by(self, op: Op, parent: int | None = None, description: str = "") -> int:
        """A new version from any frame-to-frame function: not replayable elsewhere, so it is pinned."""
        parent = self.head if parent is None else parent
        self._known(parent)
        return self._register(self._next(), Version(None, parent, op, None, description, True), False)

    def get(self, v: int | None = None) -> DataFrame:
        v = self.head if v is None else v
        version = self._known(v)
        if v not in self.frames:
            self.frames[v] = version.loader() if version.loader else version.op(self.get(version.parent))
        if v in self.cached:
            self.cached.move_to_end(v)
        return self.frames[v]

    def cache(self, v: int | None = None) -> DataFrame:
        """Persist a version; the least recently used others that aren't pinned or the head make room."""
        v = self.head if v is None else v
        frame = self.get(v).persist()
        self.cached[v] = None
        self.cached.move_to_end(v)
        for old in [x for x in self.cached if x not in (v, self.head) and not self.versions[x].pinned]:
            if len(self.cached) <= self.max_cached:
                break
            self.frames[old].unpersist()
            del self.cached[old]
        if len(self.cached) > self.max_cached:
            warnings.warn(f"{len(self.cached)} versions are pinned or in use; {self.max_cached} should be cached at most", stacklevel=2)
        return frame

    def set_head(self, v: int) -> None:
        self._known(v)
        self.head = v

    def pin(self, v: int) -> None:
        self._known(v).pinned = True

    def unpin(self, v: int) -> None:
        if self._known(v).node is None:
            raise StepError(f"version {v} can't be made again, so it stays pinned")
        self.versions[v].pinned = False

    def chain(self, v: int) -> list[Node]:
        """The nodes from the source to a version."""
        out = []
        at: int | None = v
        while at is not None:
            version = self._known(at)
            if version.node is None:
                raise StepError(f"version {at} has no specification")
            out.append(version.node)
            at = version.parent
        return out[::-1]

    def listing(self) -> DataFrame:
        """(version, parent, kind, description, is_head, cached, pinned), ascending."""
        rows = [(v, x.parent, x.node.step.kind if x.node else "opaque", x.description, v == self.head, v in self.cached, x.pinned) for v, x in sorted(self.versions.items())]
        return self.spark.createDataFrame(rows, "version long, parent long, kind string, description string, is_head boolean, cached boolean, pinned boolean")

    def script(self, v: int | None = None, output: str | None = None, fmt: str = "csv") -> str:
        return emit.script(self.chain(self.head if v is None else v), output, fmt)

    def info(self, v: int | None = None) -> dict:
        """What is known of a version without computing it; an unknown version is refused."""
        v = self.head if v is None else v
        x = self._known(v)
        return {
            "version": v, "parent": x.parent, "kind": x.node.step.kind if x.node else "opaque", "description": x.description, "params": x.node.step.params if x.node else None,
            "children": sorted(c for c, y in self.versions.items() if y.parent == v), "is_head": v == self.head, "cached": v in self.cached, "pinned": x.pinned,
        }

    def commit(self, fitted: Callable[[DataFrame], Step], parent: int | None = None, description: str = "", rows: int = 5) -> dict:
        """Fit a step on a version and derive the next from it.

        Returns new_data_version, rows_before, rows_after, preview and summary (what the step did); a request that can't be fitted
        returns its problems under ``error`` and makes no version.
        """
        parent = self.head if parent is None else parent
        before = self.get(parent)
        try:
            step = fitted(before)
        except StepError as problem:
            return {"error": problem.problems}
        v = self.derive(step, parent, description)
        after = self.get(v)
        shown = summary.of_step(step, before)
        return {"new_data_version": v, "rows_before": before.count(), "rows_after": after.count(), "preview": profile.head_samples(after, rows), "summary": shown}

    def export(self, v: int, path: str, fmt: str | None = None, single: bool = False) -> dict:
        """Write a version's data, or with the format py its script; folders above it are made.

        Returns version, path, format, rows and cols (of the data; None for a script). ``single`` writes one file.
        """
        kind = io.resolve_format(path, fmt)
        if kind == "py":
            Path(path).parent.mkdir(parents=True, exist_ok=True)
            Path(path).write_text(self.script(v, path.removesuffix(".py") + ".csv"))
            return {"version": v, "path": path, "format": kind, "rows": None, "cols": None}
        df = self.get(v)
        seen = Observation()
        io.write(df.observe(seen, F.count(F.lit(1)).alias("rows")), path, kind, single)
        return {"version": v, "path": path, "format": kind, "rows": seen.get["rows"], "cols": len(df.columns)}

    def export_and_record(self, v: int, path: str, ledger: Ledger | None, thread: str, fmt: str | None = None, description: str = "", single: bool = False) -> dict:
        """:meth:`export`, and its record in a ledger's catalogue if there is one."""
        done = self.export(v, path, fmt, single)
        if ledger is not None:
            ledger.exported(thread, done["version"], done["path"], done["format"], description, done["rows"], done["cols"])
        return done

    @classmethod
    def restored(cls, spark: SparkSession, records: list[tuple[str, str]], head: int | None = None, **options) -> VersionStore:
        """A store from (JSON, description) records, forks and original numbers included; nothing is computed."""
        store = cls(spark, **options)
        for text, description in sorted(records, key=lambda r: loads(r[0]).version):
            node = loads(text)
            if node.step.kind == "source":
                p = node.step.params
                version = Version(node, None, None, lambda p=p: io.read(spark, p["path"], p["format"]), description, True)
            else:
                if len(node.parents) != 1 or node.parents[0] not in store.versions:
                    raise StepError(f"version {node.version} has no parent among the records")
                version = Version(node, node.parents[0], op_of(node.step), None, description)
            store._register(node.version, version, False)
        if head is not None:
            store.set_head(head)
        return store


def record(node: Node) -> str:
    return dumps(node)
