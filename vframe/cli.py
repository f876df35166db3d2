"""A line-by-line shell over a version store: ``python -m vframe.cli [folder]``."""

from __future__ import annotations

import shlex
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

from vframe.operators import profile
from vframe.plans.ledger import Ledger
from vframe.plans.specs import StepError
from vframe.plans.store import VersionStore
from vframe.sources import io

# The names of the commands, and what each does.
HELP = {
    "load-file": "load-file PATH: read a table as version 0 of a new session",
    "select-workspace": "select-workspace FOLDER: keep sessions and exports in a folder",
    "ls": "ls [FOLDER]: list files of the workspace",
    "export": "export [VERSION] PATH: write a version as CSV, Parquet, or (.py) a script",
    "conversations": "conversations [resume ID | rename ID NAME | delete ID]: list or change sessions",
    "switch": "switch VERSION: make a version the head",
    "versions": "versions: list versions",
    "report": "report: size, columns and samples of the head",
    "exit": "exit: leave",
}


def parsed(line: str) -> tuple[str, list[str]]:
    """The command of a line, with or without a slash before it, and its arguments; quotes keep blanks."""
    words = shlex.split(line.strip().removeprefix("/"))
    return (words[0], words[1:]) if words else ("", [])


def hints(line: str) -> list[str]:
    """The help of all commands that a line could begin."""
    name = line.strip().removeprefix("/").split(" ")[0]
    return [text for key, text in HELP.items() if key.startswith(name)]


@dataclass
class Shell:
    spark: SparkSession
    root: Path = field(default_factory=Path.cwd)
    thread: str = ""
    done: bool = False

    def __post_init__(self) -> None:
        self._select(str(self.root))

    def _select(self, folder: str) -> str:
        self.root = Path(folder).resolve()
        self.ledger = Ledger(str(self.root / ".vframe.db"))
        self._open(VersionStore(self.spark, sink=self._record))
        return f"workspace {self.root}"

    def _open(self, store: VersionStore) -> None:
        self.store = store

    def _record(self, node, description: str) -> None:
        self.ledger.record(self.thread, node, description)

    def _inside(self, path: str) -> str:
        place = io.within(str(self.root), path)
        if place is None:
            raise StepError(f"{path!r} lies outside the workspace")
        return str(place)

    def load_file(self, path: str) -> str:
        place = self._inside(path)
        self.thread = f"{Path(path).stem}-{time.time_ns()}"
        self._open(VersionStore(self.spark, sink=self._record))
        version = self.store.load(place, io.resolve_format(place))
        self.ledger.touch(self.thread, Path(path).name, str(self.root))
        names, _ = io.head(self.store.get())
        return f"version {version}: {', '.join(names)}"

    def select_workspace(self, folder: str) -> str:
        return self._select(folder)

    def ls(self, folder: str = ".") -> str:
        shown, total = io.listing(self._inside(folder))
        left = [f"and {total - len(shown)} more"] if total > len(shown) else []
        return "\n".join([f"{name}/" if is_folder else f"{name} {size}" for name, is_folder, size in shown] + left)

    def export(self, *args: str) -> str:
        version = int(args[0]) if len(args) > 1 else self.store.head
        if version is None:
            raise StepError("nothing is loaded")
        made = self.store.export_and_record(version, self._inside(args[-1]), self.ledger, self.thread, single=True)
        return f"{made['path']}: {made['rows']} rows, {made['cols']} columns" if made["rows"] is not None else made["path"]

    def conversations(self, action: str = "list", thread: str = "", *name: str) -> str:
        if action == "resume":
            records = self.ledger.versions(thread)
            if not records:
                raise StepError(f"no session {thread!r}")
            self.thread = thread
            self._open(VersionStore.restored(self.spark, records, sink=self._record))
            return f"{len(records)} versions, head {self.store.head}"
        if action in ("rename", "delete"):
            changed = self.ledger.rename(thread, " ".join(name)) if action == "rename" else self.ledger.remove(thread)
            if action == "delete":
                self.ledger.forget(thread)
            return "done" if changed else f"no session {thread!r}"
        return "\n".join(f"{t} {n}" for t, n, _ in self.ledger.conversations(str(self.root)))

    def switch(self, version: str) -> str:
        self.store.set_head(int(version))
        return f"head {version}"

    def versions(self) -> str:
        return "\n".join(f"{'*' if r['is_head'] else ' '} {r['version']} {r['kind']} {r['description']}" for r in self.store.listing().orderBy("version").collect())

    def report(self) -> str:
        made = profile.report(self.store.get())
        return "\n".join([f"{made['rows']} rows, {made['cols']} columns", *[f"{c['column']} {c['dtype']} nulls {c['null_count']} distinct {c['n_unique']}" for c in made["columns"]]])

    def run(self, line: str) -> str:
        """What a line answers; a line that can't be carried out answers why, or the commands that it could begin."""
        try:
            name, args = parsed(line)
            if name == "exit":
                self.done = True
                return ""
            if name not in HELP:
                return "\n".join(hints(line)) or f"no command {name!r}"
            command: Callable[..., str] = getattr(self, name.replace("-", "_"))
            return command(*args)
        except (StepError, ValueError, KeyError, TypeError, OSError) as problem:
            return f"error: {problem}"


def main() -> None:
    shell = Shell(SparkSession.builder.getOrCreate(), Path(sys.argv[1] if len(sys.argv) > 1 else "."))
    while not shell.done:
        try:
            print(shell.run(input("> ")))
        except EOFError:
            return


if __name__ == "__main__":
    main()
