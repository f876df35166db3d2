"""The ledger of versions, the catalogue of exports and the list of conversations, in SQLite on the driver: metadata only."""

from __future__ import annotations

import sqlite3
import time

from vframe.plans.specs import Node, dumps

TABLES = """
CREATE TABLE IF NOT EXISTS versions (thread TEXT, version INTEGER, spec TEXT, description TEXT, created REAL, UNIQUE (thread, version));
CREATE TABLE IF NOT EXISTS exports (id INTEGER PRIMARY KEY, thread TEXT, version INTEGER, path TEXT, format TEXT, description TEXT, rows INTEGER, cols INTEGER, created REAL);
CREATE TABLE IF NOT EXISTS conversations (thread TEXT PRIMARY KEY, name TEXT, workspace TEXT, updated REAL);
"""


class Ledger:
    def __init__(self, path: str) -> None:
        self.db = sqlite3.connect(path, check_same_thread=False)
        self.db.executescript(TABLES)

    def _do(self, sql: str, *args: object) -> sqlite3.Cursor:
        with self.db:
            return self.db.execute(sql, args)

    def record(self, thread: str, node: Node, description: str = "") -> None:
        """Insert a version or replace it."""
        self._do("INSERT INTO versions VALUES (?, ?, ?, ?, ?) ON CONFLICT (thread, version) DO UPDATE SET spec = excluded.spec, description = excluded.description", thread, node.version, dumps(node), description, time.time())

    def versions(self, thread: str) -> list[tuple[str, str]]:
        """(JSON, description) by version, as VersionStore.restored takes them."""
        return self._do("SELECT spec, description FROM versions WHERE thread = ? ORDER BY version", thread).fetchall()

    def forget(self, thread: str) -> int:
        return self._do("DELETE FROM versions WHERE thread = ?", thread).rowcount

    def exported(self, thread: str, version: int, path: str, fmt: str, description: str = "", rows: int | None = None, cols: int | None = None) -> None:
        names = "thread, version, path, format, description, rows, cols, created"
        self._do(f"INSERT INTO exports ({names}) VALUES (?, ?, ?, ?, ?, ?, ?, ?)", thread, version, path, fmt, description, rows, cols, time.time())

    def exports(self, thread: str | None = None) -> list[tuple]:
        """(thread, version, path, format, description, rows, cols), the latest first."""
        names = "thread, version, path, format, description, rows, cols"
        return self._do(f"SELECT {names} FROM exports WHERE ?1 IS NULL OR thread = ?1 ORDER BY created DESC, id DESC", thread).fetchall()

    def touch(self, thread: str, name: str, workspace: str = "") -> None:
        self._do("INSERT INTO conversations VALUES (?, ?, ?, ?) ON CONFLICT (thread) DO UPDATE SET name = excluded.name, updated = excluded.updated", thread, name, workspace, time.time())

    def rename(self, thread: str, name: str) -> bool:
        return self._do("UPDATE conversations SET name = ? WHERE thread = ?", name, thread).rowcount > 0

    def remove(self, thread: str) -> bool:
        return self._do("DELETE FROM conversations WHERE thread = ?", thread).rowcount > 0

    def conversations(self, workspace: str | None = None) -> list[tuple]:
        return self._do("SELECT thread, name, workspace FROM conversations WHERE ?1 IS NULL OR workspace = ?1 ORDER BY updated DESC, rowid DESC", workspace).fetchall()
