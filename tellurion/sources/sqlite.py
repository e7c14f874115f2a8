"""SQLite databases: the text and blob cells of their tables, one after the other, are the space of offsets."""

from __future__ import annotations

import sqlite3
from bisect import bisect_right

from ..operators.redact import DROP, RedactionError, apply_hits
from .model import ZERO, Chunk, Hits, InvalidArtifact, Origin

MAGIC = b"SQLite format 3\0"
TEXT_TYPES = ("TEXT", "CHAR", "CLOB", "BLOB")


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Database:
    """A database in memory; it is written anew only if something was redacted."""

    name = "sqlite"

    def __init__(self, data: bytes, path: str = ""):
        if not data.startswith(MAGIC):
            raise InvalidArtifact("SQLite: wrong magic")
        self.data = data
        try:
            self.cells = self._read()
        except sqlite3.Error as e:
            raise InvalidArtifact(f"SQLite: {e}") from e

    def _open(self) -> sqlite3.Connection:
        db = sqlite3.connect(":memory:")
        db.deserialize(self.data[:18] + b"\x01\x01" + self.data[20:])  # with a rollback journal, whatever the file had
        return db

    def _read(self) -> list[tuple[str, str, int, bytes, int]]:
        """(table, column, rowid, value, base) of the cells that may hold text, column by column."""
        db, out, base = self._open(), [], 0
        try:
            tables = [t for (t,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%'")]
            for table in tables:
                columns = [(c, kind.upper()) for _, c, kind, *_ in db.execute(f"PRAGMA table_info({_quoted(table)})")]
                for column in (c for c, kind in columns if not kind or any(t in kind for t in TEXT_TYPES)):
                    q = _quoted(column)
                    rows = db.execute(f"SELECT rowid, CAST({q} AS BLOB) FROM {_quoted(table)} WHERE typeof({q}) IN ('text', 'blob') ORDER BY rowid")
                    for rowid, value in rows:
                        if value:
                            out.append((table, column, rowid, value, base))
                            base += len(value)
        finally:
            db.close()
        return out

    def chunks(self) -> list[Chunk]:
        return [Chunk(value, base, Origin("string_table", name=f"{table}.{column}")) for table, column, _, value, base in self.cells]

    def apply(self, hits: Hits, kind: str = ZERO, pattern: bytes = b"") -> None:
        """Overwrites the hits in their cells, which become blobs, and compacts the file, so that no page keeps the old value."""
        if not hits:
            return
        if kind == DROP:
            raise RedactionError("SQLite cells can't lose bytes")
        bases = [base for *_, base in self.cells]
        by_cell: dict[int, Hits] = {}
        for at, size in hits:
            k = bisect_right(bases, at) - 1
            if k < 0 or at + size > bases[k] + len(self.cells[k][3]):
                raise RedactionError(f"SQLite: hit {at}..{at + size} lies in no cell")
            by_cell.setdefault(k, []).append((at - bases[k], size))
        db = self._open()
        try:
            with db:
                for k, own in by_cell.items():
                    table, column, rowid, value, _ = self.cells[k]
                    db.execute(f"UPDATE {_quoted(table)} SET {_quoted(column)} = ? WHERE rowid = ?", (apply_hits(value, own, kind, pattern), rowid))
            db.execute("VACUUM")
            self.data = db.serialize()
        finally:
            db.close()
        self.cells = self._read()

    def to_bytes(self) -> bytes:
        return self.data
