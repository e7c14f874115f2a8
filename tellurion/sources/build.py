"""Artifacts made from texts: what tests and round trips scan and scrub."""

from __future__ import annotations

import io
import sqlite3
import struct
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.parallel import spread


def perf(text: bytes) -> bytes:
    """A perf file without records whose only feature is the command line."""
    padded = text + b"\0" * (64 - len(text) % 64)
    payload = struct.pack("<2I", 1, len(padded)) + padded
    at = 104 + 136
    head = b"PERFILE2" + struct.pack("<8Q", 104, 136, 104, 136, at, 0, 0, 0) + (1 << 11).to_bytes(32, "little")
    return head + bytes(136) + struct.pack("<2Q", at + 16, len(payload)) + payload


def elf_core(text: bytes, args: bytes = b"app") -> bytes:
    """A core dump with one note of process information and one segment."""
    desc = bytes(56) + args[:80].ljust(80, b"\0")
    note = struct.pack("<3I", 5, len(desc), 3) + b"CORE\0\0\0\0" + desc
    at = 64 + 2 * 56
    head = b"\x7fELF\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 4, 62, 1, 0, 64, 0, 0, 64, 56, 2, 0, 0, 0)
    def program(kind: int, offset: int, size: int) -> bytes:
        return struct.pack("<IIQQQQQQ", kind, 4, offset, 0, 0, size, size, 1)

    return head + program(4, at, len(note)) + program(1, at + len(note), len(text)) + note + text


def hprof(text: bytes, id_size: int = 8) -> bytes:
    body = (42).to_bytes(id_size, "big") + text
    return b"JAVA PROFILE 1.0.2\0" + struct.pack(">3I", id_size, 0, 0) + struct.pack(">BII", 1, 0, len(body)) + body + struct.pack(">BII", 0x2C, 0, 0)


def jfr(*texts: bytes) -> bytes:
    return b"".join(b"FLR\0" + struct.pack(">HHQ", 2, 1, 68 + len(t)) + bytes(52) + t for t in texts)


def pcap(*payloads: bytes, order: str = "<") -> bytes:
    head = struct.pack(f"{order}IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 101)
    return head + b"".join(struct.pack(f"{order}4I", 1, 0, len(p), len(p)) + p for p in payloads)


def pcapng(*payloads: bytes, order: str = "<") -> bytes:
    out = struct.pack(f"{order}IIIHHqI", 0x0A0D0D0A, 28, 0x1A2B3C4D, 1, 0, -1, 28)
    for p in payloads:
        total = 32 + -(-len(p) // 4) * 4
        out += struct.pack(f"{order}7I", 6, total, 0, 0, 0, len(p), len(p)) + p.ljust(total - 32, b"\0") + struct.pack(f"{order}I", total)
    return out


def sqlite(*rows: tuple[str, str]) -> bytes:
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE secrets (id INTEGER PRIMARY KEY, name TEXT, value TEXT)")
    db.execute("CREATE TABLE clean (n INTEGER, s TEXT)")
    db.executemany("INSERT INTO secrets (name, value) VALUES (?, ?)", rows)
    db.execute("INSERT INTO clean VALUES (1, 'nothing here')")
    db.commit()
    return db.serialize()


def tar(members: dict[str, bytes], compress: str = "") -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        folder = tarfile.TarInfo("src")
        folder.type = tarfile.DIRTYPE
        t.addfile(folder)
        for name, body in members.items():
            info = tarfile.TarInfo(name)
            info.size, info.mode, info.mtime = len(body), 0o600, 1_700_000_000
            t.addfile(info, io.BytesIO(body))
    if compress == "gz":
        import gzip

        return gzip.compress(out.getvalue())
    if compress == "zst":
        import zstandard

        return zstandard.ZstdCompressor().compress(out.getvalue())
    return out.getvalue()


def zipped(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def wrap(number: int, text: bytes) -> tuple[str, bytes]:
    """(path, content): the text in a format that the number chooses."""
    kinds = (
        lambda: ("log.txt", text),
        lambda: ("perf.data", perf(text)),
        lambda: ("core", elf_core(text)),
        lambda: ("heap.hprof", hprof(text)),
        lambda: ("app.jfr", jfr(text)),
        lambda: ("net.pcap", pcap(text)),
        lambda: ("app.db", sqlite(("text", text.decode("utf-8", "replace")))),
        lambda: ("src.tar", tar({"src/log.txt": text})),
    )
    name, content = kinds[number % len(kinds)]()
    return f"{number}/{name}", content


def wrapped(rows: DataFrame, number: str, text: str) -> DataFrame:
    """(path, content): an artifact for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                made = [wrap(n.as_py() or 0, (t.as_py() or "").encode()) for n, t in zip(b.column(0).slice(i, 256), b.column(1).slice(i, 256))]
                yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in made], pa.string()), "content": pa.array([c for _, c in made], pa.binary())})

    return spread(rows.select(F.col(number).cast("long"), text)).mapInArrow(run, "path string, content binary")
