"""Which format an artifact has: the first that recognises its head or path, else passthrough."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import captures
from .archive import Archive, kind_of
from .model import InvalidArtifact
from .sqlite import MAGIC as SQLITE_MAGIC
from .sqlite import Database

#: Bytes that sniffing looks at.
HEAD = 512
NSYS = (".nsys-rep", ".ncu-rep")


class UnknownFormat(ValueError):
    """A format name that isn't registered."""


@dataclass(frozen=True)
class Handler:
    name: str
    detect: Callable[[bytes, str], bool]
    open: Callable[[bytes, str], object]


PERF = Handler("perf", lambda h, p: h.startswith(captures.PERF_MAGIC), captures.perf)
NSIGHT = Handler("nsys", lambda h, p: p.endswith(NSYS), lambda d, p: Archive(d, p, "nsys"))
TAR = Handler("tar", lambda h, p: kind_of(h, p) is not None, Archive)
ELF = Handler("elf-core", lambda h, p: captures.is_elf_core(h), captures.elf_core)
HPROF = Handler("hprof", lambda h, p: h.startswith(captures.HPROF_MAGIC), captures.hprof)
JFR = Handler("jfr", lambda h, p: h.startswith(captures.JFR_MAGIC), captures.jfr)
PCAP = Handler("pcap", captures.is_pcap, captures.pcap)
SQLITE = Handler("sqlite", lambda h, p: h.startswith(SQLITE_MAGIC), Database)
PASSTHROUGH = Handler("passthrough", lambda h, p: True, captures.passthrough)

#: In the order in which they are asked.
HANDLERS = [PERF, NSIGHT, TAR, ELF, HPROF, JFR, PCAP, SQLITE, PASSTHROUGH]
#: For members of archives: no archives in archives, and no packet captures.
INNER = [PERF, SQLITE, ELF, HPROF, JFR, PASSTHROUGH]


def find(head: bytes, path: str = "", handlers: list[Handler] | None = None) -> Handler:
    return next(h for h in handlers or HANDLERS if h.detect(head[:HEAD], path))


def by_name(name: str) -> Handler:
    for h in HANDLERS:
        if h.name == name:
            return h
    raise UnknownFormat(name)


def open_artifact(data: bytes, path: str = "", name: str | None = None):  # noqa: ANN201
    """The artifact, in the format of that name or in the one that is detected."""
    return (by_name(name) if name else find(data, path)).open(data, path)


def open_member(data: bytes, path: str):  # noqa: ANN201
    return find(data, path, INNER).open(data, path)


def sniffed(content: str | Column = "content", path: str | Column = "path") -> Column:
    """The name of an artifact's format, as an expression over its bytes and path that reads its head alone."""
    c = F.col(content) if isinstance(content, str) else content
    p = F.coalesce(F.col(path) if isinstance(path, str) else path, F.lit(""))
    head = F.hex(F.substring(c, 1, HEAD))

    def starts(*magics: bytes) -> Column:
        found = F.lit(False)
        for m in magics:
            found = found | F.startswith(head, F.lit(m.hex().upper()))
        return found

    def ends(*names: str) -> Column:
        found = F.lit(False)
        for n in names:
            found = found | F.endswith(p, F.lit(n))
        return found

    at = lambda first, raw: F.substring(head, 2 * first + 1, 2 * len(raw)) == raw.hex().upper()
    zipped = (starts(b"PK\x03", b"PK\x05", b"PK\x07") & (F.length(head) >= 8)) | starts(b"\x1f\x8b", b"\x28\xb5\x2f\xfd") | head.rlike("^5[0-9A-F]2A4D1804000000.{8}28B52FFD")  # the last is pzstd's
    tar = zipped | ((F.length(head) >= 2 * HEAD) & at(257, b"ustar")) | ends(".tar", ".zip")
    packets = (F.length(head) >= 8) & (starts(*captures.PCAP_MAGICS, captures.PCAPNG_MAGIC) | ends(".pcap", ".pcapng", ".cap"))
    name = F.when(starts(captures.PERF_MAGIC), "perf").when(ends(*NSYS), "nsys").when(tar, "tar")
    name = name.when(starts(captures.ELF_CORE) & at(16, b"\x04\x00"), "elf-core").when(starts(captures.HPROF_MAGIC), "hprof")
    return name.when(starts(captures.JFR_MAGIC), "jfr").when(packets, "pcap").when(starts(SQLITE_MAGIC), "sqlite").otherwise("passthrough")


__all__ = ["HANDLERS", "INNER", "Handler", "InvalidArtifact", "UnknownFormat", "by_name", "find", "open_artifact", "open_member", "sniffed"]
