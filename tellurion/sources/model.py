"""What all artifact formats share: chunks of bytes with an origin, and redaction that keeps the structure."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, replace
from itertools import accumulate

from ..operators.redact import PATTERN, ZERO, RedactionError, apply_hits

Hits = list[tuple[int, int]]


class InvalidArtifact(ValueError):
    """A file whose structure can't be read."""


@dataclass(frozen=True)
class Origin:
    """Where in an artifact a chunk lies: raw, cmdline, string_table, section or nested_member."""

    kind: str
    name: str | None = None
    path: str | None = None
    format: str | None = None

    def within(self, member: str, inner: str) -> Origin:
        """The origin as seen from an archive; what is nested twice keeps its own format."""
        if self.kind == "nested_member":
            return replace(self, path=f"{member}!{self.path}")
        return Origin("nested_member", path=member, format=inner)


RAW = Origin("raw")
CMDLINE = Origin("cmdline")


def section(name: str) -> Origin:
    return Origin("section", name=name)


@dataclass(frozen=True)
class Chunk:
    data: bytes
    offset: int
    origin: Origin


class Flat:
    """An artifact whose chunks are stretches of its own bytes: (start, end, origin); ``guarded`` ones are redacted inside of these alone."""

    def __init__(self, name: str, data: bytes, spans: list[tuple[int, int, Origin]], guarded: bool = False):
        self.name, self.data, self.spans, self.guarded = name, data, spans, guarded

    def chunks(self) -> list[Chunk]:
        return [Chunk(self.data[a:z], a, o) for a, z, o in self.spans if a < z]

    def apply(self, hits: Hits, kind: str = ZERO, pattern: bytes = b"") -> None:
        if self.guarded:
            spans = sorted((a, z) for a, z, _ in self.spans)
            starts, reach = [a for a, _ in spans], list(accumulate((z for _, z in spans), max))
            for at, size in hits:
                k = bisect_right(starts, at)
                if not k or at + size > reach[k - 1]:
                    raise RedactionError(f"{self.name}: hit {at}..{at + size} lies outside of every body")
        self.data = apply_hits(self.data, hits, kind, pattern)

    def to_bytes(self) -> bytes:
        return self.data


def need(data: bytes, end: int, what: str) -> None:
    if end > len(data):
        raise InvalidArtifact(f"{what} runs past the end ({end} of {len(data)} bytes)")


__all__ = ["CMDLINE", "PATTERN", "RAW", "ZERO", "Chunk", "Flat", "Hits", "InvalidArtifact", "Origin", "need", "section"]
