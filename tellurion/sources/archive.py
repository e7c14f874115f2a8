"""Archives: tar (plain, gzip, zstd) and zip. Their members, one after the other, are the space of offsets."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zipfile
import zlib
from bisect import bisect_right
from dataclasses import dataclass

from ..operators.redact import RedactionError
from .model import ZERO, Chunk, Hits, InvalidArtifact


#: Compressed bytes read at a time.
PIECE = 1 << 16
#: Where zstd's frame begins: at once, or after the frame of 4 bytes that pzstd writes before each.
ZSTD = re.compile(rb"(?:[\x50-\x5f]\x2a\x4d\x18\x04\0\0\0.{4})?\x28\xb5\x2f\xfd", re.S)


def unzstd(data: bytes) -> bytes:
    """The content of all frames, one after the other; frames to skip have none. Raises ValueError for a frame that is cut or isn't one."""
    import zstandard

    out: list[bytes] = []
    frame = None
    try:
        for at in range(0, len(data), PIECE):
            rest = data[at : at + PIECE]
            while rest:
                frame = frame or zstandard.ZstdDecompressor().decompressobj()
                out.append(frame.decompress(rest))
                rest = frame.unused_data if frame.eof else b""
                frame = None if frame.eof else frame
    except zstandard.ZstdError as e:
        raise ValueError(str(e)) from e
    if frame is not None:
        raise ValueError("the last frame is cut")
    return b"".join(out)


def kind_of(data: bytes, path: str = "") -> str | None:
    """tar, tar.gz, tar.zst or zip by magic, else by the path's end; any gzip or zstd file counts as a tar."""
    if data[:2] == b"PK" and data[2:3] in (b"\x03", b"\x05", b"\x07") and len(data) >= 4:
        return "zip"
    if data[:2] == b"\x1f\x8b":
        return "tar.gz"
    if ZSTD.match(data):
        return "tar.zst"
    if (len(data) >= 512 and data[257:262] == b"ustar") or path.endswith(".tar"):
        return "tar"
    return "zip" if path.endswith(".zip") else None


@dataclass
class Member:
    name: str
    inner: object
    mode: int
    mtime: int
    is_dir: bool
    base: int = 0
    span: int = 0


class Archive:
    def __init__(self, data: bytes, path: str = "", name: str = "tar"):
        from .dispatch import open_member

        self.name, self.kind = name, kind_of(data, path)
        if self.kind is None:
            raise InvalidArtifact("not an archive")
        try:
            found = list(self._zip(data) if self.kind == "zip" else self._tar(self._unpacked(data)))
        except (tarfile.TarError, zipfile.BadZipFile, OSError, EOFError, zlib.error, ValueError) as e:
            raise InvalidArtifact(f"{self.kind}: {e}") from e
        self.members: list[Member] = []
        base = 0
        for name, body, mode, mtime, is_dir in found:
            m = Member(name, None if is_dir else open_member(body, name), mode, mtime, is_dir, base, 0 if is_dir else len(body))
            self.members.append(m)
            base += m.span

    def _unpacked(self, data: bytes) -> bytes:
        if self.kind == "tar.gz":
            return gzip.decompress(data)
        if self.kind == "tar.zst":
            return unzstd(data)
        return data

    @staticmethod
    def _tar(raw: bytes):  # noqa: ANN205
        with tarfile.open(fileobj=io.BytesIO(raw), mode="r:") as tar:
            for m in tar:
                body = tar.extractfile(m).read() if m.isreg() else b""
                yield m.name, body, m.mode, int(m.mtime), m.isdir()

    @staticmethod
    def _zip(raw: bytes):  # noqa: ANN205
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for m in z.infolist():
                yield m.filename, b"" if m.is_dir() else z.read(m), (m.external_attr >> 16) & 0o7777 or 0o644, 0, m.is_dir()

    def chunks(self) -> list[Chunk]:
        return [Chunk(c.data, m.base + c.offset, c.origin.within(m.name, m.inner.name)) for m in self.members if not m.is_dir for c in m.inner.chunks()]

    def apply(self, hits: Hits, kind: str = ZERO, pattern: bytes = b"") -> None:
        by_member: dict[int, Hits] = {}
        filled = [m for m in self.members if m.span]
        for at, size in hits:
            k = bisect_right(filled, at, key=lambda m: m.base) - 1
            if k < 0 or at + size > filled[k].base + filled[k].span:
                raise RedactionError(f"archive: hit {at}..{at + size} lies in no member")
            by_member.setdefault(k, []).append((at - filled[k].base, size))
        for k, own in by_member.items():
            filled[k].inner.apply(own, kind, pattern)

    def to_bytes(self) -> bytes:
        """The archive packed anew: the same kind and compression, owner 0, modes and tar times kept, anything but folders as plain files."""
        bodies = [(m, b"" if m.is_dir else m.inner.to_bytes()) for m in self.members]
        out = io.BytesIO()
        if self.kind == "zip":
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for m, body in bodies:
                    info = zipfile.ZipInfo(m.name if not m.is_dir or m.name.endswith("/") else f"{m.name}/")
                    info.external_attr = (m.mode | (0o040000 if m.is_dir else 0o100000)) << 16
                    info.compress_type = zipfile.ZIP_DEFLATED
                    z.writestr(info, body)
            return out.getvalue()
        with tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT) as tar:
            for m, body in bodies:
                info = tarfile.TarInfo(m.name)
                info.size, info.mode, info.mtime = len(body), m.mode, m.mtime
                info.type = tarfile.DIRTYPE if m.is_dir else tarfile.REGTYPE
                tar.addfile(info, io.BytesIO(body))
        raw = out.getvalue()
        if self.kind == "tar.gz":
            return gzip.compress(raw, mtime=0)
        if self.kind == "tar.zst":
            import zstandard

            return zstandard.ZstdCompressor().compress(raw)
        return raw
