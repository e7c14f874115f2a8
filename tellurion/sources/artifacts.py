"""Artifact files as tables: chunks, hits and redacted artifacts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.redact import PATTERN, ZERO, RedactionError
from ..plans.matcher import compiled
from ..plans.parallel import spread
from ..plans.rules import Rule, dump, validate
from .dispatch import open_artifact
from .model import InvalidArtifact

ORIGIN = "struct<kind:string,name:string,path:string,format:string>"
_ORIGIN = pa.struct([(n, pa.string()) for n in ("kind", "name", "path", "format")])
#: Artifacts are read whole; at most this many go to a worker at a time.
TOGETHER = 4


def read_artifacts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of every file below a path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def _each(artifacts: DataFrame, run, schema: str, name: str | None) -> DataFrame:  # noqa: ANN001
    """``run(path, artifact)`` gives dicts for an artifact; one that can't be read gives a row with its error."""
    names = [f.strip().split(" ")[0] for f in _split(schema)]

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _arrow(schema)
        for b in batches:
            for i in range(0, b.num_rows, TOGETHER):
                rows = []
                for path, content in zip(b.column("path").slice(i, TOGETHER), b.column("content").slice(i, TOGETHER)):
                    try:
                        rows += run(path.as_py(), open_artifact(content.as_py() or b"", path.as_py() or "", name))
                    except (InvalidArtifact, RedactionError) as e:
                        rows.append({"path": path.as_py(), "error": str(e)})
                yield pa.RecordBatch.from_pydict({n: pa.array([r.get(n) for r in rows], kinds[n]) for n in names})

    return spread(artifacts.select("path", "content")).mapInArrow(all_of, schema)


def _split(schema: str) -> list[str]:
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _arrow(schema: str) -> dict[str, pa.DataType]:
    plain = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    return {n: plain.get(kind, _ORIGIN) for n, kind in (f.strip().split(" ", 1) for f in _split(schema))}


def chunks(artifacts: DataFrame, name: str | None = None) -> DataFrame:
    """(path, format, ord, offset, size, origin, data, error): the chunks of each artifact, in order."""

    def run(path: str, artifact) -> list[dict]:  # noqa: ANN001
        return [{"path": path, "format": artifact.name, "ord": k, "offset": c.offset, "size": len(c.data), "origin": vars(c.origin), "data": c.data} for k, c in enumerate(artifact.chunks())]

    return _each(artifacts, run, f"path string, format string, ord int, offset long, size long, origin {ORIGIN}, data binary, error string", name)


def members(artifacts: DataFrame) -> DataFrame:
    """(path, ord, name, member_format, base, span, mode, mtime, is_dir, error): the members of archives."""

    def run(path: str, artifact) -> list[dict]:  # noqa: ANN001
        found = getattr(artifact, "members", [])
        return [{"path": path, "ord": k, "name": m.name, "member_format": None if m.is_dir else m.inner.name, "base": m.base, "span": m.span, "mode": m.mode, "mtime": m.mtime, "is_dir": m.is_dir} for k, m in enumerate(found)]

    return _each(artifacts, run, "path string, ord int, name string, member_format string, base long, span long, mode int, mtime long, is_dir boolean, error string", None)


def hits(artifacts: DataFrame, rules: list[Rule], name: str | None = None, distinct: bool = False) -> DataFrame:
    """(path, format, rule_id, offset, len, verified, origin, match, error): the hits in all chunks of each artifact.

    Some formats hold a stretch in two chunks, and report its hits twice; ``distinct`` keeps the first. ``verified`` is
    always null: nothing is looked up. Artifacts that can't be read give a row with an error alone.
    """
    validate(rules)
    dumped = dump(rules)

    def run(path: str, artifact) -> list[dict]:  # noqa: ANN001
        matcher, out, seen = compiled(dumped), [], set()
        for c in artifact.chunks():
            for k, at, size in matcher.scan_bytes(c.data):
                if distinct and (k, c.offset + at, size) in seen:
                    continue
                seen.add((k, c.offset + at, size))
                out.append({"path": path, "format": artifact.name, "rule_id": rules[k].rule_id, "offset": c.offset + at, "len": size, "origin": vars(c.origin), "match": c.data[at : at + size].decode("utf-8", "replace")})
        return out

    return _each(artifacts, run, f"path string, format string, rule_id string, offset long, len long, verified boolean, origin {ORIGIN}, match string, error string", name)


def scrub(artifacts: DataFrame, rules: list[Rule], name: str | None = None, kind: str = ZERO, pattern: bytes = b"", verify: bool = False) -> DataFrame:
    """(path, format, n_hits, left_over, content, error): every artifact with all its hits overwritten, others unchanged.

    With ``verify`` the result is parsed and scanned again, and left_over counts what is still found; else it is null.

    All hits of an artifact are found before the first is overwritten. An artifact whose hits can't be redacted without
    touching its structure gives an error and no content.
    """
    validate(rules)
    dumped = dump(rules)
    if kind == PATTERN and not pattern:
        raise RedactionError("the pattern is empty")

    def run(path: str, artifact) -> list[dict]:  # noqa: ANN001
        matcher = compiled(dumped)
        found = [(c.offset + at, size) for c in artifact.chunks() for _, at, size in matcher.scan_bytes(c.data)]
        if found:
            artifact.apply(found, kind, pattern)
        content = artifact.to_bytes()
        left = sum(len(matcher.scan_bytes(c.data)) for c in open_artifact(content, path or "", name).chunks()) if verify else None
        return [{"path": path, "format": artifact.name, "n_hits": len(found), "left_over": left, "content": content}]

    return _each(artifacts, run, "path string, format string, n_hits long, left_over long, content binary, error string", name)


def write_scrubbed(scrubbed: DataFrame, folder: str) -> None:
    """Writes scrubbed artifacts as a table; Spark's commit makes it appear whole or not at all, and originals stay."""
    scrubbed.where(F.col("error").isNull()).write.mode("overwrite").parquet(folder)
