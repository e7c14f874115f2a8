import gzip
import sqlite3
import struct

import pytest
import zstandard

from tellurion.operators.redact import RedactionError
from tellurion.operators.views import CUSTOM
from tellurion.plans.rules import default_rules
from tellurion.sources import artifacts, build, dispatch
from tellurion.sources.model import InvalidArtifact, Origin

TOKEN = "gh" + "p_" + "TESTFAKE" * 4 + "TEST"
TEXT = f"line\nexport GH={TOKEN}\nend".encode()

MADE = {
    "log.txt": (TEXT, "passthrough"), "perf.data": (build.perf(TEXT), "perf"), "core": (build.elf_core(TEXT, b"app " + TOKEN.encode()), "elf-core"), "heap.hprof": (build.hprof(TEXT), "hprof"),
    "app.jfr": (build.jfr(TEXT, b"", TEXT), "jfr"), "net.pcap": (build.pcap(TEXT, b"", TEXT), "pcap"), "be.pcap": (build.pcap(TEXT, order=">"), "pcap"), "net.pcapng": (build.pcapng(TEXT, b"x"), "pcap"),
    "be.pcapng": (build.pcapng(TEXT, order=">"), "pcap"), "app.db": (build.sqlite(("a", TEXT.decode()), ("b", "x")), "sqlite"), "a.tar": (build.tar({"src/log.txt": TEXT, "in.db": build.sqlite(("a", TEXT.decode()))}), "tar"),
    "a.tar.gz": (build.tar({"src/log.txt": TEXT}, "gz"), "tar"), "a.tar.zst": (build.tar({"src/log.txt": TEXT}, "zst"), "tar"), "a.zip": (build.zipped({"src/log.txt": TEXT, "p.data": build.perf(TEXT)}), "tar"),
    "r.nsys-rep": (build.tar({"profile.sqlite": build.sqlite(("a", TEXT.decode())), "manifest.txt": b"m"}), "nsys"),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("artifacts")
    for name, (content, _) in MADE.items():
        (path / name).write_bytes(content)
    (path / "plain.gz").write_bytes(gzip.compress(b"not a tar"))
    (path / "cut.jfr").write_bytes(build.jfr(TEXT)[:-3])
    (path / "wrong.pcap").write_bytes(b"x" * 30)
    return path


def test_formats_are_found_by_head_and_path(spark, folder):
    found = artifacts.read_artifacts(spark, str(folder)).select("path", dispatch.sniffed().alias("f")).collect()
    by_name = {r.path.rsplit("/", 1)[1]: r.f for r in found}
    assert {n: by_name[n] for n in MADE} == {n: f for n, (_, f) in MADE.items()}
    for r in found:
        content = open(r.path.removeprefix("file:"), "rb").read()
        assert dispatch.find(content, r.path).name == r.f
    assert dispatch.open_artifact(TEXT, "x", "passthrough").name == "passthrough"
    with pytest.raises(dispatch.UnknownFormat):
        dispatch.by_name("nothing")


def test_scan_and_scrub_every_format(spark, folder):
    rows = artifacts.read_artifacts(spark, str(folder))
    rules = default_rules()
    hits = artifacts.hits(rows, rules).collect()
    errors = {r.path.rsplit("/", 1)[1] for r in hits if r.error}
    assert errors == {"plain.gz", "cut.jfr", "wrong.pcap"}
    counts = {}
    for r in hits:
        if not r.error:
            assert r.match == TOKEN and r.rule_id == "github_pat_classic" and r.verified is None
            counts[r.path.rsplit("/", 1)[1]] = counts.get(r.path.rsplit("/", 1)[1], 0) + 1
    assert counts == {n: 1 for n in MADE} | {"core": 3, "heap.hprof": 2, "app.jfr": 2, "net.pcap": 2, "a.tar": 2, "a.zip": 2}
    fewer = artifacts.hits(rows, rules, distinct=True).where("error is null").collect()
    assert sum(r.path.endswith("heap.hprof") for r in fewer) == 1
    done = {r.path.rsplit("/", 1)[1]: r for r in artifacts.scrub(rows, rules, verify=True).collect()}
    for name, (content, kind) in MADE.items():
        r = done[name]
        assert r.error is None and r.format == kind and r.left_over == 0 and r.n_hits == counts[name]
        assert TOKEN.encode() not in bytes(r.content)
        if kind not in ("tar", "nsys", "sqlite"):
            assert len(r.content) == len(content) and bytes(r.content)[:4] == content[:4]
        again = dispatch.open_artifact(bytes(r.content), name)
        assert [c.origin for c in again.chunks()] == [c.origin for c in dispatch.open_artifact(content, name).chunks()]


def test_chunks_have_origins_and_offsets(spark, folder):
    rows = artifacts.read_artifacts(spark, str(folder))
    got = {}
    for r in artifacts.chunks(rows).where("error is null").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.origin.kind, r.origin.name or r.origin.path, r.offset, bytes(r.data)))
    assert got["perf.data"][0][:2] == ("cmdline", None)
    assert [x[1] for x in got["core"]] == [None, "elf.note.NT_PRPSINFO", "elf.load"]
    assert [x[1] for x in got["heap.hprof"]] == ["hprof.utf8", "hprof.HPROF_UTF8"]
    assert [x[1] for x in got["app.jfr"]] == ["jfr.chunk[0].v2.1", "jfr.chunk[2].v2.1"]
    assert [x[1] for x in got["net.pcap"]] == ["pcap.packet[0]", "pcap.packet[2]"]
    assert got["net.pcapng"][0][1] == "pcapng.epb[0]"
    assert [x[1] for x in got["app.db"]] == ["secrets.name", "secrets.name", "secrets.value", "secrets.value", "clean.s"]
    for name in ("perf.data", "core", "heap.hprof", "app.jfr", "net.pcap"):
        content = MADE[name][0]
        assert all(content[at : at + len(d)] == d for *_, at, d in got[name])
    members = {(r.path.rsplit("/", 1)[1], r.name): r for r in artifacts.members(rows).collect() if r.name}
    assert members["a.tar", "src"].is_dir and members["a.tar", "src"].span == 0
    assert members["a.tar", "in.db"].base == len(TEXT) and members["a.tar", "in.db"].member_format == "sqlite"
    assert members["a.tar", "src/log.txt"].mode == 0o600


def test_nested_origins():
    assert Origin("section", name="x").within("m", "perf") == Origin("nested_member", path="m", format="perf")
    assert Origin("nested_member", path="b", format="f").within("a", "tar") == Origin("nested_member", path="a!b", format="f")


def test_structure_is_never_touched():
    for content, name in ((build.jfr(TEXT), "x.jfr"), (build.pcap(TEXT), "x.pcap")):
        with pytest.raises(RedactionError):
            dispatch.open_artifact(content, name).apply([(2, 4)])
    with pytest.raises(RedactionError):
        dispatch.open_artifact(MADE["app.db"][0]).apply([(10_000, 1)])
    with pytest.raises(RedactionError):
        dispatch.open_artifact(MADE["a.tar"][0], "a.tar").apply([(10**7, 1)])


@pytest.mark.parametrize(
    ("content", "name"),
    [
        (b"PERFILE2", "perf"), (b"\x7fELF\x02\x01" + bytes(10) + b"\x04\x00", "elf-core"), (b"JAVA PROFILE 1.0.2", "hprof"), (b"JAVA PROFILE 1.0.2\0" + struct.pack(">3I", 99, 0, 0), "hprof"),
        (b"FLR\0" + bytes(80), "jfr"), (b"x" * 10, "pcap"), (b"SQLite format 3\0" + bytes(100), "sqlite"), (b"PK\x03\x04broken", "tar"), (b"\x28\xb5\x2f\xfdbroken", "tar"),
    ],
)
def test_broken_files_are_errors(content, name):
    with pytest.raises(InvalidArtifact):
        dispatch.open_artifact(content, "", name)


def framed(raw: bytes, at: int, pzstd: bool = False) -> bytes:
    """Two frames of zstd, cut at ``at``; pzstd writes their sizes in frames to skip."""
    frames = [zstandard.ZstdCompressor().compress(part) for part in (raw[:at], raw[at:])]
    return b"".join((struct.pack("<3I", 0x184D2A50, 4, len(f)) if pzstd else b"") + f for f in frames)


def test_all_frames_of_an_archive_are_scanned_and_scrubbed(spark, tmp_path):
    raw = build.tar({"first.txt": b"nothing", "last.txt": TEXT})
    last = raw.index(b"last.txt")
    made = {"member.tar.zst": framed(raw, last), "middle.tar.zst": framed(raw, raw.index(TOKEN.encode()) + 5), "p.tar.zst": framed(raw, last, pzstd=True)}
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
        assert [m.name for m in dispatch.open_artifact(content, name).members] == ["src", "first.txt", "last.txt"]
        for broken in (content[:-3], content + b"garbage"):
            with pytest.raises(InvalidArtifact):
                dispatch.open_artifact(broken, name)
    rows = artifacts.read_artifacts(spark, str(tmp_path))
    assert {r.f for r in rows.select(dispatch.sniffed().alias("f")).collect()} == {"tar"}
    assert sorted((r.path.rsplit("/", 1)[1], r.match) for r in artifacts.hits(rows, default_rules()).collect()) == [(n, TOKEN) for n in sorted(made)]
    for r in artifacts.scrub(rows, default_rules(), verify=True).collect():
        assert r.error is None and r.n_hits == 1 and r.left_over == 0
        assert [m.name for m in dispatch.open_artifact(bytes(r.content), r.path).members] == ["src", "first.txt", "last.txt"]


def test_truncated_packets_end_the_walk():
    assert len(dispatch.open_artifact(build.pcap(TEXT, TEXT)[:-5], "").chunks()) == 1


def test_sqlite_with_odd_names_and_types():
    db = sqlite3.connect(":memory:")
    db.execute('CREATE TABLE "a""b" ("c d" VARCHAR(9), n INTEGER, untyped, r REAL)')
    db.execute('INSERT INTO "a""b" VALUES (?, 5, ?, 1.5)', (TOKEN, b"\x00blob"))
    db.commit()
    found = dispatch.open_artifact(db.serialize())
    assert [(c.origin.name, c.data) for c in found.chunks()] == [('a"b.c d', TOKEN.encode()), ('a"b.untyped', b"\x00blob")]
    found.apply([(0, len(TOKEN))])
    assert [c.data for c in dispatch.open_artifact(found.to_bytes()).chunks()] == [bytes(len(TOKEN)), b"\x00blob"]


def test_written_tables_hold_what_could_be_scrubbed(spark, folder, tmp_path):
    done = artifacts.scrub(artifacts.read_artifacts(spark, str(folder)), [*default_rules(), *CUSTOM])
    artifacts.write_scrubbed(done, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(MADE)
