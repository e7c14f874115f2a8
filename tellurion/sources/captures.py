"""Profiler, dump and capture files: each parser finds the stretches of a file that may hold text."""

from __future__ import annotations

import struct

from .model import CMDLINE, RAW, Flat, InvalidArtifact, Origin, need, section

# Names of the feature sections of a perf.data file, by bit from 1 on; bit 11 is the command line.
PERF_FEATURES = (
    "tracing_data build_id hostname osrelease version arch nrcpus cpudesc cpuid totalmem cmdline event_desc "
    "cpu_topology numa_topology branch_stack pmu_mappings group_desc auxtrace stat cache sample_time mem_topology "
    "clockid dir_format bpf_prog_info bpf_btf compressed cpu_pmu_caps clock_data hybrid_topology pmu_caps"
).split()
PERF_MAGIC, PERF_HEADER, PERF_CMDLINE = b"PERFILE2", 104, 11

# ELF note types and HPROF record tags.
ELF_NOTES = {1: "NT_PRSTATUS", 2: "NT_PRFPREG", 3: "NT_PRPSINFO", 4: "NT_TASKSTRUCT", 6: "NT_AUXV", 0x46494C45: "NT_FILE", 0x53494749: "NT_SIGINFO"}
ELF_CORE = b"\x7fELF\x02\x01"
HPROF_MAGIC = b"JAVA PROFILE"
HPROF_TAGS = {
    0x01: "UTF8", 0x02: "LOAD_CLASS", 0x03: "UNLOAD_CLASS", 0x04: "FRAME", 0x05: "TRACE", 0x06: "ALLOC_SITES", 0x07: "HEAP_SUMMARY",
    0x0A: "START_THREAD", 0x0B: "END_THREAD", 0x0C: "HEAP_DUMP", 0x0D: "CPU_SAMPLES", 0x0E: "CONTROL_SETTINGS",
    0x1C: "HEAP_DUMP_SEGMENT", 0x2C: "HEAP_DUMP_END",
}
JFR_MAGIC, JFR_HEADER = b"FLR\0", 68
PCAP_MAGICS = {b"\xd4\xc3\xb2\xa1": "<", b"\x4d\x3c\xb2\xa1": "<", b"\xa1\xb2\xc3\xd4": ">", b"\xa1\xb2\x3c\x4d": ">"}
PCAPNG_MAGIC, PCAPNG_ORDER, PCAPNG_PACKET = b"\x0a\x0d\x0d\x0a", 0x1A2B3C4D, 6


def passthrough(data: bytes, path: str = "") -> Flat:
    return Flat("passthrough", data, [(0, len(data), RAW)])


def perf(data: bytes, path: str = "") -> Flat:
    """The records, then each feature section; descriptors of (offset, size) follow the records, one for each bit that is set."""
    need(data, PERF_HEADER, "perf header")
    if not data.startswith(PERF_MAGIC):
        raise InvalidArtifact("perf: wrong magic")
    start, size = struct.unpack_from("<2Q", data, 40)
    bits = int.from_bytes(data[72:104], "little")
    spans = [(start, start + size, section("perf.data.records"))] if size and start + size <= len(data) else []
    at = start + size
    for bit in (b for b in range(1, 256) if bits >> b & 1):
        need(data, at + 16, f"perf: descriptor of feature {bit}")
        offset, length = struct.unpack_from("<2Q", data, at)
        need(data, offset + length, f"perf: feature {bit}")
        name = PERF_FEATURES[bit - 1] if bit <= len(PERF_FEATURES) else "unknown"
        spans.append((offset, offset + length, CMDLINE if bit == PERF_CMDLINE else section(f"perf.{name}")))
        at += 16
    return Flat("perf", data, spans)


def is_elf_core(head: bytes) -> bool:
    return len(head) >= 18 and head.startswith(ELF_CORE) and head[16:18] == b"\x04\x00"


def elf_core(data: bytes, path: str = "") -> Flat:
    """The notes, with the command line of process information by itself before the whole note, then the memory segments."""
    need(data, 64, "ELF header")
    if not is_elf_core(data):
        raise InvalidArtifact("ELF: not a 64-bit little-endian core dump")
    table, width, count = struct.unpack_from("<Q", data, 32)[0], *struct.unpack_from("<2H", data, 54)
    if width != 56:
        raise InvalidArtifact(f"ELF: program headers of {width} bytes")
    notes: list[tuple[int, int, Origin]] = []
    loads: list[tuple[int, int, Origin]] = []
    for at in range(table, table + width * count, width):
        need(data, at + width, "ELF: program header")
        kind = struct.unpack_from("<I", data, at)[0]
        offset, size = struct.unpack_from("<Q", data, at + 8)[0], struct.unpack_from("<Q", data, at + 32)[0]
        need(data, offset + size, "ELF: segment")
        if kind == 4:
            notes += _notes(data, offset, offset + size)
        elif kind == 1 and size:
            loads.append((offset, offset + size, section("elf.load")))
    return Flat("elf-core", data, notes + loads)


def _notes(data: bytes, at: int, end: int) -> list[tuple[int, int, Origin]]:
    out = []
    while at + 12 <= end:
        name, size, kind = struct.unpack_from("<3I", data, at)
        start = at + 12 + -(-name // 4) * 4
        at = start + -(-size // 4) * 4
        if start > end or at > end:
            raise InvalidArtifact("ELF: a note runs past its segment")
        if size and kind == 3 and size >= 136:
            out.append((start + 56, start + 136, CMDLINE))
        if size:
            out.append((start, start + size, section(f"elf.note.{ELF_NOTES.get(kind, 'NOTE')}")))
    return out


def hprof(data: bytes, path: str = "") -> Flat:
    """Every record's body; string records without their id come by themselves first."""
    if not data.startswith(HPROF_MAGIC):
        raise InvalidArtifact("HPROF: wrong magic")
    at = data.find(b"\0") + 1
    if not at or len(data) < at + 12:
        raise InvalidArtifact("HPROF: truncated header")
    id_size = struct.unpack_from(">I", data, at)[0]
    if not 1 <= id_size <= 16:
        raise InvalidArtifact(f"HPROF: ids of {id_size} bytes")
    at += 12
    spans = []
    while at + 9 <= len(data):
        tag, _, size = struct.unpack_from(">BII", data, at)
        body = at + 9
        need(data, body + size, f"HPROF: record at {at}")
        if tag == 1 and size > id_size:
            spans.append((body + id_size, body + size, Origin("string_table", name="hprof.utf8")))
        if size:
            spans.append((body, body + size, section(f"hprof.HPROF_{HPROF_TAGS.get(tag, 'UNKNOWN')}")))
        at = body + size
    return Flat("hprof", data, spans)


def jfr(data: bytes, path: str = "") -> Flat:
    """The bodies of the recording's chunks; their headers are never touched."""
    need(data, JFR_HEADER, "JFR header")
    spans, at = [], 0
    while at < len(data):
        need(data, at + JFR_HEADER, "JFR: chunk header")
        magic, major, minor, size = struct.unpack_from(">4sHHQ", data, at)
        if magic != JFR_MAGIC or size < JFR_HEADER:
            raise InvalidArtifact(f"JFR: no chunk at {at}")
        need(data, at + size, "JFR: chunk")
        spans.append((at + JFR_HEADER, at + size, section(f"jfr.chunk[{len(spans)}].v{major}.{minor}")))
        at += size
    return Flat("jfr", data, spans, guarded=True)


def is_pcap(head: bytes, path: str = "") -> bool:
    return len(head) >= 4 and (head[:4] in PCAP_MAGICS or head[:4] == PCAPNG_MAGIC or path.endswith((".pcap", ".pcapng", ".cap")))


def pcap(data: bytes, path: str = "") -> Flat:
    """The packets' payloads; a truncated last record ends the walk."""
    need(data, 24, "pcap header")
    if data[:4] == PCAPNG_MAGIC:
        return _pcapng(data)
    order = PCAP_MAGICS.get(data[:4])
    if order is None:
        raise InvalidArtifact("pcap: unknown magic")
    spans, at = [], 24
    while at + 16 <= len(data):
        size = struct.unpack_from(f"{order}I", data, at + 8)[0]
        if at + 16 + size > len(data):
            break
        spans.append((at + 16, at + 16 + size, section(f"pcap.packet[{len(spans)}]")))
        at += 16 + size
    return Flat("pcap", data, spans, guarded=True)


def _pcapng(data: bytes) -> Flat:
    order = next((o for o in "<>" if struct.unpack_from(f"{o}I", data, 8)[0] == PCAPNG_ORDER), None)
    if order is None:
        raise InvalidArtifact("pcapng: no byte order")
    spans, at = [], 0
    while at + 8 <= len(data):
        kind, total = struct.unpack_from(f"{order}2I", data, at)
        if total < 12 or at + total > len(data):
            break
        if kind == PCAPNG_PACKET and total >= 32:
            size = struct.unpack_from(f"{order}I", data, at + 20)[0]
            if at + 28 + size <= len(data):
                spans.append((at + 28, at + 28 + size, section(f"pcapng.epb[{len(spans)}]")))
        at += total
    return Flat("pcap", data, spans, guarded=True)
