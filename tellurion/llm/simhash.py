"""SimHash near-dedup by anchor-point covering.

A document's 64-bit fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Fingerprints that
differ in at most two bits are linked. Two such fingerprints differ in at most one bit on one of their two 31-bit
blocks (bits 0-30 and 31-61), so each block has a covering code of its own, the perfect [31, 26] Hamming code: every
block word lies within covering radius 1 of exactly one code word, its *home* anchor. A fingerprint is replicated to
every anchor within radius 1 + 1 of it, at most 16 a block; where two fingerprints are within one bit on a block,
each of them reaches the other's home. Per anchor, members are compared by population count, and only a spanning
forest of the links is emitted, never all pairs.

Distinct fingerprints alone are replicated, so a hot group of copies is one row. An anchor's members are compared in
blocks; above ``ENUMERATE`` members, each one's 2,080 neighbours at one or two bits are looked up in the sorted
members instead, which is exact as well and linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_rows, cut, partitions, text_key
from .components import components

THRESHOLD = 2
BLOCK_BITS = 31
ENUMERATE = 4096
MASK = np.uint64((1 << BLOCK_BITS) - 1)

_U64 = np.uint64
#: Position p (1..31) of the Hamming code sits at bit p - 1; the syndrome of a word is the XOR of the positions of its set bits.
_POSITIONS = np.arange(1, BLOCK_BITS + 1, dtype=_U64)
#: For syndrome 0 nothing else is in reach; for syndrome s the anchors in reach flip s alone, or a pair {a, a ^ s}.
_FLIPS = np.zeros((32, 16), dtype=_U64)
for _s in range(1, 32):
    _flips = [1 << (_s - 1)] + [(1 << (a - 1)) | (1 << ((a ^ _s) - 1)) for a in range(1, 32) if a < (a ^ _s)]
    _FLIPS[_s] = np.array(_flips, dtype=_U64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The fingerprint of one text; null and wordless texts have fingerprint 0."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    k = min(words, len(w))
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1)
    starts = (ends - np.fromiter(map(len, w), dtype=np.int64, count=len(w)) - 1).tolist()
    ends = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :])], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):  # little-endian bytes and bits: column j counts bit j
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def anchors(fp: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) of every anchor in reach of the block words of ``fp`` (uint64)."""
    x = (fp >> _U64(BLOCK_BITS * block)) & MASK
    syndrome = np.zeros(len(x), dtype=_U64)
    for p in range(BLOCK_BITS):
        syndrome ^= np.where((x >> _U64(p)) & _U64(1), _POSITIONS[p], _U64(0))
    reach = x[:, None] ^ _FLIPS[syndrome.astype(np.int64)]
    keep = np.ones(reach.shape, dtype=bool)
    keep[syndrome == 0, 1:] = False
    home = np.zeros(reach.shape, dtype=bool)
    home[:, 0] = True
    row = np.broadcast_to(np.arange(len(x))[:, None], reach.shape)
    return row[keep], reach[keep], home[keep]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n, over links i - j."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        np.minimum.at(root, before[i], low)
        np.minimum.at(root, before[j], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of distinct sorted ``fp`` within THRESHOLD bits, or for large groups enough of them to join the same groups."""
    n = len(fp)
    if n <= ENUMERATE:
        out_i, out_j, step = [], [], max(1, (1 << 22) // n)
        for a in range(0, n, step):
            i, j = np.nonzero(np.bitwise_count(fp[a : a + step, None] ^ fp[None, :]) <= THRESHOLD)
            keep = i + a < j
            out_i.append(i[keep] + a)
            out_j.append(j[keep])
        return np.concatenate(out_i), np.concatenate(out_j)
    one = [1 << a for a in range(64)]
    masks = one + [x | y for k, x in enumerate(one) for y in one[:k]]
    root = np.arange(n)
    for m in masks:
        to = fp ^ _U64(m)
        at = np.minimum(np.searchsorted(fp, to), n - 1)
        i = np.nonzero(fp[at] == to)[0]
        if len(i):
            root = _roots(n, np.concatenate([np.arange(n), i]), np.concatenate([root, at[i]]))
    return root[root != np.arange(n)], np.nonzero(root != np.arange(n))[0]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, anchor): a spanning forest of the links at each anchor, as pairs of fingerprints."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def forest(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[cuts, len(key)])
        u, v = [], []
        small = np.repeat(size, size) <= 48
        for shift in range(1, int(size[size <= 48].max(initial=1))):  # all small groups at once, by distance within the group
            i = np.flatnonzero((key[shift:] == key[:-shift]) & small[shift:])
            i = i[np.bitwise_count(fp[i] ^ fp[i + shift]) <= THRESHOLD]
            u.append(fp[i])
            v.append(fp[i + shift])
        for at, n in zip(cuts[size > 48], size[size > 48]):
            own = np.unique(fp[at : at + n])
            i, j = _links(own)
            root = _roots(len(own), i, j)
            moved = root != np.arange(len(own))
            u.append(own[moved])
            v.append(own[root[moved]])
        u, v = (np.concatenate([np.zeros(0, _U64), *x]).view(np.int64) for x in (u, v))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=schema)

    for b in batches:
        key = b.column("key").to_numpy(zero_copy_only=False)
        fp = b.column("fp").to_numpy(zero_copy_only=False).view(_U64)
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))  # the last anchor may go on in the next batch
        if last:
            whole = [*held, (key[:last], fp[:last])]
            yield forest(np.concatenate([k for k, _ in whole]), np.concatenate([f for _, f in whole]))
            held = []
        held.append((key[last:], fp[last:]))
    if held:
        yield forest(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False).view(_U64)
        for a in range(0, len(fp), 1 << 15):
            part = fp[a : a + (1 << 15)]
            for block in (0, 1):
                row, anchor, _ = anchors(part, block)
                key = ((anchor << _U64(1)) | _U64(block)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row].view(np.int64))], names=["key", "fp"])


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): links between the distinct fingerprints (column fp, long), enough to join every group that links join."""
    rows = distinct.select("fp").mapInArrow(_replicate, "key long, fp long")
    return rows.repartition(partitions(distinct.sparkSession), "key").sortWithinPartitions("key").mapInArrow(_compare, "u long, v long")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, key) of every row; key stands for the text (``text_key``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column("text")], dtype=_U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp), b.column("a"), b.column("b")], names=["doc_id", "fp", "a", "b"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", text_key("text").alias("k")).select("doc_id", "text", "k.a", "k.b")
    return rows.mapInArrow(run, "doc_id long, fp long, a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, a, b, component, component_id) of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id whose fingerprint is reachable over links of at most two differing bits. Null
    and wordless texts have fingerprint 0 and link like any other. Rows that repeat a doc_id each give a row; a null
    doc_id never becomes a component_id unless its group has no other. component names the group where component_id
    can't: it is the group's smallest fingerprint, signed. Other columns are ignored.
    """
    marked = cut(fingerprints(docs, words))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    label = components(links(nodes)).withColumnRenamed("node", "fp")
    nodes = nodes.join(label, "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lowest = nodes.groupBy("component").agg(F.min("low").alias("component_id"))
    named = nodes.join(lowest, "component").select("fp", "component", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "a", "b", "component", "component_id")


def hex64(fp: str) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, the one of smallest doc_id (null last; then the smallest text key).

    All columns are kept, whatever their names. Of identical rows with one doc_id a single one stays.
    """
    groups = cut(near_duplicates(docs, words).groupBy("component", "doc_id", "a", "b").agg(F.count("*").alias("rows")))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "a", "b")
    best = groups.groupBy("component").agg(F.min(F.struct(order.alias("o"), "rows")).alias("best"))
    best = cut(best.select(F.col("best.o.doc_id").alias("doc"), F.col("best.o.a").alias("best_a"), F.col("best.o.b").alias("best_b"), F.col("best.rows").alias("rows")))
    key = text_key(F.col("row.text"))
    rows = as_rows(docs).select("row", F.col("row.doc_id").cast("long").alias("id"), key["a"].alias("a"), key["b"].alias("b"))
    kept = rows.join(best, F.col("id").eqNullSafe(F.col("doc")) & F.col("a").eqNullSafe(F.col("best_a")) & F.col("b").eqNullSafe(F.col("best_b")))
    out = kept.where("rows = 1").select("row.*")
    if best.where("rows > 1").isEmpty():
        return out
    again = kept.where("rows > 1").dropDuplicates(["id", "a", "b"]).select("row.*")
    return out.union(again)
