"""Document fingerprints by a homomorphic multiset hash of paragraphs.

A document's state is the sum, over its paragraphs (lines), of a wide vector hashed from each paragraph, every lane
modulo 2**64. So equal multisets of paragraphs have equal states whatever their order, and a paragraph is
inserted or deleted by adding or subtracting its vector alone. Two kinds of lanes make up a vector:

* ``EQUAL`` lanes, a keyed BLAKE2b digest of the paragraph: they decide equality;
* ``ALIKE`` lanes, read as signed, the sum of a random sign vector for each run of five words within the paragraph (the
  whole paragraph if it has fewer): their cosine estimates the likeness of two documents, with a standard error of
  about 0.09. A lane is at most the number of runs, so none wraps below 2**63 runs.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, text_key

EQUAL, ALIKE, RUN = 8, 128, 5

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = np.random.default_rng(2).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) | _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: One offset for each 64 sign bits of a run.
_STREAMS = np.arange(1, ALIKE // 64 + 1, dtype=_U) * _BASE
_POWERS = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            _POWERS[k] = np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(size - 1, base, _U)]))
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _runs(raw: bytes) -> np.ndarray:
    """A hash of each run of RUN words within a paragraph, and of each shorter paragraph."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, _U)
    word = np.r_[False, ~_SPACE[b], False]
    at = np.flatnonzero(word[1:] != word[:-1])
    start, end = at[::2], at[1::2]
    if not len(start):
        return np.zeros(0, _U)
    power, inverse = _powers(len(b) + 1)
    total = np.r_[_U(0), np.cumsum(_VALUES[b] * power[:-1], dtype=_U)]
    w = _mix((total[end] - total[start]) * inverse[start])
    para = np.cumsum(b == 10)[start]
    out = []
    full = np.flatnonzero(para[RUN - 1 :] == para[: len(para) - RUN + 1]) if len(w) >= RUN else np.zeros(0, np.int64)
    h = np.zeros(len(full), _U)
    for k in range(RUN):
        h = h * _BASE + w[full + k]
    out.append(h)
    first = np.flatnonzero(np.r_[True, para[1:] != para[:-1]])
    count = np.diff(np.r_[first, len(para)])
    for n in range(1, RUN):
        at = first[count == n]
        h = np.full(len(at), n, _U)
        for k in range(n):
            h = h * _BASE + w[at + k]
        out.append(h)
    return np.concatenate(out)


class State:
    """The sum of the vectors of a multiset of paragraphs."""

    __slots__ = ("alike", "equal")

    def __init__(self, equal: np.ndarray, alike: np.ndarray):
        self.equal, self.alike = equal, alike

    @classmethod
    def of(cls, text: str | None) -> State:
        """The state of a text, or of one paragraph; null counts as empty, and an empty text is one empty paragraph."""
        raw = (text or "").encode()
        digests = b"".join(hashlib.blake2b(p, digest_size=8 * EQUAL, key=b"paragraph").digest() for p in raw.split(b"\n"))
        equal = np.frombuffer(digests, "<u8").reshape(-1, EQUAL).sum(axis=0, dtype=_U)
        h = _runs(raw)
        ones = np.zeros(ALIKE, np.int64)
        for i in range(0, len(h), 1 << 14):
            part = h[i : i + (1 << 14)]
            bits = np.stack([_mix(part + k) for k in _STREAMS], axis=1)
            ones += np.unpackbits(bits.view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
        return cls(equal, 2 * ones - len(h))

    def __add__(self, other: State) -> State:
        return State(self.equal + other.equal, self.alike + other.alike)

    def __sub__(self, other: State) -> State:
        return State(self.equal - other.equal, self.alike - other.alike)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, State) and self.hex() == other.hex()

    __hash__ = None

    def hex(self) -> str:
        return self.equal.astype("<u8").tobytes().hex() + self.alike.astype("<i8").tobytes().hex()

    @classmethod
    def read(cls, text: str) -> State:
        raw = bytes.fromhex(text)
        return cls(np.frombuffer(raw[: 8 * EQUAL], "<u8"), np.frombuffer(raw[8 * EQUAL :], "<i8"))

    def likeness(self, other: State) -> float:
        """1 for equal states, else the cosine of the ALIKE lanes, 0 where it is negative or a state has no words."""
        if (self.equal == other.equal).all():
            return 1.0
        a, b = self.alike.astype(np.float64), other.alike.astype(np.float64)
        norm = np.sqrt((a @ a) * (b @ b))
        return float(min(1.0, max(0.0, a @ b / norm))) if norm else 0.0


def _buckets(rows: DataFrame, buckets: int) -> tuple[DataFrame, int]:
    """``rows`` (doc_id, k) with a bucket from 0, and how many there may be: about equal stretches of (doc_id, k), nulls first.

    Ends are quantiles of doc_id. An id that spans several quantiles, and null, has buckets of its own, by ranges of k.a.
    """
    total, known, ends = rows.agg(F.count("*"), F.count("doc_id"), F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)] or [0.5], 100 * buckets)).first()
    share = Counter(ends or [] if buckets > 1 else [])
    hot = {x: n + 1 for x, n in share.items() if n > 1 and abs(x) < 1 << 52}  # exact as doubles
    splits = sorted({float(x) for x in share} | {float(x + 1) for x in hot})
    parts = [max(1, -(-(total - known) * buckets // max(1, total))), 1, *(hot.get(int(x), 1) for x in splits)]  # null, below the first end, then from each end on
    if splits:
        from pyspark.ml.feature import Bucketizer

        number = Bucketizer(splits=[-float("inf"), *splits, float("inf")], inputCol="id", outputCol="number", handleInvalid="keep")
        rows = number.transform(rows.withColumn("id", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))).drop("id")
        stretch = F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("number").cast("int") + 1)
    else:
        stretch = F.col("doc_id").isNotNull().cast("int")
    before = [sum(parts[:i]) for i in range(len(parts))]
    first, n = (F.element_at(F.array(*map(F.lit, x)), F.col("stretch") + 1) for x in (before, parts))
    within = F.floor((F.col("k.a").cast("double") / float(1 << 64) + 0.5) * F.col("n")).cast("int")
    rows = rows.withColumn("stretch", stretch).withColumns({"first": first, "n": n})
    return rows.withColumn("bucket", F.col("first") + F.least(within, F.col("n") - 1)).drop("stretch", "first", "n", "number"), sum(parts)


def neighbours(docs: DataFrame, buckets: int) -> tuple[DataFrame, int]:
    """Each row's doc_id and text with a bucket and whether it is a guest there; read by descending (bucket, doc_id), each row's
    next document follows it. With the number of buckets.

    The first row of a bucket is a guest of the bucket before it too, so that a bucket needs nothing else, and the very
    first is one of the last.
    """
    rows, every = _buckets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key("text").alias("k")), buckets)
    rows = rows.select("doc_id", "text", F.struct(F.col("doc_id").isNotNull().alias("n"), "doc_id", "k").alias("at"), "bucket")
    firsts = [tuple(r) for r in rows.groupBy("bucket").agg(F.max("at").alias("at")).orderBy(F.desc("bucket")).collect()]  # one a bucket
    if not firsts:
        return rows.select("doc_id", "text", "at", "bucket", F.lit(False).alias("guest")), every
    before = [firsts[-1][0], *(b for b, _ in firsts[:-1])]
    schema = rows.select("bucket", F.col("at").alias("first"), F.col("bucket").alias("host")).schema
    hosts = rows.sparkSession.createDataFrame([(b, at, h) for (b, at), h in zip(firsts, before)], schema)
    marked = rows.join(F.broadcast(hosts), "bucket")  # as many rows as buckets
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    places = F.when(F.col("at") == F.col("first"), F.array(own, F.struct(F.col("host").alias("bucket"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    return marked.select("doc_id", "text", "at", F.explode(places).alias("p")).select("doc_id", "text", "at", "p.bucket", "p.guest"), every


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _OUT.split(", ")]
    held = None
    for b in batches:
        out: list[tuple] = []
        for doc_id, text, bucket, guest in zip(*(b.column(n) for n in ("doc_id", "text", "bucket", "guest"))):
            text, bucket = text.as_py() or "", bucket.as_py()
            if guest.as_py() and (held is None or held[2] != bucket):
                continue  # a second copy of the guest
            state = held[3] if held and held[1] == text else State.of(text)
            if held and held[2] == bucket:
                out.append(_edit(*held, text, state))
            held = None if guest.as_py() else (doc_id.as_py(), text, bucket, state)
        if out:
            yield pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(names, zip(*out))})


def _edit(doc_id: int | None, text: str, _: int, state: State, following: str, other: State) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    after = State.of(edited)
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), state.hex(), after.hex(), state.likeness(after), state.likeness(other)


def fingerprint_documents(docs: DataFrame, buckets_per_partition: int = 4) -> DataFrame:
    """Fingerprints of each row's whole text and of its edited text, whose last half is replaced by the next document's head.

    The next document is that of the next smaller doc_id (after the last, the first); equal and null doc_ids, which
    come last, follow one another by a hash of their texts. Null texts count as empty. near_edited and near_next are
    the likeness of a document's fingerprint to that of its edited text and of the next document. Other columns are
    ignored; an empty table gives an empty result. The texts are shuffled once.
    """
    n = partitions(docs.sparkSession)
    rows, every = neighbours(docs, buckets_per_partition * n)
    order = [F.desc("bucket"), F.asc("guest"), F.desc("at")]
    return rows.repartitionById(n, F.floor(F.col("bucket") * n / every).cast("int")).sortWithinPartitions(*order).select("doc_id", "text", "bucket", "guest").mapInArrow(_walk, _OUT)
