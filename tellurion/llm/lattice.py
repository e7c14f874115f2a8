"""Embedding near-dedup by E8 lattice hashing.

Unit vectors are rotated by one random orthogonal matrix and cut into blocks of eight coordinates, one hash table a
block. In a table, a vector's *home* is the E8 lattice point (scaled by ``cell``) nearest to its block. The blocks'
squared distances add up to the whole squared distance, so two vectors of cosine >= c, at distance r =
sqrt(2 - 2c), are within rho = r / sqrt(blocks) of one another in at least one table. There, each vector probes every
neighbouring cell that a point within rho of it could have as its home, so the pair surely meets: the hashing loses
no link (where it would have to probe too far, it raises an error), and cosine in double precision is verified for all that meet.

Of two neighbouring cells only the one with the smaller code is probed, which halves the probes and makes a pair meet
once a table. What is sent to a cell first is a vector's number and its eight coordinates there, in a byte each: rows of
24 bytes. Those that have no other within rho (and the bytes' error) in the cell are done; only the others are joined
with their vectors and compared. A link is counted in the first table where its blocks are within rho. Links are
counted where they are found and only each cell's spanning forest is emitted, never all pairs. Exact copies are merged
first and weigh in with their number. Cells of more than ``HOT`` homes are dealt to several tasks: homes to one each, the
others to all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions
from .components import components
from .simhash import _roots

HOT = 8192
SLACK = 1e-6
#: Cells that a probe goes at most: there are 340,320 E8 vectors within 4.
REACH = 4.0
#: Numbers held at a time, so that they stay in a core's cache.
HELD = 1 << 19
#: Bits of a key that hold the table, and so the dimensions that vectors may have.
TABLES = 10
WIDEST = 8 << TABLES


@lru_cache(maxsize=4)
def _shells(reach: float = 6**0.5) -> np.ndarray:
    """The E8 vectors but 0 of length ``reach`` at most, by length."""
    if reach > REACH:
        raise ValueError(f"vectors may link over {reach:.2f} cells, more than {REACH:g}: use a larger cell")
    found = []
    for shift in (0.0, 0.5):
        axis = np.arange(-np.ceil(reach), np.ceil(reach) + 1) + shift
        v = np.zeros((1, 0))
        for _ in range(8):
            v = np.c_[np.repeat(v, len(axis), 0), np.tile(axis, len(v))]
            v = v[(v**2).sum(1) <= reach**2 + SLACK]
        found.append(v[(v.sum(1) % 2 == 0) & v.any(1)])
    v = np.concatenate(found)
    return v[np.argsort((v**2).sum(1), kind="stable")]


def nearest(y: np.ndarray) -> np.ndarray:
    """The E8 lattice point nearest to each row of ``y`` (n, 8): the better of D8 and D8 shifted by a half."""

    def d8(z: np.ndarray) -> np.ndarray:
        r = np.rint(z)
        odd = np.flatnonzero(r.sum(1) % 2)
        off = z[odd] - r[odd]
        k = np.abs(off).argmax(1)
        r[odd, k] += np.where(off[np.arange(len(odd)), k] >= 0, 1, -1)
        return r

    a, b = d8(y), d8(y - 0.5) + 0.5
    return np.where(((y - a) ** 2).sum(1, keepdims=True) <= ((y - b) ** 2).sum(1, keepdims=True), a, b)


@lru_cache(maxsize=4)
def rotation(dims: int, seed: int) -> np.ndarray:
    """A random orthogonal map of ``dims`` coordinates into whole blocks of eight."""
    wide = -(-dims // 8) * 8
    q, r = np.linalg.qr(np.random.default_rng([seed, dims]).normal(size=(wide, wide)))
    return (q * np.sign(np.diag(r)))[:dims]


def codes(point: np.ndarray) -> np.ndarray:
    """A lattice point as one number: eight signed bytes of doubled coordinates."""
    return np.ascontiguousarray(np.rint(2 * point).astype(np.int8)).view("<i8").reshape(-1)


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Lattice:
    """Where vectors of ``dims`` dimensions live and probe."""

    def __init__(self, cosine: float, cell: float, seed: int):
        self.cosine, self.cell, self.seed = cosine, cell, seed

    def map(self, dims: int) -> np.ndarray:
        return rotation(dims, self.seed)

    def rho(self, dims: int) -> float:
        return np.sqrt(max(0.0, 2 - 2 * self.cosine) / (-(-dims // 8))) * (1 + SLACK) + SLACK

    def near(self, dims: int) -> float:
        """What two vectors' bytes differ by at most, squared, if their blocks are within rho: each byte is off by half at most."""
        return (self.rho(dims) / self.cell * self.steps(dims) + np.sqrt(8.0)) ** 2 + 1

    def steps(self, dims: int) -> float:
        """A byte's steps for the length of a cell's radius: no row lies farther from a cell's centre than 1 + rho."""
        return 126 / (1.001 + self.rho(dims) / self.cell)

    def homes(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(lattice point, what is left) of each unit vector in a table, in cells."""
        y = (x @ self.map(x.shape[1])[:, 8 * table : 8 * table + 8]) / self.cell
        home = nearest(y)
        return home, y - home

    def places(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, code, probing, bytes) of each cell that the unit vectors ``x`` occupy or probe in a table, with their place in it."""
        dims = x.shape[1]
        rho, steps = self.rho(dims) / self.cell, self.steps(dims)
        shells = _shells(2 + rho)  # beyond, no cell is in reach
        home, rest = self.homes(x, table)
        length = np.sqrt((shells**2).sum(1))
        # a cell is in reach if the hyperplane between it and home is, and if the cell's centre is within its covering radius and rho
        least = (length**2 / 2 - rho * length - 10 * SLACK).astype(np.float32)
        turned, low = np.ascontiguousarray(shells.T.astype(np.float32)), rest.astype(np.float32)
        row, to = [], []
        step = max(1, HELD // len(shells))
        for at in range(0, len(rest), step):
            i, j = np.divmod(np.flatnonzero(low[at : at + step] @ turned >= least), len(shells))
            row.append(i + at)
            to.append(j)
        row, to = np.concatenate(row) if row else np.zeros(0, np.int64), np.concatenate(to) if to else np.zeros(0, np.int64)
        off = rest[row] - shells[to]
        near = (off**2).sum(1) <= (1 + rho) ** 2 + SLACK
        row, to, off = row[near], to[near], off[near]
        own = codes(home)
        there = codes(home[row] + shells[to])
        less = there < own[row]
        packed = np.rint(np.concatenate([rest, off[less]]) * steps).astype(np.int8)
        return np.r_[np.arange(len(x)), row[less]], np.r_[own, there[less]], np.r_[np.zeros(len(x), np.int8), np.ones(int(less.sum()), np.int8)], packed.view("<i8").reshape(-1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def keys(label: np.ndarray, dims: int, table: int, code: np.ndarray) -> np.ndarray:
    """A cell of a label as one number, which ends in its table. Two cells may share one: that costs comparisons, no links."""
    h = _mixed(_mixed(label.view(np.uint64) + np.uint64(dims)) ^ code.view(np.uint64))
    return ((h << np.uint64(TABLES)) | np.uint64(table)).view(np.int64)


class _Cell:
    """The links of one cell, tallied while its rows stream by: homes first, then those who visit."""

    def __init__(self, lat: Lattice, table: int, dims: int):
        self.lat, self.table, self.turn, self.rho2 = lat, table, lat.map(dims)[:, : 8 * table + 8], lat.rho(dims) ** 2
        self.homes: list[tuple] = []
        self.id = np.zeros(0, np.int64)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, node: np.ndarray, rows: np.ndarray, x: np.ndarray) -> None:
        self.homes.append((node, rows, x))

    def settle(self) -> None:
        if self.homes:
            self.id, self.rows, self.x = (np.concatenate(c) for c in zip(*self.homes))
            self.homes = []
            self.norm, self.unit = np.sqrt((self.x * self.x).sum(1)), unit(self.x)
            self.turned = None
            if len(self.id) > 1:
                self._meet(self.id, self.rows, self.x, lambda i, j: i < j)

    def visit(self, role: np.ndarray, node: np.ndarray, rows: np.ndarray, x: np.ndarray) -> None:
        self.settle()
        if len(self.id):
            self._meet(node, rows, x, lambda i, j: (role[j] == 2) | (self.id[i] < node[j]))

    def _meet(self, node: np.ndarray, rows: np.ndarray, x: np.ndarray, count) -> None:
        step = max(1, (1 << 20) // len(self.id))
        for at in range(0, len(node), step):
            b = x[at : at + step]
            norm, u = np.sqrt((b * b).sum(1)), unit(b)
            i, j = np.nonzero(self.unit @ u.T >= self.lat.cosine - 1e-9)
            keep = count(i, j + at)
            i, j = i[keep], j[keep]
            for k in range(0, len(i), 1 << 15):
                p, q = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
                ok = (self.x[p] * b[q]).sum(1) / (self.norm[p] * norm[q]) >= self.lat.cosine
                p, q = p[ok], q[ok]
                if not len(p):
                    continue
                if self.turned is None:
                    self.turned = self.unit @ self.turn
                d = (self.turned[p] - (u @ self.turn)[q]) ** 2
                d = d.reshape(len(p), self.table + 1, 8).sum(2) <= self.rho2
                first = d[:, -1] & ~d[:, :-1].any(1)  # in the first table where the two are near
                p, q = p[first], q[first] + at
                self.pairs.append((self.id[p], node[q]))
                self.counts += [(self.id[p], rows[q]), (node[q], self.rows[p])]
                self.pending += len(p)
                if self.pending > 1 << 18:
                    self.reduce()

    def reduce(self) -> None:
        if not self.pairs:
            return
        u, v = (np.concatenate(c) for c in zip(*self.pairs))
        ids, at = np.unique(np.r_[u, v], return_inverse=True)
        root = _roots(len(ids), at[: len(u)], at[len(u) :])
        moved = root != np.arange(len(ids))
        self.pairs = [(ids[moved], ids[root[moved]])]
        who, n = (np.concatenate(c) for c in zip(*self.counts))
        ids, at = np.unique(who, return_inverse=True)
        total = np.zeros(len(ids), np.int64)
        np.add.at(total, at, n)
        self.counts, self.pending = [(ids, total)], 0

    def result(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        self.settle()
        self.reduce()
        return [(0, *self.counts[0]), (1, *self.pairs[0])] if self.pairs else []


_OUT = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64())])


def _batch(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    kind = np.concatenate([np.full(len(a), k, np.int8) for k, a, _ in found])
    a, b = (np.concatenate([f[n] for f in found]).astype(np.int64) for n in (1, 2))
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b)], schema=_OUT)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)


def _groups(columns: list[np.ndarray], role: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, end, homes) of each stretch of equal rows; homes come first in it."""
    cuts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)])
    homes = np.add.reduceat((role == 0).astype(np.int64), cuts)
    return zip(cuts.tolist(), np.r_[cuts[1:], len(role)].tolist(), homes.tolist())


class _Sieve:
    """The rows of one cell that have another nearby there."""

    def __init__(self, key: int, sub: int, limit: float):
        self.key, self.sub, self.limit = key, sub, limit
        self.homes: list[tuple[np.ndarray, np.ndarray]] = []
        self.node, self.met = np.zeros(0, np.int64), np.zeros(0, bool)
        self.kept: list[tuple[int, np.ndarray]] = []

    def add(self, node: np.ndarray, at: np.ndarray) -> None:
        self.homes.append((node, at))

    @staticmethod
    def _spread(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = at.view(np.int8).reshape(-1, 8).astype(np.float32)
        return x, (x * x).sum(1)

    def settle(self) -> None:
        if self.homes:
            self.node, at = (np.concatenate(c) for c in zip(*self.homes))
            self.homes = []
            self.x, self.norm = self._spread(at)
            self.met = np.zeros(len(self.node), bool)
            if len(self.node) > 1:
                for k, near in self._near(self.x, self.norm):
                    near[np.arange(k, k + near.shape[1]), np.arange(near.shape[1])] = False
                    self.met |= near.any(1)

    def _near(self, x: np.ndarray, norm: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        step = max(1, HELD // len(self.node))
        for k in range(0, len(x), step):
            yield k, 2 * self.x @ x[k : k + step].T >= self.norm[:, None] + (norm[k : k + step] - np.float32(self.limit))

    def visit(self, role: np.ndarray, node: np.ndarray, at: np.ndarray) -> None:
        self.settle()
        if not len(self.node):
            return
        x, norm = self._spread(at)
        for k, near in self._near(x, norm):
            self.met |= near.any(1)
            hit = np.flatnonzero(near.any(0)) + k
            for r in (1, 2):
                self.kept.append((r, node[hit[role[hit] == r]]))

    def result(self) -> dict[str, np.ndarray]:
        self.settle()
        kept = [(0, self.node[self.met]), *self.kept]
        node = np.concatenate([n for _, n in kept])
        return {"key": np.full(len(node), self.key), "sub": np.full(len(node), self.sub, np.int32), "role": np.concatenate([np.full(len(n), r, np.int8) for r, n in kept]), "node": node}


def _sifter(lat: Lattice):
    """Of rows sorted by cell, homes first, those that may have a link there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found, held = None, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            key, sub, role, node, at, dims = (b.column(n).to_numpy(zero_copy_only=False) for n in ("key", "sub", "role", "node", "at", "dims"))
            for a, z, n in _groups([key, sub, dims], role):
                if a and z < len(key) and (not n or z - a == 1):
                    continue  # nobody meets here
                own = (int(key[a]), int(sub[a]), int(dims[a]))
                if now is None or own != now[0]:
                    if now is not None:
                        found.append(now[1].result())
                        held += len(found[-1]["node"])
                    now = own, _Sieve(own[0], own[1], lat.near(own[2]))
                if n:
                    now[1].add(node[a : a + n], at[a : a + n])
                if a + n < z:
                    now[1].visit(role[a + n : z], node[a + n : z], at[a + n : z])
            if held > 1 << 16:
                yield _sifted(found)
                found, held = [], 0
        if now is not None:
            found.append(now[1].result())
        if found:
            yield _sifted(found)

    return run


def _sifted(found: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array(np.concatenate([f[n] for f in found])) for n in ("key", "sub", "role", "node")})


def _comparer(lat: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, now, found, held = None, None, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            cols = {n: b.column(n).to_numpy(zero_copy_only=False) for n in ("label", "key", "sub", "role", "node", "rows")}
            size = b.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            every = _matrix(b.column("embedding"), int(size[0])) if (size == size[0]).all() else None
            for a, z, n in _groups([cols["key"], cols["sub"], cols["label"], size], cols["role"]):
                own = (cols["key"][a], cols["sub"][a], cols["label"][a], size[a])
                if a and z < len(size) and (not n or z - a == 1):
                    continue  # nobody meets here
                if now is None or own != now:
                    if cell is not None and (got := cell.result()):
                        found += got
                        held += sum(len(g[1]) for g in got)
                    now, cell = own, _Cell(lat, int(own[0]) & (1 << TABLES) - 1, int(own[3]))
                x = every[a:z] if every is not None else _matrix(b.column("embedding").slice(a, z - a), int(own[3]))
                if n:
                    cell.add(cols["node"][a : a + n], cols["rows"][a : a + n], x[:n])
                if a + n < z:
                    cell.visit(cols["role"][a + n : z], cols["node"][a + n : z], cols["rows"][a + n : z], x[n:])
            if held > 1 << 17:
                yield _batch(found)
                found, held = [], 0
        if cell is not None:
            found += cell.result()
        if found:
            yield _batch(found)

    return run


def _placer(lat: Lattice, probe: bool):
    """Rows of each cell that a vector occupies or, with ``probe``, probes; without, the cells' keys alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = whole.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for dims in np.unique(size).tolist():
                if dims > WIDEST:
                    raise ValueError(f"vectors have {dims} dimensions, more than {WIDEST}")
                every = np.flatnonzero(size == dims)
                for at in range(0, len(every), 4096):
                    b = whole.take(pa.array(every[at : at + 4096]))
                    x, label = unit(_matrix(b.column("embedding"), dims)), b.column("label").to_numpy(zero_copy_only=False)
                    for t in range(-(-dims // 8)):
                        if not probe:
                            yield pa.RecordBatch.from_pydict({"key": pa.array(keys(label, dims, t, codes(lat.homes(x, t)[0])))})
                            continue
                        row, code, role, packed = lat.places(x, t)
                        out = {"key": keys(label[row], dims, t, code), "role": np.where(role, 2, 0).astype(np.int8), "node": b.column("node").to_numpy(zero_copy_only=False)[row], "at": packed, "dims": np.full(len(row), dims, np.int32)}
                        yield pa.RecordBatch.from_pydict({n: pa.array(v) for n, v in out.items()})

    return run


def linkable(embedding: str, label: str) -> Column:
    """True for the vectors that may link: a label, and finite components that aren't all zero."""
    e = F.col(embedding)
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & fine & F.exists(e, lambda v: v != 0), F.lit(False))


def link_vectors(vectors: DataFrame, cosine: float = 0.98, cell: float = 0.35, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label).

    ``embedding`` is an array of any kind of number, ``label`` of any type that can be grouped by. Rows link if their
    labels are equal and not null and the cosine of their vectors, in double precision, is at least ``cosine``. Null
    and zero vectors, and those with null or non-finite components, link with nothing, nor do vectors of different
    length. A repeated row counts as another vector; a null vec_id is never a component_id unless no other is
    reachable, and then kept is true. ``cell`` scales the lattice: smaller cells hold fewer vectors and are probed by
    more; ValueError if linked vectors may lie more than ``REACH`` cells apart or have over ``WIDEST`` dimensions. Other
    columns are ignored; an empty table gives an empty result.
    """
    lat = Lattice(cosine, cell, seed)
    n = partitions(vectors.sparkSession)
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    vector = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", "label", vector.alias("embedding"))
    rows = rows.withColumn("fine", linkable("embedding", "label")).select("*", *_names("label", "embedding"))
    merged = rows.where("fine").groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("rows"))
    nodes = cut(merged.select("*", F.monotonically_increasing_id().alias("node"), *_names("label", "embedding")))

    placed = nodes.select(F.xxhash64("label").alias("label"), "node", "embedding")
    hot = cut(placed.mapInArrow(_placer(lat, False), "key long").groupBy("key").count().where(F.col("count") > HOT).select("key", F.ceil(F.col("count") / HOT).alias("parts")))
    dealt = placed.mapInArrow(_placer(lat, True), "key long, role tinyint, node long, at long, dims int")
    if hot.isEmpty():
        dealt = dealt.withColumn("sub", F.lit(0))
    else:
        dealt = dealt.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64("node"), F.col("parts"))
        dealt = dealt.withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        dealt = dealt.withColumn("role", F.when((F.col("role") == 0) & (F.col("sub") != own), F.lit(1)).otherwise(F.col("role")).cast("tinyint")).withColumn("sub", F.col("sub").cast("int"))
    near = dealt.repartition(n, "key", "sub").sortWithinPartitions("key", "sub", "dims", "role").mapInArrow(_sifter(lat), "key long, sub int, role tinyint, node long")
    met = near.join(nodes.select("node", "rows", F.xxhash64("label").alias("label"), F.size("embedding").alias("dims"), "embedding"), "node")
    order = ["key", "sub", "label", "dims"]
    met = cut(met.repartition(n, *order).sortWithinPartitions(*order, "role").mapInArrow(_comparer(lat), "kind tinyint, a long, b long"))

    counts = met.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    group = components(met.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = nodes.select("node", "low", "rows", "k1", "k2").join(counts, "node", "left").join(group, "node", "left")
    named = cut(named.select("k1", "k2", "low", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "component").select("k1", "k2", "n_links", "component_id")
    linked = rows.where("fine").select("vec_id", "k1", "k2").join(named, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _names(label: str, embedding: str) -> tuple[Column, Column]:
    """Two independent hashes that stand for a label and a vector in joins that must not carry them."""
    return F.xxhash64(embedding, label).alias("k1"), F.xxhash64(F.lit(0x7E11), label, embedding).alias("k2")
