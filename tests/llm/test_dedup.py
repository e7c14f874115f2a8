from collections import Counter

import numpy as np
import pytest
import xxhash

from tellurion.llm import components, lattice, simhash


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps, lows):
    """Smallest id reachable, by flooding over all pairs."""
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for f in fps:
            for g in fps:
                if (f ^ g).bit_count() <= 2 and label[g] < label[f]:
                    label[f], changed = label[g], True
    low = {}
    for f in fps:
        if lows[f] is not None:
            low[label[f]] = min(low.get(label[f], lows[f]), lows[f])
    return {f: low.get(label[f]) for f in fps}


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_simhash_equals_brute_force(table, request):
    rows = request.getfixturevalue(table)
    given = [(r.doc_id, r.text) for r in rows.collect()]
    got = simhash.near_duplicates(rows).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in given)
    assert Counter((r.doc_id, r.fp & (2**64 - 1)) for r in got) == Counter((d, brute_fingerprint(t)) for d, t in given)
    lows = {}
    for d, t in given:
        f = brute_fingerprint(t)
        lows[f] = min((x for x in (lows.get(f), d) if x is not None), default=None)
    expected = brute_components(list(lows), lows)
    assert all(r.component_id == expected[r.fp & (2**64 - 1)] for r in got)


def test_anchors_meet_for_every_pair_within_two_bits():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = int(rng.integers(0, 1 << 63))
        y = x
        for b in rng.choice(64, int(rng.integers(0, 3)), replace=False):
            y ^= 1 << int(b)
        met = False
        for block in (0, 1):
            a, b = (set(simhash.anchors(np.array([v], np.uint64), block)[1].tolist()) for v in (x, y))
            met |= bool(a & b)
        assert met


@pytest.mark.parametrize("limit", [4096, 16])
def test_links_join_what_brute_force_joins(limit, monkeypatch):
    monkeypatch.setattr(simhash, "ENUMERATE", limit)
    rng = np.random.default_rng(2)
    center = int(rng.integers(0, 1 << 62))
    fp = {center}
    while len(fp) < 200:
        v = center
        for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
            v ^= 1 << int(b)
        fp.add(v)
    fp = np.array(sorted(fp), np.uint64)
    i, j = simhash._links(fp)
    root = simhash._roots(len(fp), i, j)
    expected = simhash._roots(len(fp), *np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None]) <= 2))
    assert (root == expected).all()


def test_keep_one_keeps_columns_and_one_row_of_each_group(odd, empty):
    kept = simhash.keep_one(odd).collect()
    assert kept and list(kept[0].asDict()) == odd.columns
    ids = Counter(r.doc_id for r in kept)
    assert ids[1] == 1 and ids[2] == 0 and ids[3] == 0  # copies and near copies of 1
    assert ids[12] == 2  # the repeated row once, and another text under the same id
    assert ids[5] == 1 and ids[6] == 0 and ids[7] == 0  # empty and blank texts are one group
    assert simhash.keep_one(empty).collect() == []
    assert simhash.near_duplicates(empty).collect() == []


def test_components_of_a_long_path_and_a_hub(spark):
    n = 300
    path = [(i, i + 1) for i in range(n)]
    hub = [(1000, 1001 + i) for i in range(200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame([*path, *hub, (5, 5), (None, 3)], "u long, v long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000 + i: 1000 for i in range(201)}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 64))
    rows, k = [], 0
    for b in base:
        for scale in (0.0, 0.1, 0.2, 0.25, 0.3):
            v = b + scale * np.linalg.norm(b) * (lambda g: g / np.linalg.norm(g))(rng.normal(size=64))
            rows.append((k, [float(np.float32(x)) for x in v], k % 2 if k % 7 else 0))
            k += 1
    first = rows[0][1]
    rows += [(900, first, 0), (901, first, 0), (902, [2 * x for x in first], 0), (903, first, None), (904, None, 0), (905, [0.0] * 64, 0)]
    rows += [(906, [float("nan"), *first[1:]], 0), (907, [None, *first[1:]], 0), (908, [float("inf"), *first[1:]], 0), (909, first[:10], 0), (909, first[:10], 0), (None, first, 0), (910, [], 0)]
    return rows


@pytest.mark.parametrize("hot", [4096, 3])
def test_lattice_equals_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(lattice, "HOT", hot)
    rows = vectors()
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, label int, node int, rows int, cell int")
    got = lattice.link_vectors(frame).collect()
    assert Counter(r.vec_id for r in got) == Counter(r[0] for r in rows)

    def fine(v, label):
        return v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def linked(i, j):
        (_, a, la), (_, b, lb) = rows[i], rows[j]
        if i == j or not fine(a, la) or not fine(b, lb) or la != lb or len(a) != len(b):
            return False
        a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
        return a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98

    n = len(rows)
    links = [[j for j in range(n) if linked(i, j)] for i in range(n)]
    expected = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        expected.append((rows[i][0], len(links[i]), low, rows[i][0] == low))
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == Counter(expected)


@pytest.mark.parametrize(("kind", "label", "cell"), [("float", "int", 0.35), ("double", "string", 0.35), ("float", "string", 0.2), ("double", "double", 0.5)])
def test_lattice_finds_every_link_of_many_vectors(spark, kind, label, cell):
    """Groups from tight to loose among others, in vectors and labels of any type: counts and groups equal brute force."""
    rng = np.random.default_rng(6)
    dims, x, labels = 20, [], []
    for g in range(60):
        center = rng.normal(size=dims)
        for _ in range(int(rng.integers(1, 25))):
            noise = rng.normal(size=dims)
            x.append((center / np.linalg.norm(center) + rng.choice([0.01, 0.08, 0.16, 0.25]) * noise / np.linalg.norm(noise)) * rng.choice([1, 30]))
            labels.append(g % 3)
    x = np.float32(x).astype(float) if kind == "float" else np.array(x)
    frame = spark.createDataFrame([(k, v.tolist(), str(n)) for k, (v, n) in enumerate(zip(x, labels))], f"vec_id long, embedding array<{kind}>, label string").selectExpr("*", f"cast(label as {label}) as l").drop("label").withColumnRenamed("l", "label")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)) & ~np.eye(len(x), dtype=bool)
    root = simhash._roots(len(x), *np.nonzero(linked))
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.link_vectors(frame, cell=cell).collect()}
    assert got == {k: (int(linked[k].sum()), int(root[k])) for k in range(len(x))}
    assert linked.sum() > 500


def test_lattice_takes_vectors_of_whole_numbers_and_refuses_too_wide_ones(spark):
    frame = spark.createDataFrame([(1, [1, 2], "a"), (2, [2, 4], "a"), (3, [4, 2], "a")], "vec_id long, embedding array<int>, label string")
    assert {r.vec_id: (r.n_links, r.component_id) for r in lattice.link_vectors(frame).collect()} == {1: (1, 1), 2: (1, 1), 3: (0, 3)}
    with pytest.raises(ValueError, match="8193 dimensions"):
        import pyarrow as pa

        wide = pa.RecordBatch.from_pydict({"label": pa.array([1]), "node": pa.array([1]), "embedding": pa.array([[1.0] * 8193])})
        list(lattice._placer(lattice.Lattice(0.98, 0.35, 7), True)([wide]))


def test_lattice_links_cells_of_squared_norm_8(spark):
    """Two vectors of cosine 0.95 near the shallow holes between two such cells, beside vectors of other lengths."""
    apart = np.array([2.0, 1, 1, 1, 1, 0, 0, 0])
    home = np.array([-3.0, 0, 0, 1, 1, -1, 0, 0])  # from which both are equally far
    at = home + np.array([[0.33], [0.67]]) * apart
    assert ((lattice.nearest(at) - home) == [[0.0] * 8, apart]).all()
    length = np.sqrt((at**2).sum(1))
    assert np.allclose(length, length[0])
    x = at / length[:, None] @ lattice.rotation(8, 7).T
    assert x[0] @ x[1] > 0.95
    wide = np.random.default_rng(5).normal(size=64)
    frame = spark.createDataFrame([(0, wide.tolist(), 1), (1, x[0].tolist(), 1), (2, x[1].tolist(), 1)], "vec_id long, embedding array<float>, label int").coalesce(1)
    assert {r.vec_id: r.n_links for r in lattice.link_vectors(frame, 0.95, 1 / length[0]).collect()} == {0: 0, 1: 1, 2: 1}


def test_lattice_says_where_it_would_have_to_probe_too_far():
    with pytest.raises(ValueError, match="larger cell"):
        lattice.Lattice(0.5, 0.3, 7).places(np.eye(8), 0)


def test_lattice_on_an_empty_table(spark):
    assert lattice.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_nearest_lattice_point_is_nearest():
    rng = np.random.default_rng(4)
    y = rng.normal(size=(50, 8)) * 2
    near = lattice.nearest(y)
    others = near[:, None] + lattice._shells()[None]
    assert (((y - near) ** 2).sum(1) <= ((y[:, None] - others) ** 2).sum(2).min(1) + 1e-9).all()
    assert ((2 * near) % 1 == 0).all() and (near.sum(1) % 2 == 0).all()
