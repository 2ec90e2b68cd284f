
import numpy as np
import pytest

from quantflume.llm import queries, vectors


def brute(rows, least=0.93):
    """id -> (n_links, component) of unique ids, all pairs compared."""
    by_label = {}
    for i, v, label in rows:
        if label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            by_label.setdefault((label, len(v)), []).append((i, np.array(v, dtype=float)))
    links, group = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for own in by_label.values():
        ids = np.array([i for i, _ in own])
        x = np.array([v for _, v in own])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for k, i in enumerate(ids.tolist()):
            for j in ids[x @ x[k] >= least].tolist():
                if i != j:
                    links[i] += 1
                    a, b = root(i), root(j)
                    group[max(a, b)] = min(a, b)
    return {i: (links[i], root(i)) for i in links}


@pytest.mark.parametrize("shard", [512, 40])
def test_whole_table_against_brute_force(spark, sf_dir, shard):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    df = queries.op5_vectors(spark, sf_dir)
    if shard != 512:  # with near copies planted
        rng = np.random.default_rng(3)
        rows += [(10_000 + k, (np.array(v) + 0.25 * rng.standard_normal(len(v)) * np.linalg.norm(v) / len(v) ** 0.5).tolist(), label) for k, (_, v, label) in enumerate(rows * 2)]
        df = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard=shard)
    want = brute(rows)
    got = {r.vec_id: r for r in df.collect()}
    assert got.keys() == want.keys()
    assert all(got[i].n_links <= want[i][0] for i in want)
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(n for n, _ in want.values())
    assert np.mean([got[i].component_id == want[i][1] for i in want]) > 0.98
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())


def test_groups_of_copies_and_near_copies_in_cut_shards(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((40, 16))
    rows = [(i, x[i].tolist(), 1) for i in range(40)]
    rows += [(100 + i, (x[3] + 0.03 * rng.standard_normal(16)).tolist(), 1) for i in range(300)]
    rows += [(1000 + i, x[5].tolist(), 1) for i in range(200)]
    want = brute(rows)
    for shard in (20, 1024):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
        got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df, shard=shard).collect()}
        assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in want.items()}
        assert sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in want.values())
        assert all(got[i][0] <= want[i][0] for i in want)


def test_balls_beside_each_other(spark):
    """Dense groups, some near each other and with vectors around them, in clusters that are split: every link counted once."""
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    a = unit(rng.standard_normal(12))
    b = unit(a + 0.36 * unit(rng.standard_normal(12)))  # some 20 degrees off
    parts = [unit(rng.standard_normal((300, 12)))]
    parts += [unit(c + s * unit(rng.standard_normal((k, 12)))) for c, s, k in ((a, 0.08, 150), (b, 0.08, 130), (a, 0.3, 60), (b, 0.25, 60), (unit(rng.standard_normal(12)), 0.05, 100))]
    x = np.concatenate(parts)
    rows = [(int(i), x[i].tolist(), 1) for i in range(len(x))] + [(10_000 + i, x[310 + i].tolist(), 1) for i in range(40)]
    want = brute(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for shard in (60, 30):
        got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df, shard=shard).collect()}
        assert all(got[i][0] <= want[i][0] for i in want)
        assert sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in want.values())
        assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.98


def test_more_large_labels_than_any_bound(spark):
    """Every label over a shard is clustered, however many there are, and samples stay small."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((60 * 30, 8))
    x[1::2] = x[::2] + 0.05 * rng.standard_normal((900, 8))
    rows = [(k, x[k].tolist(), k // 30) for k in range(len(x))]
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard=8, fit_rows=20).collect()}
    assert sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in want.values()) and all(got[i][0] <= want[i][0] for i in want)


def test_graph_search_recall():
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((60, 32))
    x = np.repeat(centre, 12, axis=0) + 0.15 * rng.standard_normal((720, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = vectors.shard_links(x, vectors.build_graph(x.astype(np.float32)), x, 0.93)
    truth = [set(np.flatnonzero(x @ v >= 0.93).tolist()) for v in x]
    assert all(set(f.tolist()) <= t for f, t in zip(found, truth, strict=True))
    assert sum(map(len, found)) >= 0.97 * sum(map(len, truth))


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1, 0), (2, [], 1, 0), (3, [0.0, 0.0], 1, 0), (4, [1.0, nan], 1, 0), (5, [1.0, inf], 1, 0), (6, [1.0, None], 1, 0), (7, [1.0, 1.0], None, 0), (None, [1.0, 1.0], 1, 0)]
    rows += [(9, [1.0, 1.0], 1, 0), (10, [2.0, 2.0], 1, 0), (10, [2.0, 2.0], 1, 0), (11, [1.0, 1.0], 2, 0), (12, [1.0, 1.0, 0.0], 1, 0), (13, [1.0, 1.001], 1, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, kept int")
    out = vectors.near_duplicates(df)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect()), key=str)
    want = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 11, 12)] + [(None, 0, None, False), (9, 3, 9, True), (10, 3, 9, False), (10, 3, 9, False), (13, 3, 9, False)]
    assert got == sorted(want, key=str)
    assert vectors.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [30, 700])
def test_huge_and_tiny_vectors_link_like_any(spark, n):
    """Components whose squares under- or overflow, below and above a shard's size."""
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 4))
    near = x + 0.05 * rng.standard_normal((n, 4))
    sizes = np.array([1e200, 1e-200, 1.0, 1e300, 1e-305])
    one = np.concatenate([x, near])
    scaled = one * rng.choice(sizes, (2 * n, 1))
    rows = [(k, v.tolist(), 1) for k, v in enumerate(scaled)] + [(10**6, [5e-324, 0.0, 0.0, 0.0], 1), (10**6 + 1, [1e308, 1e306, 0.0, 0.0], 1)]
    plain = [(k, v.tolist(), 1) for k, v in enumerate(one)] + [(10**6, [1.0, 0.0, 0.0, 0.0], 1), (10**6 + 1, [1.0, 0.01, 0.0, 0.0], 1)]
    want = brute(plain)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got[10**6][0] > 0 and sum(c for c, _ in got.values()) >= 0.95 * sum(c for c, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)


def test_linked_vectors_share_a_part():
    """Of any two that link, one sits in the other's part, whatever the centres."""
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    for dims, least in ((3, 0.93), (6, 0.93), (6, 0.5), (2, 0.99)):
        x = unit(rng.standard_normal((600, dims)))
        centres = unit(np.concatenate([rng.standard_normal((12, dims)), x[:5], x[:2]]))
        link = float(np.arccos(least))
        seats = {}
        for home in (True, False):
            row, part, first = vectors.parts_of(x, np.full(len(x), home), centres, link)
            seats[home] = np.zeros((len(x), len(centres)), dtype=bool)
            seats[home][row, part] = True
            own = np.empty(len(x), dtype=int)
            own[row[first]] = part[first]
        a, b = np.nonzero(np.triu(x @ x.T >= least, 1))
        assert (seats[True][a, own[b]] | seats[True][b, own[a]]).all()
        assert seats[False][a, own[b]].all()


@pytest.mark.parametrize(("inner", "dims", "n"), [(4, 64, 3000), (6, 96, 3000), (3, 128, 2000)])
def test_vectors_without_clusters(spark, inner, dims, n):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, inner))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ np.linalg.qr(rng.standard_normal((dims, inner)))[0].T
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    want = (x @ x.T >= 0.93).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard=150).collect()}
    found = np.array([got[i] for i in range(n)])
    assert (found <= want).all()
    assert found.sum() >= 0.99 * want.sum()


def test_clusters_whose_parts_would_copy_vectors_too_often_stay_whole():
    rng = np.random.default_rng(3)
    link, half = float(np.arccos(0.93)), ((1 + 0.93) / 2) ** 0.5
    scattered = vectors._unit(rng.normal(size=(2000, 64)))
    groups = vectors._unit(np.repeat(np.eye(64)[:40], 50, axis=0) + 0.01 * rng.normal(size=(2000, 64)))
    for x, parts in ((scattered, [1]), (groups, range(2, 65))):
        centres, _ = vectors.fit_parts(x, 40_000, 1024, half, link)
        assert len(centres) in parts
        assert len(vectors.parts_of(x, np.ones(len(x), dtype=bool), centres, link)[0]) <= vectors.MOST_PARTS * len(x)
