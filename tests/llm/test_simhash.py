import numpy as np
import xxhash

from quantflume.llm import queries, simhash


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_groups(prints):
    group = {i: i for i in prints}
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], dtype=np.uint64)

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[k]) <= 2).tolist():
            a, b = root(i), root(ids[j])
            group[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    prints = {i: brute_fingerprint(t) for i, t in docs.items()}
    groups = brute_groups(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i in docs}
    assert len(set(groups.values())) < len(groups)


def test_tile_links_connect_what_brute_force_does():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = np.unique(base[rng.integers(0, 40, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)))
    for a, b in ((near, np.unique(base)), (near, near)):
        links = simhash.tile_links(a, b, 2, block=64)
        assert all(x != y and (x ^ y).bit_count() <= 2 for x, y in links)
        group = {int(x): int(x) for x in [*a, *b]}

        def root(x):
            while group[x] != x:
                x = group[x]
            return x

        for x, y in links:
            group[root(x)] = root(y)
        for x in a.tolist():
            for y in b.tolist():
                if (x ^ y).bit_count() <= 2:
                    assert root(x) == root(y)
        assert len(links) < len(a) + len(b)


def test_small_tiles_give_the_same_groups(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 30, dtype=np.int64)
    prints = sorted({int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 62, (20, 2))} | {0, 1, 3})
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    groups = {}
    for tile in (4, 2048):
        edges = simhash.links(df, 2, tile)
        found = simhash.components(edges.selectExpr("a src", "b dst")).collect()
        groups[tile] = {r.node: r.component for r in found}
    assert groups[4] == groups[2048]
    brute = brute_groups({p: p for p in prints})
    assert {p: c for p, c in brute.items() if list(brute.values()).count(c) > 1} == groups[4]


def test_edge_rows(spark):
    rows = [(3, None, "a"), (1, "", "b"), (None, "one two", "c"), (7, "One  TWO", "d"), (7, "one two", "d"), (9, "x y z w " * 4000, "e"), (9, "x y z w " * 4000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(False, 1, 1), (False, 3, 1), (False, 7, 7), (False, 7, 7), (False, 9, 9), (False, 9, 9), (True, 0, 7)]
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 7, 9]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    assert simhash.keep_one_each(docs.limit(0)).collect() == []


def test_keeps_each_group_whatever_its_ids(spark):
    fox, sea, ore = ("the quick brown fox jumps over a lazy dog today", "ships sail far across seven cold and stormy seas", "miners dig iron ore from deep under green hills")
    schema = "doc_id long, text string"

    def kept(rows):
        return sorted(map(tuple, simhash.keep_one_each(spark.createDataFrame(rows, schema)).collect()), key=str)

    assert kept([(None, fox), (None, sea), (None, fox)]) == sorted([(None, fox), (None, sea)], key=str)
    assert kept([(5, fox), (5, sea)]) == sorted([(5, fox), (5, sea)])
    # 7 heads the group of ore, and isn't the head of that of fox
    assert kept([(5, fox), (7, fox), (7, ore), (None, ore), (9, ore)]) == sorted([(5, fox), (7, ore)])
    assert kept([(3, fox), (3, fox), (None, sea), (None, ore), (None, fox)]) == sorted([(3, fox), (None, sea), (None, ore)], key=str)
