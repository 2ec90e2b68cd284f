import hashlib
import random

from quantflume.llm import tries

BLANKS = " \t\n\x0b\x0c\r"


def brute(rows):
    """(id, keep_id, group_size, kept, sha) of (id, text) rows, by plain dictionaries."""
    bare = lambda t: "".join(c for c in t or "" if c not in BLANKS)
    groups = {}
    for id_, text in rows:
        groups.setdefault(bare(text), []).append((-len(text or ""), id_ is None, id_))
    out, taken = [], set()
    for id_, text in rows:
        group = groups[bare(text)]
        own = (-len(text or ""), id_ is None, id_)
        best = min(group, key=lambda x: (x[0], x[1], x[2] or 0))
        kept = own == best and bare(text) not in taken
        if kept:
            taken.add(bare(text))
        out.append((id_, best[2], len(group), kept, hashlib.sha256(bare(text).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sha string, size int").repartition(3)
    return sorted(map(tuple, tries.exact_duplicates(docs, **more).collect()), key=str)


def test_edge_rows(spark):
    rows = [(3, None), (1, ""), (5, " \t\n"), (None, "one two"), (7, "onetwo"), (8, "o n e\x0btwo"), (9, "one two"), (9, "one two"), (4, "x" * 300_000), (6, "x" * 299_999 + " x"), (2, "x" * 300_000), (None, "é"), (None, "é"), (11, "É"), (12, "😀 a"), (10, "😀a ")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_strings_that_begin_one_another_spill_and_salts(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(150)]
    texts = base + [b[: rng.randint(0, len(b))] for b in base] + [" ".join(b) for b in base] + ["hot text"] * 300
    rows = [(rng.randint(0, 400) if rng.random() > 0.1 else None, t) for t in texts]
    want = brute(rows)
    same = lambda got: [(r[0], r[1], r[2], r[4]) for r in got] == [(r[0], r[1], r[2], r[4]) for r in want] and sum(r[3] for r in got) == sum(r[3] for r in want)
    assert same(run(spark, rows))
    assert same(run(spark, rows, trie_bytes=9000))
    assert same(run(spark, rows, hot_share=10, trie_bytes=20_000))


def test_a_trie_holds_each_string_once():
    rng = random.Random(1)
    words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    trie = tries.Trie()
    for k, w in enumerate(words):
        assert trie.insert(w, [(0, False, k), 1, 1, None])
    found = {w: v for w, v in trie.terminals()}
    assert set(found) == set(words)
    assert all(found[w][0][2] == words.index(w) and found[w][1] == words.count(w) for w in set(words))


def test_spilled_subtrees_stay_closed():
    rng = random.Random(2)
    trie, held, out = tries.Trie(30_000), {}, []
    words = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    for w in words:
        if not trie.insert(w, [(0, False, 0), 1, 1, None]):
            out.append((w, 1))
        out += [(w, v[1]) for w, v in trie.spill()]
        assert trie.bytes <= 30_000
    held = {w: v[1] for w, v in trie.terminals()}
    spilled = {w for w, _ in out}
    assert spilled and held and not spilled & set(held)
    assert sum(held.values()) + sum(n for _, n in out) == len(words)
    assert trie.bytes == trie.weight(trie.root) - tries.NODE_BYTES


def test_keep_owners(spark):
    rows = [(2, "a b"), (1, "ab"), (2, "a b"), (None, "z"), (4, "z"), (2, "ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = tries.keep_owners(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [(2, "a b"), (4, "z")]
