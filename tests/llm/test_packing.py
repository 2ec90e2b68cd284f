import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from quantflume.llm import packing, queries

PATH = queries.tokenizer_path()


def whole_ids(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


def check(pieces, docs, size=4096):
    """Every id in exactly one piece; sequences gapless, full or a power of two long."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    tokenizer = Tokenizer.from_file(PATH)
    assert by_doc.keys() == docs.keys()
    for i, text in docs.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size and at & (at - 1) == 0


def test_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check(queries.op7_packing(spark, sf_dir).collect(), docs)


def test_words_encode_like_whole_texts():
    odd = ["it's 12, don't.", "İstanbul ΑΣ. ΑΣ", "a..b ..", "X<|endoftext|>Y. <|ENDOFTEXT|>", "ﬁx ß. 日本. \x1cab a\u00a0b", "e\u0301. E\u0301,", " \n\n\t x", "é,é.", ".", ",", "a.,", "ÀÉ ŀ ɐ.", "x\u2028y"]
    tokenizer = Tokenizer.from_file(PATH)
    for got, text in zip(packing.encoder(PATH).encode(odd), odd, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_stems_known_before_their_signs():
    """A word alone, then with signs behind it, in one encoder; the lower case of some letters holds a mark."""
    tokenizer, own = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    stems = ["GAZETESİ", "İ", "Haus", "É", "ŉ", "ﬁ", "ΑΣ", "ǰ", "e\u0301", "ẞ", "日本", "it's", "x1", "K", "ĿA"]
    words = stems + [s + t for s in stems for t in [*packing.SIGNS, "...", "!?", "'", "<", "|>"]]
    for text in [*words, "GAZETESİ GAZETESİ."]:
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_balance_fills_sequences_and_spreads_cost():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 900, 300).tolist() + [9000]
    placed = packing.balance(lengths, 1024, 1.0, 1 / 256)
    assert [sum(p[1] for p in pieces) for pieces in placed] == lengths
    used, cost = defaultdict(int), defaultdict(float)
    for pieces in placed:
        for _, n, k, offset in pieces:
            used[k] += n
            cost[k] += n + n * n / 256
    assert [used[k] for k in sorted(used)] == packing.capacities(sum(lengths), 1024)
    full = [cost[k] for k in used if used[k] == 1024]
    in_order = np.add.reduceat(np.array(lengths[:300], float) ** 2, range(0, 300, 2))
    assert np.std([c for c in full if c < 4000]) < np.std(in_order)


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (4, "Hello world. " * 20000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string").repartition(1)
    pieces = packing.pack_documents(docs, PATH, shard_tokens=500).selectExpr("*", "crc32(ids) ids_crc32").collect()
    check(pieces, {i: t for i, t, _ in rows})
    twice = packing.pack_documents(docs.union(docs).selectExpr("cast(null as long) doc_id", "text"), PATH)
    assert sum(r.length for r in twice.collect()) == 2 * sum(len(whole_ids(t)) for _, t, _ in rows)
    assert packing.pack_documents(docs.limit(0), PATH).collect() == []
