import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quantflume.llm import bpe, queries

PATH = queries.tokenizer_path()


def test_whole_table_against_the_library(spark, sf_dir):
    library = Tokenizer.from_file(PATH)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op4_bpe(spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, text in docs.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeilnorst'., \n<|>!0ÉßΣİ\u0301\u00a0日"), st.characters(max_codepoint=0x2FF)), max_size=40))
def test_any_text_encodes_like_the_library(text):
    library = Tokenizer.from_file(PATH) if not hasattr(test_any_text_encodes_like_the_library, "t") else test_any_text_encodes_like_the_library.t
    test_any_text_encodes_like_the_library.t = library
    own, labels = bpe.load(bpe.Tokenizer, PATH), bpe.load(bpe.Labels, PATH)
    ids = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode([text])[0], "<i4").tolist() == ids
    assert labels.decode(np.array(ids, dtype=np.int32)) == library.decode(ids, skip_special_tokens=False)


def plain_bpe(symbols, merges):
    """Merges in order of rank, leftmost first."""
    rank = {(u, v): (n, w) for n, (u, v, w) in enumerate(merges)}
    word = list(symbols)
    while True:
        best = min(((rank[p][0], k) for k, p in enumerate(zip(word, word[1:], strict=False)) if p in rank), default=None)
        if best is None:
            return word
        n, _ = best
        u, v, w = merges[n]
        out, k = [], 0
        while k < len(word):
            if word[k : k + 2] == [u, v]:
                out.append(w)
                k += 2
            else:
                out.append(word[k])
                k += 1
        word = out


def random_merges(rng):
    spelled, merges = {0: (0,), 1: (1,), 2: (2,)}, []
    while len(merges) < 8:
        u, v = (int(x) for x in rng.integers(0, len(spelled), 2))
        text = spelled[u] + spelled[v]
        if text in spelled.values() or len(text) > 6 or plain_bpe(text, merges) != [u, v]:
            if rng.random() < 0.02:
                break
            continue
        merges.append((u, v, len(spelled)))
        spelled[len(spelled)] = text
    return spelled, merges


def test_paths_are_the_encodings():
    """On random small merge lists every word has exactly one path, its encoding, and reading it symbol by symbol finds it."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        spelled, merges = random_merges(rng)
        machine = bpe.Automaton([0, 1, 2], merges)
        reader = bpe.Reader(machine, {x: tuple("abc"[k] for k in t) for x, t in spelled.items()})
        for _ in range(40):
            word = tuple(int(x) for x in rng.integers(0, 3, 9))
            paths, full = [(0, 0, [])], []
            while paths:
                at, state, path = paths.pop()
                if at == len(word):
                    full.append(path)
                for x, t in spelled.items():
                    if at < len(word) and word[at : at + len(t)] == t and machine.step(state, x) >= 0:
                        paths.append((at + len(t), machine.step(state, x), [*path, x]))
            assert full == [plain_bpe(word, merges)] == [reader.read(["abc"[k] for k in word])]


def test_encoding_follows_the_states(monkeypatch):
    """Without what the gadgets take from the states, or with tables that start anew all the time."""
    words = ["hello", "tokenization", "understanding", "internationalization", "zzzzzz"]
    right = [list(map(int, np.frombuffer(bpe.Tokenizer(PATH).encode_word(w), "<i4"))) for w in words]
    library = Tokenizer.from_file(PATH)
    assert right == [library.encode(w, add_special_tokens=False).ids for w in words]
    broken = bpe.Tokenizer(PATH)
    broken.reader.machine.gaps.clear()
    assert [list(map(int, np.frombuffer(broken.encode_word(w), "<i4"))) for w in words] != right
    monkeypatch.setattr(bpe, "CACHE_ARCS", 3)
    assert [list(map(int, np.frombuffer(bpe.Tokenizer(PATH).encode_word(w), "<i4"))) for w in words * 2] == right * 2


def test_two_merges_of_one_token_are_refused():
    with pytest.raises(ValueError):
        bpe.Automaton([0, 1], [(0, 0, 2), (0, 1, 2)])


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "Hello world.", "z"), (4, "Hello world. " * 30000, "z"), (4, "Hello world. " * 30000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    made = bpe.encode(docs, PATH)
    got = [(r.doc_id, len(r.ids), len(r.decoded)) for r in bpe.decode(made, PATH).collect()]
    one = len("hello</w> world</w> .</w>")
    assert sorted(got, key=str) == sorted([(1, 0, 0), (2, 0, 0), (None, 3, one), *[(4, 90000, 30000 * (one + 1) - 1)] * 2], key=str)
    odd = spark.createDataFrame([(None, "a"), ([None, 320, 10**6, -1], "b")], "ids array<int>, decoded string")
    assert sorted(r.decoded for r in bpe.decode(odd, PATH).collect()) == ["", "a</w>"]
    assert bpe.encode(docs.limit(0), PATH).collect() == [] == bpe.decode(made.limit(0), PATH).collect()


def test_unspaced_texts_dont_fill_a_worker():
    from quantflume.llm.common import Remembered

    rng = np.random.default_rng(5)
    own = bpe.Tokenizer(PATH)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz0123456789+/"))
    for _ in range(40):
        own.encode(["".join(rng.choice(letters, 2000)) for _ in range(10)])
    assert all(len(k) <= own.runs.longest for cache in (own.runs, own.words) for k in cache)
    learned = []
    small = Remembered(lambda w: learned.append(w) or w.encode(), 5000)
    for k in range(1000):
        assert small[f"word{k % 300}"] == f"word{k % 300}".encode()
        assert sum(len(v) + 190 for v in small.values()) <= 6000
    assert small["x" * 65] == b"x" * 65 and "x" * 65 not in small and small[""] == b""
