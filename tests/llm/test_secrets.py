import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quantflume.llm import queries, secrets

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute(text):
    """The base kinds, by the plain patterns over the whole text."""
    found = []
    for m in re.finditer(re.sub(r"[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", "(password|passwd|secret|token|api_?key)") + ASSIGN[ASSIGN.index(")") + 1 :], text):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op6_secrets(spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        want = brute(text)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == x for k, *_ in want) for x in ("assign", "access", "hex")]
        assert got[i].base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest()
        assert {*map(listed, [[w] for w in want])} <= {*got[i].spans.split(",")}
    assert sum(r.n_assign for r in got.values())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aApPiIkKeEyY_tokensr:= \"'AKIA0123456789fé\n", max_size=60), max_size=8))
def test_index_misses_nothing(texts):
    texts = [t + "api_key: " + t for t in texts] + ["AKIA" + "B" * 14, "x" * 5 + "0123456789abcdef"]
    got = secrets.find_spans(texts)
    assert [[s for s in g if s[0] in ("assign", "access", "hex")] for g in got] == [brute(t) for t in texts]


def test_queries_hold_for_every_match():
    assert secrets.trigram_query(r"[0-9a-f]{16,}") is True
    assert secrets.trigram_query("abcd") == ("and", (b"abc", b"bcd"))
    assert secrets.trigram_query("ab(c|d)e?") in (("or", (b"abc", b"abd")), ("or", (("and", (b"abc", b"bce")), b"abc", ("and", (b"abd", b"bde")), b"abd")), ("or", (b"abc", ("and", (b"abc", b"bce")), b"abd", ("and", (b"abd", b"bde")))))
    assert secrets.trigram_query("(foo)+x*bar") == ("and", (b"foo", b"bar"))
    assert secrets.trigram_query("(foo)?x") is True
    # ignored case beyond ASCII: the Kelvin sign is a k, the long s an s
    assert secrets.trigram_query("(?i)token") is True and secrets.trigram_query("(?ai)token") == ("and", (b"tok", b"oke", b"ken"))
    assert secrets.trigram_query("(?i)password") == ("and", (b"wor", b"ord"))
    assert secrets.trigram_query("xÉy") == ("and", tuple(sorted({"xÉy".encode()[i : i + 3] for i in range(2)}, key="xÉy".encode().index)))


def _fulfils(query, text):
    low = text.encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in low)
    if query is True or isinstance(query, bytes):
        return query is True or query in low
    return (all if query[0] == "and" else any)(_fulfils(q, text) for q in query[1])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="kKsSaAb\u212a\u017féÉ", max_size=14))
def test_every_match_fulfils_its_query(text):
    for pattern in ("(?i)kas", "(?i:ask)b", "(a|b|k|s){1,4}AAA", "(ab?){2,3}k", "[kKs]{2}a[éÉ]", "(?i)É?sab", "(aa|a){4}"):
        if re.search(pattern, text):
            assert _fulfils(secrets.trigram_query(pattern), text), pattern


def test_edge_rows_and_redaction(spark):
    key = "AKIA" + "Q" * 16
    rows = [(1, None, "a"), (2, "", "b"), (None, f"see {key} and password = {key}!", "c"), (4, "w " * 300000 + key, "d"), (4, "w " * 300000 + key, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(((r.doc_id or 0), [tuple(s) for s in r.spans]) for r in secrets.scan_secrets(docs).collect())
    assert got[0] == (0, [("access", 4, 24), ("assign", 29, 60), ("access", 40, 60)])
    assert got[1:3] == [(1, []), (2, [])] and got[3] == got[4] == (4, [("access", 600000, 600020)])
    out = secrets.redact_secrets(docs)
    assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[1] is None and texts[2] == "" and texts[None] == "see <access> and <assign>!" and texts[4].endswith("w <access>")
    assert secrets.scan_secrets(docs.limit(0)).collect() == [] == secrets.redact_secrets(docs.limit(0)).collect()
