import random
import re
from collections import Counter, defaultdict

import numpy as np

from quantflume.llm import divergence


def brute(rows, least=3, listed=200):
    """Straight from the definition, in Python's whole numbers."""
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= least]
        count = defaultdict(Counter)
        for _, source, terms in mine:
            count[source].update(terms)
        v = len(kept)
        share = lambda c, n, v=v: 1 + 10**9 * (c + 1) // (n + v)
        shares = {s: {t: share(c[t], sum(c[x] for x in kept)) for t in kept} for s, c in count.items()}
        whole = Counter()
        for c in count.values():
            whole.update(c)
        q = {t: share(whole[t], sum(whole[x] for x in kept)) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in count:
            pairs = [(o, sum(f(shares[s][t], shares[o][t]) for t in kept)) for o in count if o != s]
            terms = [(t, f(shares[s][t], q[t])) for t in kept if count[s][t] and shares[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, listed)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def run(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "text string, lang string, source string, term string").repartition(3)
    return sorted(map(tuple, divergence.source_divergence(docs, **more).collect()))


def test_edge_rows(spark):
    rows = [("a b", "en", "s"), ("A, b", "en", "t"), ("a", "en", None), (None, "en", "u"), ("", "en", "s"), ("ß É éİ 一二", None, "s"), ("É", None, "s"), ("É é", None, ""), ("É", "", None), ("only here", "xx", "s"), (None, None, None), ("a b", "en", "s"), ("a b", "en", "s"), ("w " * 40_000, "long", "s"), ("w", "long", "t"), ("w", "long", "u")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_many_columns_in_several_tasks(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = [(" ".join(rng.choice(words[: rng.randint(5, 100)]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de"]), rng.choice("sssstuvwx")) for _ in range(300)]
    want = brute(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, columns=7) == want
    assert run(spark, rows, listed=3) == brute(rows, listed=3)


def test_only_terms_of_listed_columns_are_moved(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(" ".join(f"w{rng.choice('abcdefgh')}{'x' * rng.randint(1, 9)}" for _ in range(40)), "en", rng.choice("stuv")) for _ in range(200)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    seen, cut = [], divergence.cut_lineage
    monkeypatch.setattr(divergence, "cut_lineage", lambda df: seen.append(df.columns) or cut(df))
    out = divergence.source_divergence(docs, listed=2)
    assert sorted(map(tuple, out.collect())) == brute(rows, listed=2)
    # what is ranked carries numbers, and terms meet the listed columns' hashes before they are grouped
    assert ["lang", "source", "id", "h", "value"] in seen
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(divergence, "SENT", 0)
    assert sorted(map(tuple, divergence.source_divergence(docs, listed=2).collect())) == brute(rows, listed=2)


def test_shares_of_large_counts_are_exact():
    count = np.array([0, 1, 10**9, 7 * 10**12, 10**15 - 1])
    total = 10**15 + 12345
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in count]
