from collections import Counter
from math import log, sqrt

from quantflume.llm import licenses, queries

LEAST = 0.7


def brute(files, templates=licenses.TEMPLATES):
    """path, text pairs -> (license, inherited from), with no shortcut."""
    docs = [set(licenses.tokens(t or "")) for _, t in files]
    n = len(files)
    idf = lambda w: log((1 + n) / (1 + sum(w in d for d in docs))) + 1
    notices = [(name, licenses.tokens(x)) for name, xs in templates.items() for x in xs]
    seen = {}

    def idf_of(w):
        if w not in seen:
            seen[w] = idf(w)
        return seen[w]

    def weigh(words):
        return {w: c * idf_of(w) for w, c in Counter(words).items()}

    def cosine(a, b):
        a, b = weigh(a), weigh(b)
        return sum(x * b.get(w, 0) for w, x in a.items()) / sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    own = []
    for _, text in files:
        words = licenses.tokens(text or "")
        each = []
        for name, x in notices if words else []:
            each.append((max(cosine(words[a : a + len(x)], x) for a in range(max(1, len(words) - len(x) + 1))), len(x), name))
        each = [e for e in each if e[0] >= LEAST]
        choice, among = (0.0, 0, None), each
        while among:
            choice = max(among, key=lambda e: (round(e[0], 9), e[1]))
            among = [e for e in each if e[1] >= 2 * choice[1] and e[0] >= choice[0] - licenses.NEAR]
        own.append((choice[0], choice[2]))
    by_folder = {}
    for (path, _), (score, name) in zip(files, own, strict=True):
        if name and path is not None and path.split("/")[-1].lower().startswith(("license", "copying", "notice")):
            by_folder.setdefault("/".join(path.split("/")[:-1]), []).append((score, path.split("/")[-1], name))
    out = []
    for (path, _), (_, name) in zip(files, own, strict=True):
        found = None
        if name is None and path is not None:
            parts = path.split("/")[:-1]
            found = next((d for k in range(len(parts), -1, -1) if (d := "/".join(parts[:k])) in by_folder), None)
        out.append((name or (max(by_folder[found])[2] if found is not None else None), found))
    return out


def test_small_tree_against_brute_force(spark):
    files = [
        ("a/LICENSE", "MIT License stuff\n\nReleased under the MIT License."),
        ("a/b/x.py", "code code code"),
        ("a/b/c/y.py", "more code\n# Licensed under the Apache License, Version 2.0 (the License)\ncode"),
        ("a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("a/b/c/d/z.py", "words"),
        ("q/z.py", "All rights reserved."),
        ("q/w.py", None),
        ("top.txt", ""),
        ("q/notice.txt", "nothing here"),
        (None, "Licensed under CC BY-NC 4.0"),
        (None, "no path"),
        ("a/b/x.py", "code code code"),
    ]
    df = spark.createDataFrame(files, "path string, text string")
    got = sorted(((r.path, r.license, r.inherited_from) for r in licenses.scan_licenses(df).collect()), key=str)
    want = sorted(((p, *w) for (p, _), w in zip(files, brute(files), strict=True)), key=str)
    assert got == want
    assert ("a/b/c/d/z.py", "GPL-3.0", "a/b/c") in want and ("a/b/x.py", "MIT", "a") in want
    rooted = spark.createDataFrame([*files, ("LICENSE", "Released under the ISC License")], "path string, text string")
    assert {(r.license, r.inherited_from) for r in licenses.scan_licenses(rooted).where("path = 'q/w.py'").collect()} == {("ISC", "")}


def test_whole_table_finds_the_notices(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op3_licenses(spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    planted = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "Proprietary"}
    for i, text in docs.items():
        names = {name for notice, name in planted.items() if notice in text}
        assert (got[i].own_license in names) if names else got[i].own_license is None, text
    speaking = {i for i, r in got.items() if i % 20 == 0 and r.own_license}
    assert (sum(r.inherited_from is not None for r in got.values()) > 0) == bool(speaking)


def test_edge_rows(spark):
    rows = [("a/LICENSE", None, 1.0), ("a/b", "x " * 200000 + "\nReleased under the MIT License.", 2.0), ("", "", 3.0)]
    df = spark.createDataFrame(rows, "path string, text string, license double")
    out = licenses.scan_licenses(df)
    assert out.columns == ["path", "own_license", "own_score", "own_line", "license", "inherited_from"]
    assert sorted(r.own_license or "" for r in out.collect()) == ["", "", "MIT"]
    assert licenses.scan_licenses(df.limit(0)).collect() == []


def true_cosine(line, notice, texts):
    """TF-IDF cosine of two lines, every word counted over all texts."""
    docs = [set(licenses.tokens(t)) for t in texts]
    a, b = ({w: c * (log((1 + len(docs)) / (1 + sum(w in d for d in docs))) + 1) for w, c in Counter(licenses.tokens(x)).items()} for x in (line, notice))
    return sum(x * b.get(w, 0) for w, x in a.items()) / sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))


def test_every_word_counts_over_the_corpus(spark):
    notice, line = "Released under the MIT License", "Released here under the MIT License"
    for n in (100, 2000):
        texts = ["it was here and the work was under it"] * (n - n // 50) + [notice] * (n // 50 - 1) + [line]
        rows = [(f"d/{k}", t) for k, t in enumerate(texts)]
        got = {r.path: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}[f"d/{n - 1}"]
        # the best window of the template's five words, whichever of the two it is
        want = max(true_cosine(" ".join(line.split()[a : a + 5]), notice, texts) for a in range(2))
        assert got.own_license == "MIT" and abs(got.own_score - want) < 1e-6


HEADS = {
    "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n",
    "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n\n      \"License\" shall mean the terms and conditions for use, reproduction,\n      and distribution as defined by Sections 1 through 9 of this document.\n",
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\nint main;",
}


def test_wrapped_headers_and_licence_files(spark):
    """Texts over many lines, with comment signs before them, among other text; a long licence wins over a shorter one that it holds."""
    import textwrap

    wrap = lambda text, sign: "\n".join(sign + x for x in textwrap.wrap(text, 72))
    rows = [(f"h/{name}", name, text) for name, text in HEADS.items()]
    for name, notices in licenses.TEMPLATES.items():
        rows += [(f"t/{name}{k}{len(sign)}", name, f"Copyright 2020 somebody\n\n{wrap(t, sign)}\n\nother code x = y + z\n") for k, t in enumerate(notices) for sign in ("", " * ", "# ")]
    files = [(p, t) for p, _, t in rows] + [(f"x/{k}", f"plain words of file {k} and more of them") for k in range(300)]
    got = {r.path: r for r in licenses.scan_licenses(spark.createDataFrame(files, "path string, text string")).collect()}
    wrong = {p: got[p].own_license for p, name, _ in rows if got[p].own_license != name}
    assert not wrong
    assert all(got[p].own_license is None for p, _ in files if p.startswith("x/"))
    assert got["t/MIT00"].own_line == 2


def test_whole_table_against_brute_force(spark, sf_dir):
    """Every window of every document and every word counted, on the documents that hold a template's word of three letters and more."""
    small = {k: v for k, v in licenses.TEMPLATES.items() if k in ("MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0", "Proprietary")}
    short = {k: [t for t in v if len(t) < 100] for k, v in small.items()}
    docs = [(str(r.doc_id), r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    got = {r.path: r.own_license for r in licenses.scan_licenses(spark.createDataFrame(docs, "path string, text string"), templates=short).collect()}
    own = dict(zip((p for p, _ in docs), (w[0] for w in brute(docs, short)), strict=True))
    assert got == own and sum(v is not None for v in own.values()) > 10


def test_a_filter_of_words_in_place_of_a_list(spark, monkeypatch):
    """Beyond what the driver may hold, counts are the same."""
    rows = [(k, f"d{k % 5}/f{k}.txt", t) for k, t in enumerate(["Released here under the MIT License", "Licensed under the Apache License, Version 2.0 zebra", "plain words of no licence", "This was released under the MIT License here"] * 30)]
    files = spark.createDataFrame(rows, "id long, path string, text string")
    want = sorted(map(tuple, licenses.scan_licenses(files).collect()))
    monkeypatch.setattr(licenses, "HELD_WORDS", 3)
    assert sorted(map(tuple, licenses.scan_licenses(files).collect())) == want
    assert any(r[2] for r in want)
    words = spark.createDataFrame([(f"w{k}",) for k in range(500)], "word string")
    found = licenses.sketch(words)
    assert found.pick([f"w{k}" for k in range(500)]) == {f"w{k}" for k in range(500)}
    assert len(found.pick([f"other{k}" for k in range(2000)])) < 5
