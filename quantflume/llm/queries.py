"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantflume.llm import bpe, divergence, language, licenses, minhash, packing, quality, repair, secrets, simhash, substrings, tries, vectors
from quantflume.llm.common import table
from quantflume.llm.neural import held_out


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where this machine keeps a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens; see ``packing.pack_documents``."""
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents; see ``language.train`` and ``language.identify``."""
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.train(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts; see ``minhash.compare_with_next``."""
    found = minhash.compare_with_next(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents as files; see ``licenses.scan_licenses``.

    Documents have no paths, so they get some: folders of 200 and of 20 ids; in
    each folder the first document is its LICENSE.
    """
    at = lambda n: (F.floor(F.col("doc_id") / n) * n).cast("string")
    path = F.when(F.col("doc_id") % 200 == 0, F.concat_ws("/", at(200), F.lit("LICENSE"))).when(F.col("doc_id") % 20 == 0, F.concat_ws("/", at(200), at(20), F.lit("LICENSE")))
    path = F.coalesce(path, F.concat_ws("/", at(200), at(20), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return licenses.scan_licenses(files)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and the texts of those ids; see ``bpe.encode``."""
    done = bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), decoded=True)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings; see ``vectors.near_duplicates``."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents as counts and spans; see ``secrets.scan_secrets``."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.RULES if r.base]
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, base), F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; see ``quality.train`` and ``quality.score_quality``."""
    docs = table(spark, sf_dir, "documents")
    found = quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents; see ``simhash.near_duplicates``."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated passages; see ``substrings.repeated_spans``."""
    found = substrings.repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents and the row of each that stays; see ``tries.exact_duplicates``."""
    return tries.exact_duplicates(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far all sources of all languages part from each other; see ``divergence.source_divergence``."""
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repairs of all conversations; see ``repair.repair_conversations``."""
    return repair.repair_conversations(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_minhash": op2_minhash,
    "op3_licenses": op3_licenses,
    "op4_bpe": op4_bpe,
    "op5_vectors": op5_vectors,
    "op6_secrets": op6_secrets,
    "op7_packing": op7_packing,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_substrings": op10_substrings,
    "op11_tries": op11_tries,
    "op12_divergence": op12_divergence,
    "op13_repair": op13_repair,
}

def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: The kinds of secrets as RE2 patterns with the group whose length counts and the least length, in the order of a tie.
_KINDS = {
    "assign": ("(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|[aA][pP][iI]_?[kK][eE][yY]" + """)["\']?\\x20*[:=]\\x20*["\']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": ("AKIA[A-Z0-9]+", 0, 18),
    "hex": ("[0-9a-f]{16,}", 0, 16),
    "pem": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    "repo_token": ("gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    "chat_token": ("xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
}


def _kind_sql(rank: int, kind: str) -> str:
    """All matches of a kind with their places: what lies between them has the lengths of the text's pieces."""
    pattern, group, least = _KINDS[kind]
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, i, list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS a, length(whole[i]) AS n
FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {quoted}) AS whole, regexp_extract_all(text, {quoted}, {group}) AS part, string_split_regex(text, {quoted}) AS pieces FROM d))
WHERE length(part[i]) >= {least}"""


_BASE = ("assign", "access", "hex")

#: DuckDB SQL of the queries that SQL can express over whole tables.
ORACLES: dict[str, str] = {
    "op6_secrets": "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ("
    + " UNION ALL ".join(_kind_sql(k, kind) for k, kind in enumerate(_KINDS))
    + "), s AS (SELECT doc_id, rank, kind, a::BIGINT AS a, kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT AS x FROM m) SELECT d.doc_id, "
    + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _BASE)
    + ", sha256(coalesce(string_agg(x, ',' ORDER BY a, rank) FILTER (kind IN ('assign', 'access', 'hex')), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY a, rank), '') AS spans FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id",
    "op10_substrings": """WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM p),
r AS (SELECT doc_id, i FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM r),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d),
y AS (SELECT x.doc_id, count(*) FILTER (c.k IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY x.k) FILTER (c.k IS NULL) AS kept FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.k = x.k GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN y ON y.doc_id = d.doc_id""",
    "op11_tries": """WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g""",
    "op12_divergence": """WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
n AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS ln FROM kept GROUP BY lang),
s AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(any_value(ln), 0) AS ln, coalesce(sum(c), 0)::BIGINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN n USING (lang, source) LEFT JOIN l USING (lang) GROUP BY lang, source),
p AS (SELECT lang, source, term, coalesce(c, 0) AS c, (1 + 1000000000::HUGEINT * (coalesce(c, 0) + 1) // (s.n + v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (total + 1) // (ln + v))::BIGINT AS q FROM s JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p)::HUGEINT * (x.p - y.p) // y.p), 0)::BIGINT AS value FROM s AS a JOIN s AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p AS x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p AS y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, ((p - q)::HUGEINT * (p - q) // q)::BIGINT AS value FROM p WHERE c > 0 AND p > q),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT * FROM (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u) WHERE part = 'pair' OR rank <= 200""",
}
