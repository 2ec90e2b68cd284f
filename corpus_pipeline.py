"""A corpus pipeline of five stages, each one of the text operators.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
kept. All but the last return the columns of ``documents``; the last returns
the pieces of packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantflume.llm import language, packing, secrets, simhash, substrings
from quantflume.llm.common import cut_lineage
from quantflume.llm.queries import tokenizer_path

#: Columns of documents; n_chars follows the text.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents with ``n_chars`` counted from the text (null: null)."""
    kind = docs.schema["n_chars"].dataType
    return docs.select(*[F.length("text").cast(kind).alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are in no learned language; ``lang`` stays as given.

    The network learns from the labelled rows of ``docs``, and from stand-ins
    for texts of other languages, scripts and junk; what is likelier such a
    text, beyond the limit calibrated on the label's training windows, goes.
    Null, empty and letterless texts are undetermined and go. Without labels nothing can be
    told from anything, and only those without a letter go.
    """
    model = language.train(docs, rejects=True)
    if not model.labels:
        return _documents(docs.where(F.col("text").rlike(r"\p{L}")))
    found = language.identify(docs.select(*COLUMNS), model)
    return _documents(found.where(F.col("lang_pred") != language.UNDETERMINED))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each near-duplicate group.

    Null ids come last; of rows with the kept id in a group one stays (see
    ``simhash.keep_one_each``). Null and wordless texts are copies of each
    other; an empty table stays empty.
    """
    return _documents(simhash.keep_one_each(docs.select(*COLUMNS)))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 35 words and more that occur elsewhere; texts may end up empty, rows all stay.

    Repeated rows repeat each other, whatever their ids; null texts stay null
    and null ids null; an empty table stays empty.
    """
    return _documents(substrings.remove_repeats(docs.select(*COLUMNS)))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by their kind; all rows stay, with null texts null; of overlapping secrets the one that starts first counts. An empty table stays empty."""
    return _documents(secrets.redact_secrets(docs.select(*COLUMNS)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 4096 tokens: a row for each piece, with its ids.

    Null texts count as empty and give the end token alone; null ids stay null;
    repeated rows are packed each; an empty table gives no rows.
    """
    return packing.pack_documents(docs, tokenizer_path())


#: (name, function) in order.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages; tests hold each against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
