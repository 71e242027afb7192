"""The corpus pipeline: language, near copies, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. run() writes each stage's rows to the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm import decontaminate, language, ngram_join, packing, pseudonyms
from shutterlake.llm.common import forget, prepare, read, stored

#: Setting of the session that holds the secret key of the pseudonyms. Without it they are made with the key that the
#: library publishes for demonstrations, which anybody can invert.
KEY_SETTING = "spark.shutterlake.pseudonymKey"

#: Packing and the language model have no SQL form.
ORACLE_SQL = None


def _aside(docs: DataFrame) -> DataFrame:
    """The texts with all other columns in one, under names of their own: whatever an operator adds or replaces, they pass."""
    others = [c for c in docs.columns if c != "text"]
    return docs.select("text", F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))).alias("__others"))


def _back(rows: DataFrame, docs: DataFrame, **instead: F.Column) -> DataFrame:
    """Rows of _aside() with the columns of docs again, some of them replaced."""
    others = [c for c in docs.columns if c != "text"]
    had = {"text": F.col("text")} | {c: F.col(f"__others.c{i}") for i, c in enumerate(others)} | instead
    return rows.select(*(had[c].alias(c) for c in docs.columns))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: not those without a letter, nor those that the operator flags as ambiguous.

    Null and empty texts go; texts of any length are read whole; repeated rows stay or go together; without rows, or
    without any to learn from, none stay. All columns pass unchanged, whatever their names. Learned from the stage's own
    documents that aren't held out, as the query of this operator does.
    """
    prepare(spark)
    model = language.train(docs, ~language.held_out("doc_id", 3, 1))
    told = language.identify(_aside(docs), model)
    return _back(told.where((F.col("lang_pred") != language.UNDETERMINED) & ~F.col("ambiguous")), docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the least doc_id, null last, of rows that share it the first stored.

    Texts without words are no copies of each other and all stay; texts of any length are compared whole; an empty table
    gives no rows. All columns pass unchanged, whatever their names.
    """
    prepare(spark)
    return ngram_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no item of the benchmark.

    Null and empty texts overlap nothing; texts of any length are read whole; repeated rows go together; an empty table
    gives no rows. All columns pass unchanged, whatever their names.
    """
    return _back(decontaminate.decontaminated(_aside(docs), read(spark, sf_dir, "benchmark")), docs)


def pseudonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with pseudonyms for personal data; n_chars follows the text.

    Null and empty texts stay as they are; texts of any length are read whole; repeated rows get the same text; an empty
    table gives no rows. All other columns pass unchanged, whatever their names.
    """
    prepare(spark)
    secret = spark.conf.get(KEY_SETTING, None)
    out = pseudonyms.pseudonymised(_aside(docs), secret.encode() if secret else pseudonyms.DEMONSTRATION_KEY)
    if "n_chars" not in docs.columns:
        return _back(out, docs)
    old = F.col(f"__others.c{[c for c in docs.columns if c != 'text'].index('n_chars')}")
    return _back(out, docs, n_chars=F.when(F.col("n_replaced") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(old))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in sequences; a null or empty text is one piece of one token.

    Longer texts than a sequence are cut into pieces, whatever their length; repeated rows are packed each; an empty
    table gives no rows. Only doc_id and text are read.
    """
    prepare(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language", known_language),
    ("near copies", one_of_each),
    ("benchmark", without_benchmark),
    ("personal data", pseudonymous),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage read and stored is deleted once its rows are written."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        before, docs = docs, stored(made, f"pipeline-{k}")
        forget(made)
        forget(before)
    return docs
