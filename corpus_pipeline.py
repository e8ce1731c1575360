"""Corpus pipeline: language ID, near duplicates, personal data, mixing, BPE, each stage over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialmill.llm import bpe, langid, mixing, neardup, pii
from dialmill.llm.queries import vocabulary
from dialmill.runtime import stash, table

#: A document whose language's probability is below this, or that has no letter, is rejected.
LEAST_SCORE = 0.5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is recognised.

    A null or empty text, or one without a letter, is rejected; other columns may be null; repeated rows share their fate;
    of equally likely languages the first by name counts; an empty table, or one without labelled text, gives an empty
    result; columns other than COLUMNS play no part.
    """
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    out = langid.predict(docs.select(*COLUMNS), model)
    return out.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies.

    Null and empty texts are classes of their own, so such rows stay, one for each id; rows without an id stay; of a class
    the least id stays, and for that id the least key of its text; of rows that repeat id and text, the least by the other
    columns; an empty table gives an empty result; columns other than COLUMNS play no part.
    """
    return neardup.drop_near_copies(docs.select(*COLUMNS))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind; n_chars follows the text.

    A null text stays null, with its n_chars; an empty one stays empty; repeated rows are redacted alike; where spans
    compete, base spans stay, then the set with the largest total score; an empty table gives an empty result; columns
    other than COLUMNS play no part.
    """
    out = pii.detect(docs.select(*COLUMNS), pii.default_model(), masked=True)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def remix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their target weights.

    A null or empty text weighs nothing, and its row draws as others do; a null source is a source of its own; rows
    without an id and repeated rows draw one by one; an empty table gives an empty result; columns other than COLUMNS play no part.
    """
    return mixing.mix(docs.select(*COLUMNS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, with digests of ids and decoded text.

    A null or empty text has no tokens; repeated rows, which mixing makes, keep a row each; an empty table gives an empty
    result; columns other than COLUMNS play no part.
    """
    return bpe.encode(docs.select(*COLUMNS), vocabulary(), keep=["doc_id", "lang", "source"], with_ids=True)


STAGES = [("language_id", identify), ("near_duplicates", deduplicate), ("personal_data", redact), ("mixing", remix), ("bpe", tokenize)]
#: Naive Bayes, MinHash classes and the tagger have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
