"""The corpus pipeline: language, near duplicates, personal data, source weights, packed sequences.

Each stage takes and gives the columns of documents, whatever other columns there are, but the last one, which gives pieces. A
null text is no text, a null or repeated doc_id is a document of its own, and a stage on no rows gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, mixing, nearjoin, packing, private
from tidemark.llm.shared import cut, table

#: A document whose likeliest language has less than this share of the probability per word is rejected.
LEAST_SCORE = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised, and writes it to lang.

    Null and empty texts, and texts without a letter, have none and go; so do texts whose likeliest language has less than
    LEAST_SCORE per word. Repeated rows are judged alike; of equal scores the first language by name counts. Long texts are
    scored whole.
    """
    model = language.learned(docs.where(~language.held_out() & F.col("doc_id").isNotNull()), language.public_pieces())
    found = language.identify(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarities of at least 0.8 of five-word shingles join.

    The least doc_id stays, null ids last; of repeated rows one stays, the same in each run. Rows without a word all stay.
    """
    return nearjoin.one_of_each(docs, words=5, num=4, den=5).select(*COLUMNS)


def remove_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind. Null and empty texts stay as they are; every row stays."""
    return private.redact(docs, private.learned(docs)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Null is a source, the last; a document without words is taken as its source's
    rate has it. Repeated rows are taken as often as documents of their own."""
    return mixing.repeated(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and where they lie in the sequences. Null and empty texts are a document of the end id."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near copies", remove_near_copies),
    ("personal data", remove_private),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]
#: Learned models, balanced sampling and tokenizers aren't expressible in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
