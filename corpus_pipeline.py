"""A corpus pipeline of five operators: language, quality, near duplicates, mixing, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet to the shared folder and reads again as the next stage's docs. All but the last return the columns of documents.

Defined cases, for every stage: only COLUMNS of docs are read, so others may have any names; an empty table gives an empty one
with the stage's columns; ids may be null or occur more than once, and rows that are equal in all columns fare alike, except
that of near duplicates one row stays. Null and empty texts, and texts without letters, are in no language and go in the
first stage; the later ones are defined for them too: the quality rules reject them, near duplicates keeps each of them, the
mix never takes them, and packing makes a piece of the end id alone. Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import stage, table
from tideline.llm.jaccard_join import jaccard_components
from tideline.llm.langid import UNKNOWN, learn_profiles, predict_languages
from tideline.llm.mixing import mixed_documents
from tideline.llm.packing import pack_documents
from tideline.llm.quality import judge_quality
from tideline.llm.queries import word_tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document this far from every learned profile is in none of the languages.
MIN_LANGUAGE_SCORE = 0.2
#: Near duplicates share NEAR_PERCENT of their shingles of NEAR_SIZE words or more (op9's own query has other numbers).
NEAR_SIZE, NEAR_PERCENT = 5, 80


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; a missing lang is filled in by the prediction. Profiles come from docs' own labels; where
    no document has one, no language is known and all documents go."""
    judged = predict_languages(docs, learn_profiles(docs), COLUMNS)
    kept = judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def keep_clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that fail; n_chars is that of what is left."""
    kept = judge_quality(docs, ("doc_id", "lang", "source")).where("kept")
    return kept.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles, a Jaccard likeness of 0.8 or more) the document with the
    least id, of equal ids the first in the table."""
    # written once: numbers of two scans can differ
    numbered = stage(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "near-numbered")
    found = jaccard_components(numbered, NEAR_SIZE, NEAR_PERCENT, F.col("row"))
    linked = found.where("n_shingles > 0")
    first = linked.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")).alias("first"))
    keep = first.select("first.row").unionByName(found.where("n_shingles = 0").select("row"))
    return numbered.join(keep, "row", "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of which sequences of 2048 tokens are made; a document that the mix takes twice is packed twice."""
    return pack_documents(docs, word_tokenizer())


STAGES = [
    ("language", keep_known_languages),
    ("quality", keep_clean_documents),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: No SQL has language profiles, sampling keys by logarithm and a tokenizer; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
