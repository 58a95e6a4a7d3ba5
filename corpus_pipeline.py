"""A corpus pipeline: each stage reads what the one before it wrote.

Stages: language ID, exact dedup, n-gram Jaccard join, mixing sources to target weights, BPE
encoding and decoding. All but the last return the columns of documents, whatever other
columns (of any name) there are.

Defined cases: language ID drops null and empty texts and texts without a letter. The others
take null and empty texts as they come: both dedup stages decide by row where ids are null or
repeat (a row stays for each class; near dedup leaves rows without a word alone), mixing gives
a null source a share, and BPE makes no token of a null text. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm import bpe, exact_dedup, language, mixing, ngram_join, queries
from barspark.llm.support import fresh, saved, table

#: A document stays if its text has letters and its nearest profile is at least this near (clean text lies above 0.35).
LEAST_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus's own labels teach; lang of the kept rows is left as it was."""
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    lang, score = fresh(docs, "lang_pred", "score")
    found = language.predict(docs, model, passing=tuple(docs.columns), names=(lang, score))
    return found.where((F.col(lang) != language.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).drop(lang, score)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: five-word shingles, similarity 0.8 or more."""
    return ngram_join.drop_near(docs, width=5, num=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources that the weights do not name have a share too (queries.OTHER_WEIGHT each), null included."""
    return mixing.mix(docs, queries.WEIGHTS, default=queries.OTHER_WEIGHT, seed=queries.MIX_SEED, numbers=False)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the token ids (little-endian unsigned 32-bit integers) and whether they decode to the text."""
    coded = bpe.round_trip(docs.withColumn("_key", F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))), queries.vocabulary_path(), "_key", "text")
    return coded.select("_key.doc_id", "n_tokens", "ids", (F.sha2("decoded", 256) == F.col("_key.sha")).alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe", tokenize),
]

#: Language profiles, near duplicates and BPE have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
