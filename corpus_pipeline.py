"""A training corpus from raw documents: quality, near duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table that is written to the shared folder as
Parquet and read again as the next stage's documents. The first three return the columns of
documents, the last (doc_id, n_tokens, ids, text) of the encoded and decoded texts.
"""

from pyspark.sql import DataFrame, SparkSession

from docproof.llm.bpe import encode_and_decode
from docproof.llm.cotraining import keep_good
from docproof.llm.minhash import keep_one_per_group
from docproof.llm.queries import table, vocabulary
from docproof.llm.raking import sample_to_targets
from docproof.llm.support import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return keep_one_per_group(docs, words=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that source, language and topic meet their target weights."""
    return sample_to_targets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text that they decode to."""
    return encode_and_decode(docs, vocabulary())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

# The classifier is no SQL; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
