"""The corpus pipeline: each stage calls one operator of spanloom.llm and hands its rows on as a Parquet table.

A stage takes (spark, docs, sf_dir). All but the last return the columns of `documents`, whatever else their rows hold; the
last returns the packed pieces. An empty table passes every stage. When a stage's table is written, those that it was made
from are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import exact_dedup, mixing, ngram_join, packing, quality
from spanloom.llm.common import documents, dropped, dropped_since, mark, written
from spanloom.llm.queries import tokenizer_files


def keep_good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. A null or empty text has no words and goes; rows that repeat a text go or stay
    alike; a null id is judged by its text; very long texts are judged whole."""
    return quality.keep_good(docs, documents(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays. A null text is empty, empty texts are equal, a null id comes after all
    others, and of rows that repeat both id and text one stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a Jaccard similarity of 0.8 the one with the smallest id stays. A text without
    words is linked with nothing and stays; rows without an id are each a document after all others; rows that repeat an id stay
    or go together."""
    return ngram_join.one_of_each(docs, ngram_join.Rule(words=5, least=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target words; documents repeat as often as they are taken. Texts without words are never taken; a
    null source is a source of its own; rows that repeat each other are counted one by one."""
    return mixing.take(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens, one row per piece. A null or empty text is its closing id; a null id is passed on; repeated rows
    are packed each for itself; a very long text is cut into as many pieces as it needs."""
    return packing.pack(docs, *tokenizer_files())


STAGES = [
    ("quality_rules", keep_good_text),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: The first stage fits a model and the last one tokenises, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each reading what the one before has written."""
    docs = documents(spark, sf_dir)
    for at, (_, stage) in enumerate(STAGES):
        begin = mark()
        made = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            made = written(made)
            dropped_since(begin, made)
            dropped(docs)
        docs = made
    return docs
