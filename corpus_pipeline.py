"""A training corpus from raw documents: bad texts go, copies go, sources are mixed, texts become pieces.

Five stages, each a function of (spark, docs, sf_dir) on what the one before it kept. All but the last return the columns of
``documents``; the last returns doc_id, n_pieces and the piece numbers.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilake.llm import exact_dedup, mixing, quality, sentencepiece_wfst, simhash
from vigilake.llm.common import word_count
from vigilake.llm.queries import MAY_LEARN_REMAINDERS, PIECE_MODEL, WEIGHTS, remainder
from vigilake.session import cut_lineage, read_table, ship_package

HERE = os.path.dirname(os.path.abspath(__file__))
#: Score below which the quality classifier rejects a document.
REJECT_BELOW = 0.5


def reject_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores as good by a classifier fitted on the labels."""
    ship(spark)
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"), REJECT_BELOW, may_learn=remainder().isin(*MAY_LEARN_REMAINDERS))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the largest doc_id) of each group of equal texts."""
    ship(spark)
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group that shares 0.8 or more of its five-word shingles."""
    ship(spark)
    return simhash.drop_near_copies(docs, words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document taken twice is two rows."""
    ship(spark)
    return mixing.mix_documents(docs, word_count("text"), WEIGHTS, total=1.5, most=2.0)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece numbers of every text."""
    ship(spark)
    ids = sentencepiece_wfst.encode(docs, sentencepiece_wfst.load_model(spark, PIECE_MODEL))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("quality", reject_bad),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]
ORACLE_SQL = None


def ship(spark: SparkSession) -> None:
    ship_package(spark, os.path.join(HERE, "vigilake"), os.path.join(HERE, "catalog"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
