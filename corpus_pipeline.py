"""From raw documents to packed training sequences, as stages that each work on all their predecessor kept.

Documents of poor quality go, then documents in no learned language, then all but one of each group of near
duplicates; what is left is packed. Every stage but the last returns the columns of ``documents``; each result
is written as Parquet and read again as the next stage's input. The stages need models, so no SQL gives their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytally.llm import langid, near_dup, packing, quality
from skytally.llm.common import stored, table
from skytally.llm.queries import vocabulary_file

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def documents(docs: DataFrame) -> DataFrame:
    """The columns of ``documents`` alone; missing ones are null."""
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c) for c, kind in COLUMNS.items()])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies within the limits of their language; empty ones stay."""
    return quality.classify(documents(docs), table(spark, sf_dir, "labels")).where("accepted").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from their predecessors' labels; text without letters goes."""
    docs = documents(docs)
    return langid.recognised(docs, langid.train(docs))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates, the one of smallest id."""
    return near_dup.one_of_each(documents(docs), threshold=80, bands=12)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, with the sequence and offset of each."""
    return packing.pack(documents(docs), vocabulary_file("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", near_dup_stage), ("packing", packing_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, name)
    return docs
