"""From raw documents to packed batches, one training-data operator per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laureate.llm.common import column, table, written
from laureate.llm.decontaminate import contamination, is_contaminated
from laureate.llm.lines import dedup_lines
from laureate.llm.neardup import near_representatives
from laureate.llm.packing import pack
from laureate.llm.quality import THRESHOLD, learned, with_score

#: SQL cannot express the stages. The tests compare each with a plain version on its own input;
#: the quality stage, whose scores are learned, with the scores of its operator.
ORACLE_SQL = None


def _whole(docs: DataFrame) -> DataFrame:
    """Text and whole row, so that no column of the row meets one that a stage adds."""
    return docs.select("text", F.struct(*[column(docs, c) for c in docs.columns]).alias("row"))


def _rows(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    scored = with_score(_whole(docs), learned(spark, docs, sf_dir), keep=["row"])
    return _rows(scored.filter(F.col("score") >= THRESHOLD), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has, unless nothing is left of them.

    ``n_chars`` follows the text.
    """
    out = dedup_lines(docs, drop_emptied=True)
    if "n_chars" not in docs.columns:
        return out
    length = F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", length)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by shingles of five words."""
    return near_representatives(docs, k=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are benchmark passages."""
    found = contamination(_whole(docs), table(spark, sf_dir, "benchmark"), keep=["row"])
    return _rows(found.filter(~is_contaminated(F.col("n_hit"), F.col("n_words"))), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the remaining documents in batches of like length."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
