"""The training-corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histoloom.llm import decontaminate as leaks
from histoloom.llm import jaccard, packing, quality, suffixes
from histoloom.llm.storage import written


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the texts now are; null texts keep theirs."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts; it learns from all labels of documents it is given.

    Rows are judged by their text alone, null as empty, however long; repeated rows share their fate; null keys are as others. Without
    labels enough of both classes nothing is known against any row, and all stay. An empty table gives an empty one. Columns stay as they are."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group that links of 0.75 Jaccard similarity join.

    Null, empty and wordless texts and rows with a null key stay; repeated rows of a key stay or go together; whole texts count, however
    long; an empty table gives an empty one. Columns stay as they are."""
    return jaccard.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that occur earlier; documents of which no word is left go.

    Order is by key, null keys last. Null, empty and short texts stay as they are; of a very long one every window counts; repeated rows
    are cut alike; an empty table gives an empty one. n_chars is counted anew."""
    cut = suffixes.without_repeats(docs)
    emptied = (F.length("text") < F.col("n_chars")) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _recounted(cut.where(~F.coalesce(emptied, F.lit(False))))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without windows of benchmark items; documents that consist of them mostly go.

    Null, empty and wordless texts stay; items with a null id or text, or without words, hit nothing; whole texts count, however long;
    repeated rows share their fate; an empty table or benchmark changes nothing. n_chars is counted anew."""
    return _recounted(leaks.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens.

    A null or empty text is the end id alone; a longer one than a sequence is cut into several pieces; repeated rows and null keys keep
    their rows; an empty table gives an empty one."""
    return packing.pack_documents(docs)


STAGES = [("quality", good_quality), ("near_copies", one_of_near_copies), ("repeats", without_repeats), ("benchmark", decontaminated), ("packing", packed)]

#: The classifier, the components and the packing can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each to the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
