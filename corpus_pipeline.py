"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; its result is written as Parquet and read again. The last stage returns
packed bins, the others the columns of ``documents``, ``n_chars`` following the
text where a stage changes it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import bwt, fertility, lines, minmax, packing
from loomspan.llm.common import keyed, named
from loomspan.session import checkpoint_folder, remove, table


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now, in its own type."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the fertility rules reject.

    Rejected are pairs of an id, which may be null or of any type, and a text:
    of rows that share an id each stays or goes by its own text.
    """
    inner, _, text = keyed(docs)
    lang = F.col(f"c{docs.columns.index('lang')}") if "lang" in docs.columns else F.lit(None).cast("string")
    judged = fertility.fertility_rules(inner.select(F.struct("_id", "_key").alias("doc_id"), F.col(text).alias("text"), lang.alias("lang")))
    gone = judged.where("NOT keep").select("doc_id.*").distinct()
    return named(inner.join(gone, ["_id", "_key"], "left_anti"), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that occur earlier; documents without lines left go."""
    return _counted(lines.drop_repeated_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of near duplicates."""
    return minmax.drop_near_duplicates(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages of 50 words and more that occur earlier."""
    return _counted(bwt.drop_repeated_passages(docs))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into bins."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("best-fit packing", best_fit),
]

#: Tokenisation and near-duplicate estimates aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the packed bins.

    A stage's input is deleted when its own result is written; the last stage
    has read its input when it gives its result, as it packs by what it counted.
    """
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            remove(spark, f"{folder}/{number - 1}")
    packed = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, folder)
    return packed
