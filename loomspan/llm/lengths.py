"""2. Exact length histogram of encoded documents.

``histogram`` counts documents by their exact number of tokens, which is a
map-side sum; its size is bounded by the longest document, not by the corpus.
``suffix_sums`` turns it into a table that answers, for every context limit L,
how many documents and tokens reach it, the rank of the length and the total
after truncation to L. ``truncated_total`` and ``quantile`` read that table for
limits and ranks that aren't lengths of any document.

Defined cases. Null text: not a document, not counted. Empty text: length 0.
Null ids and repeated rows count as rows. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.llm import vocabularies
from loomspan.session import shipped

VOCABULARY = "byte_bpe_50k"


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, folder: str = vocabularies.FOLDER, column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``n_tokens``, exact; null for a null text."""
    source = shipped(docs).select(F.col(column).cast("string").alias("_text"), *keep)
    fields = [f for f in source.schema.fields if f.name != "_text"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = vocabularies.length_counter(vocabulary, folder)
        for batch in batches:
            n = [None if t is None else count(t) for t in (x.as_py() for x in batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), *batch.columns[1:]], names=["n_tokens", *keep])

    return source.mapInArrow(kernel, "n_tokens long" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in fields))


def histogram(lengths: DataFrame) -> DataFrame:
    return lengths.where(F.col("n_tokens").isNotNull()).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """One row for each length that occurs.

    ``docs_ge``/``tokens_ge``: documents at least that long and their tokens;
    ``docs_le``: documents at most that long; ``truncated_total``: all tokens
    if every document is cut to that length; ``share_le``: rank of the length.
    The window has no partition: its input has one row a distinct length.
    """
    up = Window.orderBy(F.col("n_tokens").desc())
    everything = Window.partitionBy()
    rows = counts.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("n_total"))
    rows = rows.select(
        "n_tokens",
        "n_docs",
        F.sum("n_docs").over(up).alias("docs_ge"),
        F.sum("n_total").over(up).alias("tokens_ge"),
        F.sum("n_docs").over(everything).alias("_docs"),
        F.sum("n_total").over(everything).alias("_tokens"),
    )
    le = F.col("_docs") - F.col("docs_ge") + F.col("n_docs")
    return rows.select(
        "n_tokens",
        "n_docs",
        "docs_ge",
        "tokens_ge",
        le.alias("docs_le"),
        (F.col("_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_total"),
        (le / F.col("_docs")).alias("share_le"),
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """Tokens that are left if every document is cut to ``limit``, for any limit."""
    above = sums.where(F.col("n_tokens") >= limit)
    total = F.coalesce(F.max("tokens_ge"), F.lit(0))
    rest = F.coalesce(F.max("docs_ge"), F.lit(0))
    whole = sums.agg(F.coalesce(F.max("tokens_ge"), F.lit(0)).alias("_all"))
    cut = above.agg(total.alias("_above"), rest.alias("_docs"))
    return whole.crossJoin(cut).select((F.col("_all") - F.col("_above") + F.col("_docs") * limit).alias("truncated_total"))


def quantile(sums: DataFrame, share: float) -> DataFrame:
    """Least length at or below which at least ``share`` of the documents lie."""
    return sums.where(F.col("share_le") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY, folder: str = vocabularies.FOLDER) -> DataFrame:
    return suffix_sums(histogram(encoded_lengths(docs, vocabulary, folder, keep=())))
