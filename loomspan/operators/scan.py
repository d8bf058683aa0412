"""Lexical scan: bytes to contiguous spans that cover them, each with a kind.

``scan_bytes`` is the kernel for arbitrary bytes. ``lex`` runs it over a table
in Arrow batches; ``lex_native`` is the same for valid text, inside Catalyst.
Offsets are byte offsets, half open.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions import lexical
from loomspan.operators.hints import HintTracker
from loomspan.session import shipped


def point_widths(points: np.ndarray) -> np.ndarray:
    """Bytes of each code point; escaped bytes count one."""
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    width[(points >= 0xDC80) & (points <= 0xDCFF)] = 1
    return width


def byte_offsets(text: str) -> np.ndarray:
    """Byte offset of each character and of the end; escaped bytes count one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    width = point_widths(points)
    out = np.zeros(len(points) + 1, dtype=np.int64)
    np.cumsum(width, out=out[1:])
    return out


@lru_cache(maxsize=50_000)
def token_kind(begins: str) -> int:
    """Kind of a token, which its first characters tell: no operator has more than three."""
    return lexical.GROUP_KINDS[lexical.grammar().match(begins).lastindex]


def _scanned(raw: bytes) -> tuple[list[str], np.ndarray]:
    """Tokens and their ends; lists of strings are found in a third of the time of matches."""
    text = raw.decode("utf-8", "surrogateescape")
    tokens = lexical.token_grammar().findall(text)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
    return tokens, ends if len(text) == len(raw) else byte_offsets(text)[ends]


def scan_ends(raw: bytes) -> np.ndarray:
    """The ends of ``scan_bytes`` alone."""
    return _scanned(raw)[1]


def scan_bytes(raw: bytes) -> tuple[list[int], list[int]]:
    """(ends, kinds) of the spans; each begins where the one before ends."""
    tokens, ends = _scanned(raw)
    return ends.tolist(), [token_kind(t[:4]) for t in tokens]


def scan_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) of each span."""
    ends, kinds = scan_bytes(raw)
    return list(zip([0, *ends[:-1]], ends, kinds))


def scan_with_hints(raw: bytes) -> tuple[list[tuple[int, int, int]], tuple[bool, bool, bool]]:
    """Spans, and whether there may be unmarked code, inline artifacts, backticks."""
    spans, tracker = scan_spans(raw), HintTracker()
    for start, end, kind in spans:
        tracker.observe(kind, raw[start:end])
    return spans, tracker.finish()


def early_hints(raw: bytes) -> tuple[bool, bool, bool]:
    """The same hints as far as ``code_spans`` tells them apart: no more is scanned once unmarked code is possible, which lets it look for artifacts too."""
    text, tracker = raw.decode("utf-8", "surrogateescape"), HintTracker()
    for found in lexical.grammar().finditer(text):
        tracker.observe(lexical.GROUP_KINDS[found.lastindex], found[0].encode("utf-8", "surrogateescape"))
        if tracker.code:
            return True, True, b"`" in raw
    return tracker.finish()


BATCH_BYTES = 1 << 19


def batches_by_size(batches: Iterator[pa.RecordBatch], column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows with about ``most`` bytes, or elements of lists, in a column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        length = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
        sizes = np.cumsum(np.nan_to_num(length(values).to_numpy(zero_copy_only=False).astype(float)))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(sizes, before + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def raw_of(docs: DataFrame, column: str = "text") -> Column:
    """The column's bytes, whether it holds text or bytes already."""
    if docs.schema[column].dataType.simpleString() == "binary":
        return F.col(column)
    return F.encode(F.col(column), "UTF-8")


def as_raw(docs: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """``doc_id``, ``raw``: what all operators of this package read."""
    return docs.select(F.col(id_column).alias("doc_id"), raw_of(docs, column).alias("raw"))


def lex_arrays(raw: DataFrame) -> DataFrame:
    """``doc_id``, ``ends``, ``kinds`` as arrays; one row a document."""
    kind = raw.schema["doc_id"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_size(batches, 1):
            found = [(None, None) if data is None else scan_bytes(data) for data in batch.column(1).to_pylist()]
            ends, kinds = pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ends, kinds], names=["doc_id", "ends", "kinds"])

    return shipped(raw).select("doc_id", "raw").mapInArrow(kernel, f"doc_id {kind}, ends array<bigint>, kinds array<int>")


def lex(raw: DataFrame) -> DataFrame:
    """``doc_id``, ``lex_idx``, ``start``, ``end``, ``kind``: a row for each span."""
    exploded = lex_arrays(raw).select("doc_id", "ends", F.posexplode(F.arrays_zip("ends", "kinds")).alias("lex_idx", "s"))
    start = F.when(F.col("lex_idx") == 0, F.lit(0).cast("long")).otherwise(F.col("ends")[F.col("lex_idx") - 1])
    return exploded.select("doc_id", "lex_idx", start.alias("start"), F.col("s.ends").alias("end"), F.col("s.kinds").alias("kind"))


def native_kind(token: Column) -> Column:
    """Kind of a token of the native scan, from how it begins.

    For tokens that begin with an ASCII character that is a comparison of its
    code, but for signs that may begin an operator; others are matched.
    """
    code = F.ascii(token)
    begins = lambda pattern: token.rlike(f"^(?:{pattern})")
    sign = F.when(begins(lexical.JAVA_SYMBOL), lexical.SYMBOL).otherwise(lexical.PUNCTUATION)
    beyond = (
        F.when(begins(lexical.JAVA_WORD), lexical.WORD)
        .when(begins(r"\p{N}"), lexical.NUMBER)
        .when(begins(lexical.JAVA_SPACE), lexical.WHITESPACE)
        .when(begins(lexical.JAVA_BREAK), lexical.LINE_BREAK)
        .when(begins(lexical.JAVA_SYMBOL), lexical.SYMBOL)
        .when(begins(lexical.JAVA_PUNCTUATION), lexical.PUNCTUATION)
        .otherwise(lexical.CONTROL)
    )
    return (
        F.when(code >= 128, beyond)
        .when(code.between(97, 122) | code.between(65, 90) | (code == 95), lexical.WORD)
        .when(code.isin(32, 9, 11, 12), lexical.WHITESPACE)
        .when(code.isin(10, 13), lexical.LINE_BREAK)
        .when(code.between(48, 57), lexical.NUMBER)
        .when((code < 32) | (code == 127), lexical.CONTROL)
        .otherwise(sign)
    )


def tokens_native(text: Column) -> Column:
    """All tokens of a text as an array, without leaving the JVM."""
    return F.regexp_extract_all(text, F.lit(lexical.JAVA_TOKEN), F.lit(0))


def words_native(text: Column) -> Column:
    """The words and numbers among a text's tokens; spaces and signs aren't taken out at all."""
    return F.regexp_extract_all(text, F.lit(lexical.JAVA_WORD_OR_NUMBER), F.lit(0))


def is_number(token: Column) -> Column:
    """Whether one of these is a number."""
    code = F.ascii(token)
    return F.when(code < 128, code.between(48, 57)).otherwise(token.rlike(r"^\p{N}"))


def signs_native(text: Column) -> Column:
    """Characters of punctuation and symbols, one by one; those inside words and numbers are none."""
    return F.regexp_extract_all(F.regexp_replace(text, F.lit(lexical.JAVA_WORD_OR_NUMBER), F.lit("")), F.lit(lexical.JAVA_SIGN), F.lit(0))


def lex_native(docs: DataFrame, column: str = "text") -> DataFrame:
    """As ``lex``, for texts; with ``surface``. Offsets are running byte lengths."""
    listed = docs.select("doc_id", tokens_native(F.col(column)).alias("tokens"))
    rows = listed.select("doc_id", F.posexplode("tokens").alias("lex_idx", "surface"))
    order = Window.partitionBy("doc_id").orderBy("lex_idx")
    end = F.sum(F.octet_length("surface").cast("long")).over(order)
    rows = rows.select("doc_id", "lex_idx", "surface", end.alias("end"), native_kind(F.col("surface")).alias("kind"))
    return rows.select("doc_id", "lex_idx", (F.col("end") - F.octet_length("surface")).alias("start"), "end", "kind", "surface")


def hints(raw: DataFrame) -> DataFrame:
    """``doc_id`` and the three hints of each document."""
    kind = raw.schema["doc_id"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_size(batches, 1):
            found = [None if not v.is_valid else scan_with_hints(v.as_py())[1] for v in batch.column(1)]
            columns = [pa.array([None if f is None else f[k] for f in found], pa.bool_()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "unmarked_code", "inline_artifact", "backtick"])

    return shipped(raw).select("doc_id", "raw").mapInArrow(kernel, f"doc_id {kind}, unmarked_code boolean, inline_artifact boolean, backtick boolean")


def coverage_violations(spans: DataFrame, raw: DataFrame) -> DataFrame:
    """Documents whose spans don't cover them without gaps or overlaps."""
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    marked = spans.withColumn("gap", F.col("start") != F.coalesce(F.lag("end").over(order), F.lit(0).cast("long")))
    summed = marked.groupBy("doc_id").agg(F.max(F.col("gap").cast("int")).alias("gaps"), F.max("end").alias("reached"))
    sizes = raw.select("doc_id", F.octet_length("raw").cast("long").alias("size"))
    return sizes.join(summed, "doc_id", "left").where((F.coalesce("gaps", F.lit(0)) > 0) | (F.coalesce("reached", F.lit(0)) != F.col("size"))).select("doc_id")


def document_coverage(raw: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes`` in spans, ``wrong`` (null for null documents): whether spans leave something of a document out or overlap.

    Each document's own list of ends is enough, as a span begins where the one before ends.
    """
    kind = raw.schema["doc_id"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_size(batches, 1):
            values = batch.column(1).to_pylist()
            ends = [None if v is None else np.concatenate(([0], scan_ends(v))) for v in values]
            wrong = [None if v is None else bool(e[-1] != len(v) or (e[1:] <= e[:-1]).any()) for v, e in zip(values, ends)]
            sizes = pa.array([None if e is None else int(e[-1]) for e in ends], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(wrong, pa.bool_())], names=["doc_id", "n_bytes", "wrong"])

    return shipped(raw).select("doc_id", "raw").mapInArrow(kernel, f"doc_id {kind}, n_bytes long, wrong boolean")


def differing(docs: DataFrame) -> DataFrame:
    """``n_docs``, ``n_bytes``, ``n_different`` of runs of rows with ``raw`` and ``sizes``, the bytes of another scan's spans."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_size(batches, 0):
            counts = [batch.num_rows, 0, 0]
            sizes = batch.column(1)
            for k, data in enumerate(batch.column(0).to_pylist()):
                if data is not None:
                    ends = scan_ends(data)
                    counts[1] += int(ends[-1]) if len(ends) else 0
                    counts[2] += not np.array_equal(np.diff(ends, prepend=0), sizes[k].values.to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()) for c in counts], names=["n_docs", "n_bytes", "n_different"])

    return shipped(docs).select("raw", "sizes").mapInArrow(kernel, "n_docs long, n_bytes long, n_different long")


def unit_bytes(raw: Column, start: Column, end: Column) -> Column:
    """Bytes of a span."""
    return F.substring(raw, start.cast("int") + 1, (end - start).cast("int"))
