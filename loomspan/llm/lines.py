"""6. Line dedup: range-partitioned line hashes, streamed in order.

Each line is a 128-bit hash with its document and position. The first half of
the hash is uniform, so equal ranges of it make equal partitions without a
sampling pass. Within a partition rows are sorted by hash, then document, then
position, and a streaming pass keeps the first of each hash. A line that occurs
often in one Arrow batch leaves that batch once, so that a line that everybody
has doesn't make a hot partition. No text is shuffled for the bitmaps: hashes go
out, positions that stay come back, and are joined with each document's number
of lines and blank positions into a run-length compressed bitmap. Only
``drop_repeated_lines``, which gives texts, joins them with the bitmaps of those
documents that lose a line.

Lines end at a line feed; they are compared by their bytes without white space
at either end. Blank lines always stay. The first occurrence is the one with
the least (doc_id, text hash, position), null ids first.

The bitmap is a string of run lengths, kept and dropped lines in turn, the
first run being kept lines: "3,2,1" keeps three, drops two, keeps one; "0,4"
drops four.

Defined cases. Ids may be of any type (``common``). Null text: null bitmap and counts. Empty text: one blank line,
which stays. Rows that agree in id and text get the same bitmap, that of one of
them. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import identified, keyed, named, slices, text_bytes


#: Text whose lines are sorted in one task; ranges that a shuffle may have at most.
RANGE_BYTES = 256 << 20
MOST_RANGES = 50_000


def _lines(data: bytes, start: int, stop: int) -> list[bytes]:
    return data[start:stop].split(b"\n")


def _hash_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for batch in slices(batches, "text", 4 << 20):
        data, offsets = text_bytes(batch.column(2))
        raw = data.tobytes()
        hashes, rows, positions = [], [], []
        for row in range(batch.num_rows):
            for position, line in enumerate(_lines(raw, offsets[row], offsets[row + 1])):
                line = line.strip()
                if line:
                    hashes.append(digest(line))
                    rows.append(row)
                    positions.append(position)
        if not hashes:
            continue
        hash_a, hash_b = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2).T
        rows = np.array(rows)
        ids = batch.column(0).to_numpy(zero_copy_only=False)[rows]
        keys = batch.column(1).to_numpy()[rows]
        positions = np.array(positions, dtype=np.int32)
        order = np.lexsort((positions, keys, ids, hash_b, hash_a))
        a, b = hash_a[order], hash_b[order]
        first = np.ones(len(order), dtype=bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        order = order[first]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(x[order])) for x in (hash_a, hash_b, ids, keys, positions)],
            names=["_a", "_b", "_id", "_key", "_position"],
        )


def _first_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        first = np.ones(len(a), dtype=bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first[0] = last != (a[0], b[0])
        last = (a[-1], b[-1])
        keep = pa.array(first)
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (2, 3, 4)], names=["_id", "_key", "_position"])


def first_occurrences(docs: DataFrame) -> DataFrame:
    """``_id``, ``_key``, ``_position`` of the first occurrence of each line.

    There are as many ranges as make partitions of about ``RANGE_BYTES`` of text,
    and at least as many as the session's shuffles have.
    """
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = size if size < 1 << 60 else 0  # unknown, as of local rows
    parts = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES))
    hashed = identified(docs).mapInArrow(_hash_kernel, "_a long, _b long, _id long, _key long, _position int")
    number = F.expr(f"cast((shiftright(_a, 32) + 2147483648L) * {parts}L div 4294967296L as int)")
    ranged = hashed.repartitionById(parts, number).sortWithinPartitions("_a", "_b", "_id", "_key", "_position")
    return ranged.mapInArrow(_first_kernel, "_id long, _key long, _position int")


def run_lengths(bits: np.ndarray) -> str:
    """Lengths of the runs, the first one of set bits."""
    if not len(bits):
        return ""
    edges = np.flatnonzero(np.diff(bits)) + 1
    runs = np.diff(np.concatenate(([0], edges, [len(bits)]))).tolist()
    return ",".join(map(str, runs if bits[0] else [0, *runs]))


def from_run_lengths(runs: str) -> np.ndarray:
    """The bits again."""
    lengths = [int(x) for x in runs.split(",")] if runs else []
    return np.repeat(np.arange(len(lengths)) % 2 == 0, lengths)


def _blank_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of lines and positions of the blank ones; null for a null text."""
    for batch in slices(batches, "text", 4 << 20):
        data, offsets = text_bytes(batch.column(0))
        raw, valid = data.tobytes(), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        counts, blanks = [], []
        for row in range(batch.num_rows):
            lines = _lines(raw, offsets[row], offsets[row + 1])
            counts.append(len(lines) if valid[row] else None)
            blanks.append([k for k, line in enumerate(lines) if not line or line.isspace()] if valid[row] else None)
        yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int32()), pa.array(blanks, pa.list_(pa.int32())), *batch.columns[1:]], names=["n_lines", "_blank", *batch.schema.names[1:]])


def _bitmap_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps from numbers of lines, blank and kept positions."""
    for batch in batches:
        counts, blanks, stays = (batch.column(k) for k in range(3))
        kept, maps = [], []
        for row in range(batch.num_rows):
            if not counts[row].is_valid:
                kept.append(None), maps.append(None)
                continue
            bits = np.zeros(counts[row].as_py(), dtype=bool)
            for found in (blanks[row], stays[row]):
                if found.is_valid:
                    bits[found.values.to_numpy()] = True
            kept.append(int(bits.sum())), maps.append(run_lengths(bits))
        yield pa.RecordBatch.from_arrays([counts, pa.array(kept, pa.int32()), pa.array(maps, pa.string()), *batch.columns[3:]], names=["n_lines", "n_kept", "keep", *batch.schema.names[3:]])


def _bitmaps(docs: DataFrame, ident: bool) -> DataFrame:
    """``n_lines``, ``n_kept``, ``keep`` of each row; ``doc_id`` or else, of each distinct one, ``_id`` and ``_key``."""
    inner, number, text = keyed(docs.select("doc_id", "text"))
    stay = first_occurrences(docs).groupBy("_id", "_key").agg(F.collect_set("_position").alias("_stay"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = inner.select(F.col(text).alias("text"), "_id", "_key", F.col(number).alias("doc_id"))
    rows = rows.mapInArrow(_blank_kernel, f"n_lines int, _blank array<int>, _id long, _key long, doc_id {kind}")
    if ident:
        joined = rows.join(stay, ["_id", "_key"], "left").select("n_lines", "_blank", "_stay", "doc_id")
        return joined.mapInArrow(_bitmap_kernel, f"n_lines int, n_kept int, keep string, doc_id {kind}")
    once = rows.where("n_lines IS NOT NULL").groupBy("_id", "_key").agg(F.max("n_lines").alias("n_lines"), F.first("_blank").alias("_blank"))
    joined = once.join(stay, ["_id", "_key"], "left").select("n_lines", "_blank", "_stay", "_id", "_key")
    return joined.mapInArrow(_bitmap_kernel, "n_lines int, n_kept int, keep string, _id long, _key long")


def line_bitmaps(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_kept``, ``keep`` for each row."""
    return _bitmaps(docs, True).select("doc_id", "n_lines", "n_kept", "keep")


def _cut_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines that their bitmaps drop."""
    for batch in batches:
        texts = []
        for text, runs in zip(batch.column(0), batch.column(1).to_pylist()):
            if not text.is_valid or runs is None or "," not in runs:
                texts.append(text.as_py())
                continue
            lines = text.as_buffer().to_pybytes().split(b"\n")
            texts.append(b"\n".join([line for line, stays in zip(lines, from_run_lengths(runs)) if stays]).decode())
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:]], names=batch.schema.names)


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with repeated lines taken out; other columns as they are.

    A document of which no line with text is left is left out; documents that
    had none before stay.
    """
    inner, _, text = keyed(docs)
    maps = _bitmaps(docs, False).where("n_kept < n_lines").select("_id", "_key", "keep")
    others = [f"c{i}" for i, n in enumerate(docs.columns) if n != "text"]
    kinds = "".join(f", {c} {docs.schema.fields[int(c[1:])].dataType.simpleString()}" for c in others)
    joined = inner.join(maps, ["_id", "_key"], "left").select(text, F.col("keep").alias("_keep"), *others)
    left = joined.mapInArrow(_cut_kernel, f"{text} string, _keep string{kinds}")
    left = left.where(F.col(text).isNull() | F.col("_keep").isNull() | F.col(text).rlike(r"\S"))
    return named(left, docs.columns)
