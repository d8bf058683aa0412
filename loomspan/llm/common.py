"""What the operators share: vectorised hashing of text and Arrow plumbing.

Row identity. Operators that compare rows with each other (6, 8, 9) take a row
to be the pair of its ``doc_id`` and the hash of its text, so a ``doc_id`` may
be null or be used twice and be of any type that Spark can hash. Whole numbers
stand for themselves, so that rows are ordered by id; ids of other types stand
for their 64-bit hash and are ordered by it. ``keyed`` renames all input columns,
so that none of them can clash with an inner one, and ``restored`` gives ids back.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, IntegerType, LongType, ShortType

from loomspan.session import shipped

#: 64-bit arithmetic wraps on purpose throughout.
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
SEGMENT = 1 << 20

_CLASS = np.zeros(256, dtype=bool)
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Scripts that put no space between words: each of their characters is a word.
_SCRIPTS = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF))
_APART, _JOINED, _ALONE = range(3)


def _kinds() -> np.ndarray:
    """Of the characters below 2^16 that aren't ASCII: separators (punctuation and spaces), parts of words, words."""
    kinds = np.full(1 << 16, _JOINED, dtype=np.uint8)
    for low, high in _SCRIPTS:
        kinds[low : high + 1] = _ALONE
    for point in range(128, 1 << 16):
        category = unicodedata.category(chr(point))
        if category[0] in "PZ" or category == "Cc":
            kinds[point] = _APART
    return kinds


_KINDS = _kinds()


def _ranges(kind: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(_KINDS[128:] == kind, prepend=False, append=False)) + 128
    return [(int(a), int(b) - 1) for a, b in zip(edge[0::2], edge[1::2])]


def word_pattern(escape: str = r"\x{%x}", upper: bool = False) -> str:
    """A regular expression for the words of lower-case text (or with ``upper`` of any), for other engines."""
    inside = lambda ranges: "".join(f"{escape % a}-{escape % b}" for a, b in ranges)
    alone = _ranges(_ALONE) + [(0x20000, 0x3FFFF)]
    joined = _ranges(_JOINED) + [(0x10000, 0x1FFFF), (0x40000, 0x10FFFF)]
    letters = "0-9a-z" + ("A-Z" if upper else "")
    return f"[{inside(alone)}]|[{letters}{inside(joined)}]+"


_POWERS: dict[str, np.ndarray] = {}


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("base", ())) < count:
        for name, factor in (("base", _BASE), ("inverse", _INVERSE)):
            steps = np.full(count, factor, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["base"], _POWERS["inverse"]


def mix(values: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 bits."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xC4CEB9FE1A85EC53)
    values ^= values >> np.uint64(33)
    return values


def _words_of(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in some bytes."""
    inside = _CLASS[part]
    cut = None
    size = len(part)
    for lead, mask, width in ((0xC0, 0xE0, 2), (0xE0, 0xF0, 3), (0xF0, 0xF8, 4)):
        at = np.flatnonzero((part & mask) == lead)
        at = at[at + width <= size]
        if not len(at):
            continue
        point = (part[at] & (0xFF >> (width + 1))).astype(np.int64)
        for k in range(1, width):
            point = (point << 6) | (part[at + k] & 63)
        kind = _KINDS[point] if width < 4 else np.where((point >= 0x20000) & (point < 0x40000), _ALONE, _JOINED)
        for k in range(width):
            inside[at[kind == _APART] + k] = False
        alone = at[kind == _ALONE]
        if len(alone):
            cut = np.zeros(size + 1, dtype=bool) if cut is None else cut
            cut[alone] = cut[alone + width] = True
    if cut is None:
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        return edge[0::2], edge[1::2]
    before, after = np.concatenate(([False], inside)), np.concatenate((inside, [False]))
    return np.flatnonzero(after & (~before | cut)), np.flatnonzero(before & (~after | cut))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word in a buffer of UTF-8 bytes.

    A word is a maximal run of ASCII letters, digits and characters beyond ASCII
    that are neither punctuation nor spaces, ASCII letters counting as lower case;
    in scripts without spaces between words each character is one. Works through the buffer in segments that end
    between words, so that memory follows the segment, not the buffer.
    """
    hashes, starts, ends = [], [], []
    at, size = 0, len(data)
    while at < size:
        stop = min(size, at + SEGMENT)
        while stop < size and _CLASS[data[stop]] and _CLASS[data[stop - 1]]:
            back = np.flatnonzero(~_CLASS[data[at:stop]])
            if len(back):
                stop = at + int(back[-1]) + 1
                break
            stop = min(size, stop + SEGMENT)
        part = data[at:stop]
        first, last = _words_of(part)
        if len(first):
            base, inverse = _powers(max(len(part), SEGMENT) + 1)
            total = np.empty(len(part) + 1, dtype=np.uint64)
            total[0] = 0
            weighted = (_LOWER[part].astype(np.uint64) + np.uint64(1)) * base[: len(part)]
            np.cumsum(weighted, out=total[1:])
            value = (total[last] - total[first]) * inverse[first]
            hashes.append(mix(value + (last - first).astype(np.uint64)))
            starts.append(first + at)
            ends.append(last + at)
        at = stop
    if not hashes:
        none = np.empty(0, dtype=np.int64)
        return np.empty(0, dtype=np.uint64), none, none
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    _, where, data = column.buffers()
    if where is None or len(column) == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offsets = np.frombuffer(where, dtype=kind)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets.astype(np.int64) - int(offsets[0])


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``most_bytes`` of text each."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1
            stop = min(batch.num_rows, max(stop, at + 1))
            yield batch.slice(at, stop - at)
            at = stop


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def binary_rows(matrix: np.ndarray) -> pa.Array:
    """Each row of a C-contiguous matrix as one binary value, without a copy."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int64) * width
    if offsets[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(matrix)])
    return pa.Array.from_buffers(pa.large_binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix)])


def list_of(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


_NO_ID = -(1 << 63)


def whole(kind: DataType) -> bool:
    return isinstance(kind, (ByteType, ShortType, IntegerType, LongType))


def identity(ident: Column, kind: DataType, text: Column) -> dict[str, Column]:
    """``_id`` and ``_key`` of a row, neither ever null.

    The lowest bit of ``_key`` says whether the id is null, so that a null is
    never taken for the least number.
    """
    number = ident.cast("long") if whole(kind) else F.xxhash64(ident)
    key = F.shiftleft(F.shiftright(F.xxhash64(text.cast("string")), 1), 1).bitwiseOR(ident.isNull().cast("long"))
    return {"_id": F.when(ident.isNull(), F.lit(_NO_ID)).otherwise(number), "_key": key}


def keyed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """All columns as ``c0``, ``c1`` ..., then ``_id`` and ``_key``; the names of id and text."""
    names = docs.columns
    ident, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    inner = shipped(docs).toDF(*[f"c{i}" for i in range(len(names))])
    inner = inner.withColumn(text, F.col(text).cast("string"))
    return inner.withColumns(identity(F.col(ident), docs.schema["doc_id"].dataType, F.col(text))), ident, text


def named(frame: DataFrame, names: list[str]) -> DataFrame:
    """The input columns under their own names again."""
    return frame.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def identified(docs: DataFrame) -> DataFrame:
    """``_id``, ``_key``, ``text`` of rows with a text."""
    inner, _, text = keyed(docs.select("doc_id", "text"))
    return inner.select("_id", "_key", F.col(text).alias("text")).where(F.col("text").isNotNull())


def restored(frame: DataFrame, docs: DataFrame, *pairs: tuple[str, str, str]) -> DataFrame:
    """``frame`` with the ids (column of ``_id``, column of ``_key``, new name) as they were."""
    kind = docs.schema["doc_id"].dataType
    if whole(kind):
        back = lambda i, k: F.when((F.col(i) == _NO_ID) & (F.col(k) % 2 != 0), None).otherwise(F.col(i).cast(kind))
        return frame.withColumns({name: back(i, k) for i, k, name in pairs})
    inner, ident, _ = keyed(docs.select("doc_id", "text"))
    for i, k, name in pairs:
        # one row for each pair, whatever the number of equal rows
        known = inner.groupBy(F.col("_id").alias("_i"), F.col("_key").alias("_k")).agg(F.min(ident).alias(name))
        frame = frame.join(known, (F.col(i) == F.col("_i")) & (F.col(k) == F.col("_k")), "left").drop("_i", "_k")
    return frame
