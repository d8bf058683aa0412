"""4. Best-fit decreasing packing of documents into bins of equal capacity.

Lengths are whole numbers up to the capacity, so best-fit decreasing only needs
to know how many pieces there are of each length. ``plan`` runs it on that
histogram, on the driver: a segment tree over the remaining capacities finds
the tightest open bin in logarithmic time, and because the next piece of equal
length goes where the last one went as long as it fits, a run of pieces is
placed at once. The plan maps ranks within a length to bins; it is bounded by
the capacity, not by the corpus. The pieces then look their bin up by their
rank. The result is the one that packing all pieces one after another gives;
nothing is packed by shard.

Documents over the capacity are cut into full pieces and a rest. Pieces of
equal length are placed in the order of the hash of their document's id, then
the id, then the piece's number.

Defined cases. Null or empty texts have no tokens and aren't packed (no row).
Null ids are packed like others; they sort first. Repeated rows are packed as
often as they occur. Empty table: no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.llm import vocabularies
from loomspan.llm.lengths import VOCABULARY, encoded_lengths
from loomspan.session import cut

CAPACITY = 2048
#: Pieces that are ranked in one task.
SHARD_ROWS = 1_000_000


class CapacityTree:
    """Open bins by remaining capacity; ``tightest`` finds the least that fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)
        self.bins: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]

    def tightest(self, least: int) -> int | None:
        node = least + self.size
        if self.any[node]:
            return least
        while node > 1:
            if not node & 1 and self.any[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.size:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.size

    def push(self, remaining: int, start: int, count: int) -> None:
        if remaining == 0 or count == 0:
            return
        self.bins[remaining].append((start, count))
        node = remaining + self.size
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def pop(self, remaining: int) -> tuple[int, int]:
        run = self.bins[remaining].popleft()
        if not self.bins[remaining]:
            node = remaining + self.size
            self.any[node] = 0
            node >>= 1
            while node and not (self.any[2 * node] or self.any[2 * node + 1]):
                self.any[node] = 0
                node >>= 1
        return run


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first bin, pieces a bin), sorted; number of bins.

    A piece of that length with rank r, r at least the first rank and below the
    next row's, goes to bin first bin + (r - first rank) // pieces a bin.
    """
    tree, rows, bins = CapacityTree(capacity), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, start = capacity, bins
                each = remaining // length
                open_bins = -(-left // each)
                bins += open_bins
            else:
                start, open_bins = tree.pop(remaining)
                each = remaining // length
            used = min(open_bins, -(-left // each))
            placed = min(left, used * each)
            full, rest = divmod(placed, each)
            rows.append((length, rank, start, each))
            if used < open_bins:
                tree.push(remaining, start + used, open_bins - used)
            tree.push(remaining - each * length, start, full)
            if rest:
                tree.push(remaining - rest * length, start + full, 1)
            left -= placed
            rank += placed
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4), bins


def pack(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Bins of rows with ``doc_id`` and ``n_tokens``.

    Gives ``bin_id``, ``doc_id``, ``piece`` (number of the part of a document
    over the capacity), ``start`` (of the piece in the document) and
    ``n_tokens`` of each piece.
    """
    spark = lengths.sparkSession
    kind = lengths.schema["doc_id"].dataType.simpleString()
    pieces = lengths.where(F.col("n_tokens") > 0).select(
        "doc_id",
        F.col("n_tokens").cast("long").alias("_total"),
        F.explode(F.expr(f"sequence(0L, (n_tokens - 1) div {capacity})")).alias("piece"),
    )
    pieces = pieces.select(
        "doc_id",
        F.xxhash64("doc_id").alias("_hash"),
        F.col("piece").cast("int").alias("piece"),
        F.least(F.lit(capacity), F.col("_total") - F.col("piece") * capacity).cast("int").alias("n_tokens"),
    )
    pieces = cut(pieces)
    counts = {r["n_tokens"]: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}  # at most ``capacity`` rows
    bits = max(0, sum(counts.values()) // SHARD_ROWS).bit_length()
    shards = 1 << bits
    pieces = pieces.withColumn("_shard", F.shiftright("_hash", 64 - bits) if bits else F.lit(0).cast("long"))

    in_shard = Window.partitionBy("n_tokens", "_shard").orderBy("_hash", "doc_id", "piece")
    ranked = pieces.withColumn("_rank", F.row_number().over(in_shard).cast("long") - 1)
    if shards > 1:
        earlier = Window.partitionBy("n_tokens").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
        before = pieces.groupBy("n_tokens", "_shard").count()
        before = before.select("n_tokens", "_shard", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
        ranked = ranked.join(before, ["n_tokens", "_shard"]).withColumn("_rank", F.col("_rank") + F.col("_before"))

    rows, _ = plan(counts, capacity)
    rows_of = spark.sparkContext.broadcast(rows)  # bounded by the capacity

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rows_of.value
        keys = (table[:, 0] << 44) | table[:, 1]
        for batch in batches:
            size, rank = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            found = np.searchsorted(keys, (size << 44) | rank, side="right") - 1
            row = table[found]
            bins = row[:, 2] + (rank - row[:, 1]) // row[:, 3]
            start = batch.column(1).to_numpy().astype(np.int64) * capacity
            yield pa.RecordBatch.from_arrays(
                [pa.array(bins), batch.column(0), batch.column(1), pa.array(start), batch.column(2)],
                names=["bin_id", "doc_id", "piece", "start", "n_tokens"],
            )

    return ranked.select("doc_id", "piece", "n_tokens", "_rank").mapInArrow(
        assign, f"bin_id long, doc_id {kind}, piece int, start long, n_tokens int"
    )


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, folder: str = vocabularies.FOLDER) -> DataFrame:
    return pack(encoded_lengths(docs, vocabulary, folder), capacity)
