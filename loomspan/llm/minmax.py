"""8. Near-duplicate documents by min-max hashing.

A document is the set of its shingles of ``SHINGLE`` words. Each of ``HASHES``
permutations gives two values of its signature, the least and the greatest hash,
so that a signature of 128 values takes 64 evaluations a shingle; the share of
equal values is an unbiased estimate of the Jaccard similarity, with a variance
below that of as many evaluations of plain min-hashing. Signatures are banded,
minima and maxima in bands of their own; documents that share a band and whose
estimate reaches ``THRESHOLD`` are linked, and the linked components are the
groups.

Within a band's bucket the components of the threshold graph are found exactly:
a breadth-first search compares each member it reaches with those not reached
yet. A bucket of alike documents takes one pass, however large; no bucket is
cut or skipped. Equal signatures are folded into one beforehand, so that
thousands of copies make one member.

Large buckets. Two members that reach the threshold share one of each other's
rarest values (of n values, of which ``need`` have to be equal, one of the
n - need + 1 rarest in the bucket), so that in a bucket of over ``DIRECT``
members only those are compared that share such a value and aren't linked yet.
What unlike members of a bucket share is common in it, so few pairs are left; no
link is lost. A bucket of over ``BLOCK`` members is dealt out to blocks by hash,
each pair of blocks being one such bucket, so that no task holds more than two.

Words are those of ``common.word_hashes``. A text of fewer words than a shingle
has is one shingle; a text without words is its own bytes as a shingle.

Defined cases. Null text: in no group, always kept. Empty texts are copies of
each other. Repeated rows are copies of each other, also those with equal ids;
of a group the row with the least (doc_id, text hash) is kept, null ids first;
among rows equal in both, the one whose other columns have the least hash, then
the least values (columns of maps aside). Ids may be of any type (``common``).
Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.llm.common import binary_rows, identified, keyed, mix, named, restored, slices, text_bytes, word_hashes
from loomspan.llm.components import components
from loomspan.session import cut

SHINGLE = 3
HASHES = 64
BAND_ROWS = 4
THRESHOLD = 0.45
#: Members of a bucket that are compared directly; members that a task holds at most twice.
DIRECT = 256
BLOCK = 50_000
_FEW = 8

_FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SHIFTS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the documents in a buffer, and where each document's begin."""
    spaced, where = _apart(data, offsets)
    hashes, starts, _ = word_hashes(spaced)
    begin = np.searchsorted(starts, where)
    count = np.diff(begin)
    total = np.zeros(len(hashes), dtype=np.uint64)
    lengths = np.repeat(count, count)
    place = np.arange(len(hashes)) - np.repeat(begin[:-1], count)
    padded = np.concatenate((hashes, np.zeros(size, dtype=np.uint64)))
    for k in range(size):
        factor = np.uint64(pow(0xC2B2AE3D27D4EB4F, k, 1 << 64))
        inside = place + k < lengths
        total += np.where(inside, padded[k : k + len(hashes)], np.uint64(0)) * factor
    use = place < np.maximum(1, lengths - size + 1)
    shingles = mix(total[use])
    number = np.where(count > 0, np.maximum(1, count - size + 1), 1)
    first = np.concatenate(([0], np.cumsum(number)))
    if (count == 0).any():
        whole = np.empty(first[-1], dtype=np.uint64)
        blank = np.zeros(first[-1], dtype=bool)
        blank[first[:-1][count == 0]] = True
        whole[~blank] = shingles
        whole[blank] = [xxhash.xxh3_64_intdigest(data[offsets[i] : offsets[i + 1]].tobytes()) for i in np.flatnonzero(count == 0)]
        shingles = whole
    return shingles, first


def _apart(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buffer with a separator after each document, and the new offsets."""
    size = np.diff(offsets)
    where = offsets + np.arange(len(offsets))
    out = np.full(int(where[-1]), 32, dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data
    return out, where


def signatures(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of 2 x HASHES 32-bit values a document: minima, then maxima."""
    out = np.empty((len(first) - 1, 2 * HASHES), dtype=np.uint32)
    at = first[:-1]
    step = np.empty_like(shingles)
    for k in range(HASHES):
        np.multiply(shingles, _FACTORS[k], out=step)
        np.add(step, _SHIFTS[k], out=step)
        out[:, k] = np.minimum.reduceat(step, at) >> np.uint64(32)
        out[:, HASHES + k] = np.maximum.reduceat(step, at) >> np.uint64(32)
    return out


def _signature_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        data, offsets = text_bytes(batch.column(2))
        made = signatures(*shingle_hashes(data, offsets))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), binary_rows(made)], names=["_id", "_key", "_sig"])


def _band_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bands = 2 * HASHES // BAND_ROWS
    factors = mix(np.arange(1, BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    salt = mix(np.arange(bands, dtype=np.uint64) + np.uint64(77))
    for batch in batches:
        if not batch.num_rows:
            continue
        values = _matrix(batch.column(1)).reshape(-1, bands, BAND_ROWS).astype(np.uint64)
        keys = mix((values * factors).sum(axis=2, dtype=np.uint64) ^ salt).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), bands))], names=["_band", "_node"])


def _matrix(column: pa.Array) -> np.ndarray:
    data, _ = text_bytes(column)
    return np.frombuffer(data.tobytes(), dtype=np.uint32).reshape(len(column), 2 * HASHES)


def _search(nodes: np.ndarray, sigs: np.ndarray, labels: np.ndarray, need: int) -> list[tuple[int, int]]:
    """A breadth-first search through members; those with one label are linked already."""
    edges: list[tuple[int, int]] = []
    rest = np.argsort(labels, kind="stable")
    while len(rest) > 1:
        same = labels[rest] == labels[rest[0]]
        frontier, rest = rest[same].tolist(), rest[~same]
        while frontier and len(rest):
            one = frontier.pop()
            equal = np.empty(len(rest), dtype=np.int64)
            for at in range(0, len(rest), 4096):
                equal[at : at + 4096] = (sigs[rest[at : at + 4096]] == sigs[one]).sum(axis=1)
            near = np.isin(labels[rest], labels[rest[equal >= need]])  # and what is linked with them
            frontier.extend(rest[near].tolist())
            edges.extend((int(nodes[one]), int(nodes[x])) for x in rest[equal >= need])
            rest = rest[~near]
    return edges


def _joined_labels(labels: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Labels after linking pairs of members: the least of each component."""
    if not len(pairs):
        return labels
    a, b = labels[pairs[:, 0]], labels[pairs[:, 1]]
    least = np.arange(len(labels))
    while True:
        low = np.minimum(least[a], least[b])
        before = least.copy()
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        np.minimum.at(least, before[a], low)
        np.minimum.at(least, before[b], low)
        least = least[least]
        if (least == before).all():
            return least[labels]


def link_bucket(nodes: np.ndarray, sigs: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Edges with the components of the graph of pairs whose estimate reaches the threshold."""
    need = int(np.ceil(threshold * sigs.shape[1]))
    labels = np.arange(len(nodes))
    if len(nodes) <= DIRECT:
        return _search(nodes, sigs, labels, need)
    edges: list[tuple[int, int]] = []
    token, common = np.empty(sigs.shape, np.int64), np.empty(sigs.shape, np.int64)
    for k in range(sigs.shape[1]):  # numbers of the values of a place, and how many have each
        _, which, count = np.unique(sigs[:, k], return_inverse=True, return_counts=True)
        token[:, k], common[:, k] = which * np.int64(sigs.shape[1]) + k, count[which]
    # by (number, value), the same order for all members
    by = np.argsort(common * (np.int64(1) << 40) + token % (np.int64(1) << 40), axis=1, kind="stable")[:, : sigs.shape[1] - need + 1]
    rare, often = np.take_along_axis(token, by, 1), np.take_along_axis(common, by, 1)
    member = np.broadcast_to(np.arange(len(nodes))[:, None], rare.shape)[often > 1]
    value = rare[often > 1]
    order = np.lexsort((member, value))
    member, value = member[order], value[order]
    first = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(value)))
    # small groups at once, as pairs of members so many places apart
    for start in range(0, len(first), 200_000):
        some, many = first[start : start + 200_000], size[start : start + 200_000]
        found = []
        for step in range(1, _FEW):
            for offset in range(_FEW - step):
                fits = (many <= _FEW) & (many > offset + step)
                found.append(np.stack((member[some[fits] + offset], member[some[fits] + offset + step]), axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        pairs = pairs[labels[pairs[:, 0]] != labels[pairs[:, 1]]]
        equal = np.zeros(len(pairs), dtype=np.int64)
        for at in range(0, len(pairs), 65536):
            equal[at : at + 65536] = (sigs[pairs[at : at + 65536, 0]] == sigs[pairs[at : at + 65536, 1]]).sum(axis=1)
        pairs = pairs[equal >= need]
        edges.extend(zip(nodes[pairs[:, 0]].tolist(), nodes[pairs[:, 1]].tolist()))
        labels = _joined_labels(labels, pairs)
    place = {int(n): k for k, n in enumerate(nodes)}
    for at in np.flatnonzero(size > _FEW):
        inside = member[first[at] : first[at] + size[at]]
        if (labels[inside] == labels[inside[0]]).all():
            continue
        new = _search(nodes[inside], sigs[inside], labels[inside], need)
        if new:
            edges.extend(new)
            labels = _joined_labels(labels, np.array([(place[a], place[b]) for a, b in new]))
    return edges


def _link_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by band and pair of blocks; a bucket may go on in the next batch."""

    def flush(nodes: list[np.ndarray], sigs: list[np.ndarray], out: list) -> None:
        if nodes and sum(map(len, nodes)) > 1:
            out.extend(link_bucket(np.concatenate(nodes), np.concatenate(sigs)))

    band, nodes, sigs = None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        out: list[tuple[int, int]] = []
        bands, one, two, members = (batch.column(k).to_numpy() for k in range(4))
        values = _matrix(batch.column(4))
        edges = np.concatenate(([0], np.flatnonzero((np.diff(bands) != 0) | (np.diff(one) != 0) | (np.diff(two) != 0)) + 1, [len(bands)]))
        for begin, end in zip(edges[:-1], edges[1:]):
            if (bands[begin], one[begin], two[begin]) != band:
                flush(nodes, sigs, out)
                band, nodes, sigs = (bands[begin], one[begin], two[begin]), [], []
            nodes.append(members[begin:end])
            sigs.append(values[begin:end])
        yield _edges(out)
    out = []
    flush(nodes, sigs, out)
    yield _edges(out)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["src", "dst"])


def _grouped(docs: DataFrame) -> DataFrame:
    """``_id``, ``_key``, ``_group`` of each distinct (id, text) that isn't alone.

    A node of the graph is the 64-bit hash of a signature, that of all copies.
    """
    signed = cut(identified(docs).mapInArrow(_signature_kernel, "_id long, _key long, _sig binary").withColumn("_node", F.xxhash64("_sig")))
    nodes = signed.groupBy("_node").agg(F.first("_sig").alias("_sig"))
    banded = nodes.select("_node", "_sig").mapInArrow(_band_kernel, "_band long, _node long")
    # counted with a part on the map side, as a third of all may share a band
    shared = banded.groupBy("_band").agg(F.count("*").alias("_n")).where("_n > 1")
    shared = banded.join(shared, "_band").withColumn("_blocks", F.ceil(F.col("_n") / BLOCK).cast("int"))
    mine = F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("int")
    shared = shared.select("_band", "_node", mine.alias("_mine"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    shared = shared.select("_band", F.least("_mine", "_other").alias("_one"), F.greatest("_mine", "_other").alias("_two"), "_node")
    held = shared.join(nodes, "_node").select("_band", "_one", "_two", "_node", "_sig")
    linked = held.repartition("_band", "_one", "_two").sortWithinPartitions("_band", "_one", "_two", "_node").mapInArrow(_link_kernel, "src long, dst long")
    found = components(linked.distinct())
    placed = signed.select("_id", "_key", "_node").join(found, F.col("_node") == F.col("node"), "left")
    return placed.select("_id", "_key", F.coalesce("component", "_node").alias("_component"))


def _ranked(docs: DataFrame) -> DataFrame:
    """Rows of groups of two or more, with the group's least row and its size.

    Sizes and least rows are aggregates with a map-side part, so that a large
    group isn't gathered in one place.
    """
    rows = cut(_grouped(docs))
    least = F.min(F.struct("_id", "_key")).alias("_least")
    groups = rows.groupBy("_component").agg(least, F.count("*").alias("group_size")).where("group_size > 1")
    return rows.join(groups, "_component").select("_id", "_key", "_least", "group_size")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Members of all groups of two or more rows.

    ``doc_id``, ``group_id`` (the id of the row that stays), ``group_size`` and
    ``keep``. Rows equal in id and text appear as often as they occur; ``keep``
    is true for each that equals the one that stays.
    """
    found = _ranked(docs).select(
        "_id",
        "_key",
        F.col("_least._id").alias("_least_id"),
        F.col("_least._key").alias("_least_key"),
        "group_size",
        ((F.col("_id") == F.col("_least._id")) & (F.col("_key") == F.col("_least._key"))).alias("keep"),
    )
    found = restored(found, docs, ("_id", "_key", "doc_id"), ("_least_id", "_least_key", "group_id"))
    return found.select("doc_id", "group_id", "group_size", "keep")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents without those that a group's first one stands for."""
    inner, _, text = keyed(docs)
    gone = _ranked(docs).where((F.col("_id") != F.col("_least._id")) | (F.col("_key") != F.col("_least._key")))
    some = inner.where(F.col(text).isNotNull()).join(gone.select("_id", "_key").distinct(), ["_id", "_key"], "left_anti")
    plain = [f"c{i}" for i, f in enumerate(docs.schema.fields) if "map<" not in f.dataType.simpleString()]
    # only the first of each row's repetitions; a limit that is applied before the shuffle too
    once = Window.partitionBy("_id", "_key").orderBy(F.xxhash64(*plain), *plain)
    some = some.withColumn("_copy", F.row_number().over(once)).where("_copy = 1").drop("_copy")
    return named(some.unionByName(inner.where(F.col(text).isNull())), docs.columns)
