"""9. Repeated passages by threshold-bounded interval expansion.

Finds every run of ``LEAST`` words that occurs at more than one place of the
corpus, exactly, and says which occurrence is the first.

Candidates. A minimizer (the least hash of ``SPAN`` = LEAST - GRAM + 1
neighbouring GRAM-word windows) lies in every run of LEAST words and, as it
depends on that run alone, at the same place in each copy of it. So all copies
of a run meet in the group of one of its minimizers, and a minimizer that occurs
once in the corpus can be left out. Each occurrence of a shared minimizer gives
a window of those words that a run through it can cover, as 32-bit word hashes.

Decision. The windows of some groups are concatenated, each closed by a symbol
of its own, and their suffixes sorted, which gives the Burrows-Wheeler
transform. Common prefixes of neighbouring suffixes are then found by value:
from the interval of the empty string, all intervals of a level are extended
backwards by each symbol before them; an interval whose right border has no
value yet gets the level as its value and goes to the next level. The expansion
stops at LEAST: borders without a value then have common prefixes of at least
LEAST words, and runs of them are the repeated passages. No text comparison or
LCP array of larger values is ever made.

Large groups. Windows equal to one before are taken out before sorting, and a
block of groups is sorted when it has ``MOST_SYMBOLS``. The LEAST-word runs
through a minimizer that occurs over ``HOT`` times don't meet in one place: runs
are the same if their hashes are, so the first of each is an aggregate with a
part on the map side, and a join says of every run whether it is the first. All
cases give the same result.

Words are those of ``common.word_hashes``. The first occurrence of a run is the
one with the least (doc_id, text hash, position), null ids first.

Defined cases. Ids may be of any type (``common``). Null, blank and short texts
have no runs. Repeated rows, equal in id and text, are one document and no
repetition of each other. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.llm.common import _powers, identified, keyed, mix, named, restored, slices, text_bytes, word_hashes, word_pattern
from loomspan.llm.minmax import _apart

LEAST = 50
GRAM = 24
SPAN = LEAST - GRAM + 1
HOT = 20_000
#: Symbols from which on a block of groups is sorted; the last group may add HOT windows.
MOST_SYMBOLS = 600_000


def _documents(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    spaced, where = _apart(data, offsets)
    hashes, starts, _ = word_hashes(spaced)
    begin = np.searchsorted(starts, where)
    for row in np.flatnonzero(np.diff(begin) >= LEAST):
        yield int(row), hashes[begin[row] : begin[row + 1]]


def _gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    base, inverse = _powers(max(len(words) + 1, 1 << 16))
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * base[: len(words)], out=total[1:])
    return mix((total[size:] - total[:-size]) * inverse[: len(words) - size + 1])


def minimizers(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (of their first word) and hashes of a document's minimizers."""
    grams = _gram_hashes(words, GRAM)
    number = len(grams)
    low = np.uint64((1 << 30) - 1)
    order = (grams & ~low) | (low - np.arange(number, dtype=np.uint64))  # of equal ones the last
    blocks = -(-number // SPAN)
    padded = np.full(blocks * SPAN, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:number] = order
    square = padded.reshape(blocks, SPAN)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = number - SPAN + 1
    least = np.minimum(behind[:windows], ahead[SPAN - 1 : SPAN - 1 + windows])
    places = (low - (np.unique(least) & low)).astype(np.int64)
    places.sort()
    return places, grams[places].view(np.int64)


def _minimizer_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        data, offsets = text_bytes(batch.column(2))
        ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        rows, places, hashes = [], [], []
        for row, words in _documents(data, offsets):
            place, value = minimizers(words)
            rows.append(np.full(len(place), row))
            places.append(place)
            hashes.append(value)
        if not rows:
            continue
        row = np.concatenate(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(hashes)), pa.array(ids[row]), pa.array(keys[row]), pa.array(np.concatenate(places).astype(np.int32))],
            names=["_anchor", "_id", "_key", "_place"],
        )


def _whole(window: bytes) -> int:
    """Hash of a whole window, signed."""
    return xxhash.xxh3_64_intdigest(window) - (1 << 63)


def _window_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows around a document's shared minimizers."""
    names = ["_anchor", "_id", "_key", "_start", "_whole", "_words"]
    for batch in slices(batches, "text"):
        data, offsets = text_bytes(batch.column(2))
        ids, keys, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
        out: list[tuple] = []
        for row, words in _documents(data, offsets):
            short = (words >> np.uint64(32)).astype(np.uint32)
            found = lists[row].values
            place, anchor = (found.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            for at, value in zip(place.tolist(), anchor.tolist()):
                begin = max(0, at - (LEAST - GRAM))
                window = short[begin : min(len(words), at + LEAST)].tobytes()
                out.append((value, ids[row], keys[row], begin, _whole(window), window))
            if len(out) > 20_000:
                yield _rows(out, names)
                out = []
        if out:
            yield _rows(out, names)


def _run_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of a document's runs through hot minimizers, each run once, however many it goes through."""
    for batch in slices(batches, "text"):
        data, offsets = text_bytes(batch.column(2))
        ids, keys, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
        rows, starts, runs = [], [], []
        for row, words in _documents(data, offsets):
            number = len(words) - LEAST + 1
            edges = np.zeros(number + 1, dtype=np.int64)
            place = lists[row].values.field(0).to_numpy(zero_copy_only=False)
            np.add.at(edges, np.maximum(0, place - (LEAST - GRAM)), 1)
            np.add.at(edges, np.minimum(number, place + 1), -1)
            at = np.flatnonzero(np.cumsum(edges[:-1]))
            rows.append(np.full(len(at), row))
            starts.append(at)
            runs.append(_gram_hashes(words, LEAST)[at])
        if rows:
            row = np.concatenate(rows)
            columns = [np.concatenate(runs).view(np.int64), ids[row], keys[row], np.concatenate(starts).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_run", "_id", "_key", "_start"])


def _rows(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out), kinds)], names=names)


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse; all suffixes have to differ.

    Prefix doubling; rank pair and place are packed into one 64-bit number, so
    that each round is a plain sort, where they fit into it (below 2^21 symbols).
    """
    size = len(symbols)
    bits = max(1, int(size).bit_length())
    shift, low = np.uint64(bits), np.uint64((1 << bits) - 1)
    place = np.arange(size, dtype=np.uint64)
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.uint64)
    step = 1
    while True:
        second = np.zeros(size, dtype=np.uint64)
        if step < size:
            second[: size - step] = rank[step:] + np.uint64(1)
        if 3 * bits <= 64:
            packed = np.sort((rank << (shift + shift)) | (second << shift) | place)
            order = (packed & low).astype(np.int64)
            pair = packed >> shift
        else:
            order = np.lexsort((second, rank))
            pair = ((rank << shift) | second)[order]
        new = np.zeros(size, dtype=np.uint64)
        np.cumsum(pair[1:] != pair[:-1], out=new[1:])
        rank = np.empty(size, dtype=np.uint64)
        rank[order] = new
        if int(new[-1]) == size - 1:
            return order, rank.astype(np.int64)
        step *= 2


def reaches(symbols: np.ndarray, closers: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and for each place in it whether the prefix that it has in
    common with the one before is at least ``least`` long.

    ``symbols`` are whole numbers, those below ``closers`` closing a window each.
    """
    order, inverse = suffix_order(symbols)
    size = len(symbols)
    step = inverse[order - 1]  # of the suffix one symbol longer; the first wraps round to a closer's
    head = symbols[order]
    unset = np.ones(size + 1, dtype=bool)
    unset[0] = unset[size] = False
    owner = np.full(size, -1, dtype=np.int64)
    begin, end = np.array([0]), np.array([size - 1])
    for _ in range(least):
        if not len(begin):
            break
        count = end - begin + 1
        total = int(count.sum())
        last = np.cumsum(count)
        inside = np.arange(total) - np.repeat(last - count, count) + np.repeat(begin, count)
        target = step[inside]
        if total * 6 > size:
            owner[target] = np.repeat(np.arange(len(begin)), count)
            target = np.flatnonzero(owner >= 0)
            of = owner[target]
            owner[target] = -1
        else:
            by = np.argsort(target)
            of = np.repeat(np.arange(len(begin)), count)[by]
            target = target[by]
        symbol = head[target]
        edge = np.ones(len(target), dtype=bool)
        edge[1:] = (target[1:] != target[:-1] + 1) | (of[1:] != of[:-1]) | (symbol[1:] != symbol[:-1])
        first = np.flatnonzero(edge)
        begin = target[first]
        end = target[np.append(first[1:], len(target)) - 1]
        fresh = unset[end + 1]
        unset[end + 1] = False
        begin, end = begin[fresh], end[fresh]
    return order, unset[:size]


class _Block:
    """Windows of whole groups, until there are enough of them to sort."""

    def __init__(self):
        self.windows: list[np.ndarray] = []
        self.origin: list[tuple[int, int, int]] = []
        self.copied: list[int] = []
        self.symbols = 0

    def spans(self) -> list[tuple]:
        """(id, key, repeat?, start, end) of the runs of repeated words."""
        if not self.windows:
            return []
        lengths = np.array([len(w) for w in self.windows])
        words = np.concatenate(self.windows)
        window = np.repeat(np.arange(len(lengths)), lengths)
        within = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        ids, keys, starts = (np.array(x, dtype=np.int64) for x in zip(*self.origin))
        found = np.zeros(0, dtype=np.int64)
        group = np.zeros(0, dtype=np.int64)
        if len(self.windows) > 1:
            closers = len(lengths)
            _, compact = np.unique(words, return_inverse=True)
            symbols = np.empty(len(words) + closers, dtype=np.int64)
            at = np.arange(len(words)) + window
            symbols[at] = compact + closers
            ends = np.cumsum(lengths) + np.arange(closers)
            symbols[ends] = np.arange(closers)
            order, joined = reaches(symbols, closers)
            member = joined.copy()
            member[:-1] |= joined[1:]
            number = np.cumsum(~joined)
            back = np.full(len(symbols), -1, dtype=np.int64)
            back[at] = np.arange(len(words))
            found, group = back[order[member]], number[member]
        of = window[found]
        doc, key, position = ids[of], keys[of], starts[of] + within[found]
        by = np.lexsort((position, key, doc, group))
        group, doc, key, position, found = group[by], doc[by], key[by], position[by], found[by]
        head = np.ones(len(by), dtype=bool)
        head[1:] = group[1:] != group[:-1]
        which = np.cumsum(head) - 1
        lead = np.flatnonzero(head)[which] if len(by) else which
        same = (doc == doc[lead]) & (key == key[lead]) & (position == position[lead])
        counts = np.bincount(which, ~same)[which] > 0 if len(by) else same
        doc, key, repeat, position = doc[counts], key[counts], ~same[counts], position[counts]
        if self.copied:
            # runs in a window that has copies are the first of several, if nothing comes before
            has = np.zeros(len(lengths), dtype=bool)
            has[self.copied] = True
            has = has[window] & (within + LEAST <= lengths[window])
            has[found[counts]] = False
            extra = np.flatnonzero(has)
            of = window[extra]
            doc, key = np.concatenate((doc, ids[of])), np.concatenate((key, keys[of]))
            repeat = np.concatenate((repeat, np.zeros(len(extra), dtype=bool)))
            position = np.concatenate((position, starts[of] + within[extra]))
        return _merge(doc, key, repeat, position)


def _merge(doc: np.ndarray, key: np.ndarray, repeat: np.ndarray, position: np.ndarray) -> list[tuple]:
    """Runs of LEAST words at neighbouring positions as spans."""
    if not len(doc):
        return []
    by = np.lexsort((position, repeat, key, doc))
    doc, key, repeat, position = doc[by], key[by], repeat[by], position[by]
    edge = np.ones(len(by), dtype=bool)
    edge[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (repeat[1:] != repeat[:-1]) | (position[1:] > position[:-1] + 1)
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(by)) - 1
    return list(zip(doc[first].tolist(), key[first].tolist(), repeat[first].tolist(), position[first].tolist(), (position[last] + LEAST).tolist()))


def _span_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group, window and occurrence."""
    block, anchor, whole, out = _Block(), None, None, []
    for batch in batches:
        anchors, ids, keys, starts, wholes = (batch.column(k).to_numpy() for k in range(5))
        words = batch.column(5)
        for row in range(batch.num_rows):
            if anchors[row] != anchor:
                if block.symbols > MOST_SYMBOLS:
                    out.extend(block.spans())
                    block = _Block()
                anchor, whole = anchors[row], None
            if wholes[row] == whole:
                if block.origin[-1] != (ids[row], keys[row], starts[row]):
                    length = len(block.windows[-1])
                    if not block.copied or block.copied[-1] != len(block.windows) - 1:
                        block.copied.append(len(block.windows) - 1)
                    if length >= LEAST:
                        out.append((int(ids[row]), int(keys[row]), True, int(starts[row]), int(starts[row]) + length))
                continue
            whole = wholes[row]
            window = np.frombuffer(words[row].as_buffer(), dtype=np.uint32)
            block.windows.append(window)
            block.origin.append((ids[row], keys[row], starts[row]))
            block.symbols += len(window) + 1
        if len(out) > 10_000:
            yield _spans(out)
            out = []
    out.extend(block.spans())
    yield _spans(out)


def _spans(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()]
    columns = list(zip(*out)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["_id", "_key", "_repeat", "_start", "_end"])


def _spans_of(docs: DataFrame) -> DataFrame:
    """``_id``, ``_key``, ``_repeat``, ``_start``, ``_end`` (words), merged."""
    rows = identified(docs)
    anchors = rows.mapInArrow(_minimizer_kernel, "_anchor long, _id long, _key long, _place int")
    # counted with a part on the map side, as a third of all may be one minimizer; rows that are equal aren't several
    where = F.struct("_id", "_key", "_place")
    counts = anchors.groupBy("_anchor").agg(F.count("*").alias("_n"), F.min(where).alias("_low"), F.max(where).alias("_high"))
    counts = counts.where("_low <> _high").select("_anchor", (F.col("_n") > HOT).alias("_hot"))
    listed = F.struct("_place", "_anchor")
    of = lambda hot: F.array_sort(F.collect_set(F.when(F.col("_hot") == hot, listed)))
    shared = anchors.join(counts, "_anchor").groupBy("_id", "_key").agg(of(False).alias("_cold"), of(True).alias("_warm"))
    once = rows.groupBy("_id", "_key").agg(F.first("text").alias("text"))
    held = once.join(shared, ["_id", "_key"])
    windows = held.where(F.size("_cold") > 0).select("_id", "_key", "text", "_cold")
    windows = windows.mapInArrow(_window_kernel, "_anchor long, _id long, _key long, _start int, _whole long, _words binary")
    sorted_windows = windows.repartition("_anchor").sortWithinPartitions("_anchor", "_whole", "_id", "_key", "_start")
    spans = sorted_windows.mapInArrow(_span_kernel, "_id long, _key long, _repeat boolean, _start int, _end int")
    runs = held.where(F.size("_warm") > 0).select("_id", "_key", "text", "_warm").mapInArrow(_run_kernel, "_run long, _id long, _key long, _start int")
    where = F.struct("_id", "_key", "_start")
    firsts = runs.groupBy("_run").agg(F.min(where).alias("_first"), F.max(where).alias("_last")).where("_first <> _last").drop("_last")
    told = runs.join(firsts, "_run").select("_id", "_key", (where != F.col("_first")).alias("_repeat"), "_start", (F.col("_start") + LEAST).alias("_end"))
    spans = spans.unionByName(told)
    order = Window.partitionBy("_id", "_key", "_repeat").orderBy("_start", "_end")
    reach = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # spans that only touch are runs of their own unless a run joins them
    opens = F.when(reach.isNull() | (F.col("_start") > reach - LEAST + 1), 1).otherwise(0)
    islands = spans.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(order))
    return islands.groupBy("_id", "_key", "_repeat", "_island").agg(F.min("_start").alias("_start"), F.max("_end").alias("_end")).drop("_island")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``kind``, ``start_word``, ``end_word`` of each repeated passage.

    ``kind`` is ``repeat`` where every LEAST-word run has an earlier occurrence
    and ``first`` where each is the first of several. Passages are maximal runs
    of neighbouring such positions; word numbers count from 0, the end is the
    first word after.
    """
    found = restored(_spans_of(docs), docs, ("_id", "_key", "doc_id"))
    return found.select(
        "doc_id",
        F.when(F.col("_repeat"), "repeat").otherwise("first").alias("kind"),
        F.col("_start").alias("start_word"),
        F.col("_end").alias("end_word"),
    )


def _cut_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words in the given spans."""
    for batch in slices(batches, "text"):
        data, offsets = text_bytes(batch.column(0))
        spans, texts = batch.column(1), []
        for row in range(batch.num_rows):
            if not spans[row].is_valid:
                texts.append(batch.column(0)[row].as_py())
                continue
            raw = data[offsets[row] : offsets[row + 1]]
            _, starts, ends = word_hashes(raw)
            stay = np.ones(len(raw), dtype=bool)
            for span in spans[row].as_py():
                stay[starts[span["_start"]] : ends[span["_end"] - 1]] = False
            texts.append(raw[stay].tobytes().decode())
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[2:]], names=["text", *batch.schema.names[2:]])


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """The documents without passages that occur earlier; other columns as they are.

    A document of which no word is left is left out.
    """
    inner, _, text = keyed(docs)
    spans = _spans_of(docs).where("_repeat").groupBy("_id", "_key").agg(F.collect_list(F.struct("_start", "_end")).alias("_spans"))
    more = [(f"c{i}", f.dataType.simpleString()) for i, f in enumerate(docs.schema.fields) if f.name != "text"]
    joined = inner.join(spans, ["_id", "_key"], "left").select(F.col(text).alias("text"), "_spans", *[c for c, _ in more])
    left = joined.withColumn("_had", F.col("_spans").isNotNull()).mapInArrow(_cut_kernel, "text string" + "".join(f", {c} {k}" for c, k in more) + ", _had boolean")
    left = left.where(~F.col("_had") | F.col("text").rlike(word_pattern(upper=True)))
    return named(left.withColumnRenamed("text", text), docs.columns)
