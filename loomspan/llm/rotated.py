"""3. Nearest neighbours by inner product from randomly rotated one-bit codes.

Index. Every distinct vector belongs to the cell of its nearest centre. What is
left after its centre is taken off is rotated by a random orthogonal matrix (into
``CODE_BITS`` dimensions at least, as longer codes err less) and kept as one sign
bit a dimension, packed, with two scalars: its length, and the inner product of
its direction with its code. Codes and scalars are what is stored, shuffled and
scanned; the vectors themselves are fetched for survivors only.

Estimates. The bits of a query's rotation that differ from a code (exclusive or,
population count) bound their angle within ``SIGMAS`` deviations of a count of
that many signs; pairs that this bound leaves are estimated without bias from the
packed bits, ``<q, code> / correction``, with an error that stays within ``BOUND``
* sqrt((1 - a^2) / a^2 / (bits - 1)) of the lengths but for few cases. Pairs whose
upper bound reaches the query's floor survive and are reranked exactly. The floor
is the k-th best exact inner product among the ``FIRST`` * k best by estimate, from
a first pass.

Probes. A query visits the cells of the ``probes`` centres it has the greatest
inner products with. ``probes`` is measured, not set: ``CALIBRATE`` queries are
compared exactly with every vector, and the least number is taken that holds
``TARGET`` of their true neighbours. Clustered vectors need few; vectors without
structure need all cells, and get them. Queries that find too few in those cells
visit all. Cells are split into blocks of ``BLOCK_ROWS`` by hash, and a cell's
queries into tasks of ``TASK_QUERIES``, so no cell has to be in one task.

Bounds. There are at most ``MOST_CELLS`` centres, fitted by k-means on the
vectors of least hash, ``SAMPLE_PER_CELL`` a cell and ``SAMPLE_BYTES`` in all.
Beyond ``MOST_CELLS`` * ``CELL_ROWS`` vectors cells grow instead, and so does the
work of a query. Equal vectors are one; of their ids only the least k + 1 can be
in a result, and only these are kept, which a limit before the shuffle does.
``queries`` restricts the queries, never the vectors that are searched.

Defined cases. Ids of any type that can be ordered. Null ids, null and empty
vectors, vectors with nulls, NaN or numbers over ``GREATEST`` (whose products
overflow) are left out, and of the rest those of another length than the most
frequent one (of several, the least). Zero vectors are neighbours like others.
Equal rows count once. Of an id with several vectors all count: its neighbours, and
it as a neighbour, are ranked by the best pair of their vectors, each id once; a
row isn't a neighbour of a row of its own id. Ties go to the least id. Fewer than
k others: all of them. Empty table, or no query: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.llm.common import binary_rows, text_bytes
from loomspan.session import cut, shipped

NEIGHBOURS = 10
CODE_BITS = 256
BOUND = 1.9
SIGMAS = 3.0
CELL_ROWS = 2048
MOST_CELLS = 4096
SAMPLE_PER_CELL = 48
SAMPLE_BYTES = 64 << 20
BLOCK_ROWS = 131_072
TASK_QUERIES = 20_000
FIRST = 4
CALIBRATE = 200
TARGET = 0.99
GREATEST = 1e17
_SLICE = 32


def code_bits(dimensions: int) -> int:
    return max(CODE_BITS, -(-dimensions // 64) * 64)


def rotation(dimensions: int, seed: int = 11) -> np.ndarray:
    """The rows of a random orthogonal matrix that turn vectors into ``code_bits`` dimensions."""
    bits = code_bits(dimensions)
    made, upper = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    return (made * np.sign(np.diag(upper))).astype(np.float32)[:dimensions]


def codes(rest: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, length and correction of vectors relative to their centre."""
    length = np.linalg.norm(rest, axis=1)
    turned = (rest / np.maximum(length, 1e-20)[:, None]) @ turn
    fit = np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1])
    return np.packbits(turned > 0, axis=1), length.astype(np.float32), np.maximum(fit, 1e-6).astype(np.float32)


def words(bits: np.ndarray) -> np.ndarray:
    """Packed codes as 64-bit words, one row a word."""
    return np.ascontiguousarray(np.ascontiguousarray(bits).view(np.uint64).T)


def differing(queries: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Number of bits in which each query's code differs from each code (both as words)."""
    total = np.zeros((queries.shape[1], held.shape[1]), np.uint16)
    other = np.empty(total.shape, np.uint64)
    count = np.empty(total.shape, np.uint8)
    for q, h in zip(queries, held):
        np.bitwise_xor(q[:, None], h, out=other)
        np.bitwise_count(other, out=count)
        total += count
    return total


def angle_table(bits: int) -> np.ndarray:
    """For each number of differing bits, what the cosine hardly exceeds."""
    angle = np.pi * (np.arange(bits + 1) / bits - SIGMAS * 0.5 / np.sqrt(bits))
    return np.cos(np.maximum(0, angle)).astype(np.float32)


def estimates(turned: np.ndarray, bits: np.ndarray, length: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of rotated queries with the coded rests beside them, and error bounds."""
    size = turned.shape[1]
    # twice the sum over the set bits, less the sum of all
    chosen = np.einsum("ij,ij->i", turned, np.unpackbits(bits, axis=1, count=size).astype(np.float32))
    product = (2 * chosen - turned.sum(axis=1)) / np.sqrt(size)
    spread = np.sqrt(np.maximum(0, 1 - fit**2)) / fit / np.sqrt(size - 1)
    return product * (length / fit), BOUND * np.linalg.norm(turned, axis=1) * length * spread


class _Block:
    """The codes of one block of a cell, sorted by the id that counts for them."""

    def __init__(self, keys: pa.Array, own: np.ndarray, single: np.ndarray, bits: np.ndarray, length: np.ndarray, fit: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        by = np.argsort(own, kind="stable")
        self.keys, self.own, self.single = keys.take(pa.array(by)), own[by], single[by]
        self.bits, self.length, self.fit = bits[by], length[by], fit[by]
        self.words, self.centre, self.turn = words(self.bits), centre, turn
        self.first_of = np.flatnonzero(np.append(True, self.own[1:] != self.own[:-1]))
        self.table = angle_table(turn.shape[1])

    def _estimated(self, turned: np.ndarray, middle: np.ndarray, row: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        about, error = np.empty(len(row), np.float32), np.empty(len(row), np.float32)
        for at in range(0, len(row), 8192):
            r, c = row[at : at + 8192], column[at : at + 8192]
            about[at : at + 8192], error[at : at + 8192] = estimates(turned[r], self.bits[c], self.length[c], self.fit[c])
        return middle[row] + about, error

    def best(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, code, estimate) of the codes nearest by estimate, at most k ids a query."""
        turned, middle = queries @ self.turn, queries @ self.centre
        size = np.linalg.norm(queries, axis=1)
        hamming = differing(words(np.packbits(turned > 0, axis=1)), self.words)
        upper = self.table[hamming] * self.length * size[:, None]
        grouped = len(self.first_of) < len(self.own)
        if grouped:
            upper = np.maximum.reduceat(upper, self.first_of, axis=1)
        take = min(2 * k, upper.shape[1])
        chosen = np.argpartition(-upper, take - 1, axis=1)[:, :take]
        row = np.repeat(np.arange(len(queries)), take)
        column = chosen.ravel()
        if grouped:  # of each id the vector of the greatest bound
            ends = np.append(self.first_of[1:], len(self.own))
            spans = [slice(self.first_of[g], ends[g]) for g in column]
            column = np.array([s.start + np.argmax(self.table[hamming[r, s]] * self.length[s]) for r, s in zip(row, spans)])
        about, _ = self._estimated(turned, middle, row, column)
        by = np.lexsort((-about, row))
        row, column, about = row[by], column[by], about[by]
        stay = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[stay], column[stay], about[stay]

    def survivors(self, queries: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, code, estimate) of the pairs whose upper bound reaches the floor."""
        turned, middle = queries @ self.turn, queries @ self.centre
        size = np.maximum(np.linalg.norm(queries, axis=1), 1e-20)
        hamming = differing(words(np.packbits(turned > 0, axis=1)), self.words)
        least = (floor - middle) / size - 1e-5
        row, column = np.nonzero(self.table[hamming] * self.length >= least[:, None])
        about, error = self._estimated(turned, middle, row, column)
        good = about + error >= floor[row] - 1e-5 * size[row]
        row, column, about, error = row[good], column[good], about[good], error[good]
        if len(self.first_of) < len(self.own) and len(row):
            # of an id alone on its vectors only those that can be its best one
            group = np.append(True, (row[1:] != row[:-1]) | (self.own[column[1:]] != self.own[column[:-1]]))
            low = np.maximum.reduceat(about - error, np.flatnonzero(group))[np.cumsum(group) - 1]
            can = (about + error >= low) | ~self.single[column]
            row, column, about = row[can], column[can], about[can]
        return row, column, about


def _floats(column: pa.Array, dimensions: int) -> np.ndarray:
    data, _ = text_bytes(column)
    return np.frombuffer(data.tobytes(), dtype=np.float32).reshape(len(column), dimensions)


def _scan_kernel(dimensions: int, centres, k: int | None):
    """Pairs of queries and codes; the best k by estimate, or without k those that reach the floor.

    Rows come sorted by cell, block and task, codes before queries.
    """
    names = ["_q", "_h", "_own", "_about"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dimensions)
        width = turn.shape[1] // 8
        current, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, part, task, query, own, single, length, fit = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(8))
            edge = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(task) != 0) | (np.diff(query) != 0)) + 1
            for begin, end in zip(np.concatenate(([0], edge)), np.concatenate((edge, [len(cell)]))):
                here = (cell[begin], part[begin], task[begin])
                if here != current:
                    current, held, block = here, [], None
                keys, packed = batch.column(8).slice(begin, end - begin), batch.column(9).slice(begin, end - begin)
                if not query[begin]:
                    bits = text_bytes(packed)[0].reshape(-1, width)
                    held.append((keys, own[begin:end], single[begin:end], bits, length[begin:end], fit[begin:end]))
                    continue
                if not held:
                    continue
                if block is None:
                    columns = [np.concatenate(c) for c in list(zip(*held))[1:]]
                    block = _Block(pa.concat_arrays([h[0] for h in held]), *columns, centres.value[here[0]], turn)
                asked = _floats(packed, dimensions)
                for at in range(0, len(asked), _SLICE):
                    some, floor = asked[at : at + _SLICE], length[begin + at : min(end, begin + at + _SLICE)]
                    row, column, about = block.survivors(some, floor) if k is None else block.best(some, k)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([keys.take(pa.array(row + at)), block.keys.take(pa.array(column)), pa.array(block.own[column]), pa.array(about.astype(np.float64))], names=names)

    return kernel


def _centres(points: DataFrame, count: int, cells: int, dimensions: int) -> np.ndarray:
    """k-means on the vectors of least hash, a bounded sample."""
    most = min(count, cells * SAMPLE_PER_CELL, max(cells, SAMPLE_BYTES // (4 * dimensions)))
    sample = points.orderBy("_h").limit(most).select("_vector").toArrow()
    rows = _floats(sample.column(0).combine_chunks(), dimensions)
    centres = rows[:: max(1, len(rows) // cells)][:cells].copy()
    for _ in range(4):
        nearest = (rows @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
        size = np.bincount(nearest, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, nearest, rows)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


def _probes(points: DataFrame, asked: DataFrame, centres, dimensions: int, k: int) -> int:
    """The least number of cells that holds ``TARGET`` of the true neighbours of some queries.

    The queries of least hash, ``CALIBRATE`` of them, against every vector; each
    task gives its best k a query.
    """
    cells = len(centres.value)
    if cells == 1:
        return 1
    sample = _floats(asked.orderBy("_h").limit(CALIBRATE).select("_vector").toArrow().column(0).combine_chunks(), dimensions)
    held = points.sparkSession.sparkContext.broadcast(sample)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = 0.5 * (centres.value**2).sum(axis=1)
        values = np.full((len(held.value), 0), 0, np.float32)
        cell = np.zeros((len(held.value), 0), np.int32)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _floats(batch.column(0), dimensions)
            where = (rows @ centres.value.T - half).argmax(axis=1).astype(np.int32)
            values = np.hstack((values, held.value @ rows.T))
            cell = np.hstack((cell, np.broadcast_to(where, (len(held.value), len(rows)))))
            if values.shape[1] > k:
                best = np.argpartition(-values, k - 1, axis=1)[:, :k]
                values, cell = np.take_along_axis(values, best, 1), np.take_along_axis(cell, best, 1)
        number = np.repeat(np.arange(len(values), dtype=np.int32), values.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(cell.ravel()), pa.array(values.ravel())], names=["n", "cell", "value"])

    best = Window.partitionBy("n").orderBy(F.desc("value"))
    found = points.select("_vector").mapInArrow(kernel, "n int, cell int, value float")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("n", "cell").collect()  # at most CALIBRATE * k rows
    order = np.argsort(np.argsort(-(sample @ centres.value.T), axis=1, kind="stable"), axis=1)
    needed = np.sort([order[r["n"], r["cell"]] for r in found]) + 1
    return int(needed[int(np.ceil(TARGET * len(needed))) - 1])


def nearest_neighbours(table: DataFrame, k: int = NEIGHBOURS, column: str = "embedding", queries: Column | None = None) -> DataFrame:
    """``vec_id``, ``rank`` (1 to k), ``neighbour``, ``score`` for the query rows, by default all, against every row.

    ``queries`` is a condition on ``vec_id``.
    """
    spark, most = table.sparkSession, k + 1  # a query's own id is one of them
    given = shipped(table).select("vec_id", F.col(column).cast("array<float>").alias("_given"))
    kind = given.schema["vec_id"].dataType.simpleString()
    # NaN is greater than any number
    sound = ~F.exists("_given", lambda x: x.isNull() | (F.abs(x) > GREATEST))
    given = given.where(F.col("vec_id").isNotNull() & F.col("_given").isNotNull() & (F.size("_given") > 0) & sound)
    usual = given.groupBy(F.size("_given").alias("n")).count().orderBy(F.desc("count"), "n").head()
    dimensions = usual["n"] if usual else 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32) + np.float32(0)  # no negative zeros
            yield pa.RecordBatch.from_arrays([batch.column(0), binary_rows(flat.reshape(-1, dimensions))], names=["vec_id", "_vector"])

    packed = given.where(F.size("_given") == dimensions).mapInArrow(pack, f"vec_id {kind}, _vector binary")
    rows = packed.withColumn("_h", F.unhex(F.md5("_vector"))).distinct()
    wanted = cut((rows if queries is None else rows.where(queries)).select("vec_id", "_h"))
    among = Window.partitionBy("_h").orderBy("vec_id")
    kept = cut(rows.withColumn("_n", F.row_number().over(among)).where(F.col("_n") <= most))
    ids = kept.select("vec_id", "_h")
    points = cut(kept.groupBy("_h").agg(F.max(F.when(F.col("_n") == 1, F.col("_vector"))).alias("_vector"), F.xxhash64(F.min("vec_id")).alias("_own"), (F.count("*") == 1).alias("_single")))
    asked = cut(points.join(wanted.select("_h").distinct(), "_h").select("_h", "_vector"))
    count = points.count() if asked.head(1) else 0
    cells = min(MOST_CELLS, max(1, count // CELL_ROWS))
    middle = _centres(points, count, cells, dimensions) if count else np.zeros((1, dimensions), np.float32)
    cells = len(middle)
    centres = spark.sparkContext.broadcast(middle)  # at most MOST_CELLS rows

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, half = rotation(dimensions), 0.5 * (centres.value**2).sum(axis=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _floats(batch.column(3), dimensions)
            cell = (vectors @ centres.value.T - half).argmax(axis=1)
            bits, length, fit = codes(vectors - centres.value[cell], turn)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(cell.astype(np.int32)), binary_rows(bits), pa.array(length), pa.array(fit)],
                names=["_h", "_own", "_single", "_cell", "_packed", "_length", "_fit"],
            )

    index = cut(points.select("_h", "_own", "_single", "_vector").mapInArrow(code, "_h binary, _own long, _single boolean, _cell int, _packed binary, _length float, _fit float"))
    sizes = {r["_cell"]: r["count"] for r in index.groupBy("_cell").count().collect()}  # at most MOST_CELLS rows
    blocks = np.array([-(-sizes.get(c, 0) // BLOCK_ROWS) for c in range(cells)])
    probes = _probes(points, asked, centres, dimensions, most) if count else 1
    wide = F.xxhash64("_h")

    def visits(some: DataFrame, number: int) -> DataFrame:
        """A row for each cell that a query (_h, _vector, _floor) visits."""

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                product = _floats(batch.column(1), dimensions) @ centres.value.T
                cell = np.argsort(-product, axis=1, kind="stable")[:, :number].astype(np.int32)
                for at in range(0, len(cell), 256):
                    row = pa.array(np.repeat(np.arange(at, min(len(cell), at + 256)), number))
                    yield pa.RecordBatch.from_arrays([pa.array(cell[at : at + 256].ravel()), *(c.take(row) for c in batch.columns)], names=["_cell", "_h", "_vector", "_floor"])

        return some.select("_h", "_vector", F.col("_floor").cast("float").alias("_floor")).mapInArrow(kernel, "_cell int, _h binary, _vector binary, _floor float")

    def scanned(some: DataFrame, number: int, best: int | None) -> DataFrame:
        """``_q``, ``_h``, ``_own``, ``_about`` of queries in their nearest cells."""
        visiting = cut(visits(some, number))
        loads = {r["_cell"]: r["count"] for r in visiting.groupBy("_cell").count().collect()}  # at most MOST_CELLS rows
        tasks = np.array([-(-loads.get(c, 0) // TASK_QUERIES) for c in range(cells)])
        of = lambda values: F.get(F.lit(values.tolist()), F.col("_cell"))
        block = F.pmod(wide, F.greatest(of(blocks), F.lit(1))).cast("int")
        held = index.where(of(tasks) > 0).select("_cell", block.alias("_block"), F.explode(F.sequence(F.lit(0), of(tasks).cast("int") - 1)).alias("_task"), F.lit(False).alias("_query"), "_own", "_single", "_length", "_fit", "_h", "_packed")
        task = F.pmod(wide, of(tasks)).cast("int")
        queried = visiting.where(of(blocks) > 0).select("_cell", F.explode(F.sequence(F.lit(0), of(blocks).cast("int") - 1)).alias("_block"), task.alias("_task"), F.lit(True).alias("_query"), F.lit(0).cast("long").alias("_own"), F.lit(True).alias("_single"), F.col("_floor").alias("_length"), F.lit(0).cast("float").alias("_fit"), "_h", F.col("_vector").alias("_packed"))
        units = int((np.maximum(blocks, 1) * np.maximum(tasks, 1)).sum())
        order = ["_cell", "_block", "_task", "_query"]
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), units // 8)
        together = held.unionByName(queried).repartition(parts, *order[:3]).sortWithinPartitions(*order)
        return together.mapInArrow(_scan_kernel(dimensions, centres, best), "_q binary, _h binary, _own long, _about double")

    def exact(pairs: DataFrame) -> DataFrame:
        """The pairs' inner products; the only use of the vectors themselves."""

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    score = np.einsum("ij,ij->i", _floats(batch.column(3), dimensions), _floats(batch.column(4), dimensions))
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score.astype(np.float64))], names=["_q", "_h", "_own", "score"])

        fetched = pairs.select("_q", "_h", "_own").join(points.select("_h", "_vector"), "_h")
        both = fetched.join(asked.select(F.col("_h").alias("_q"), F.col("_vector").alias("_of")), "_q")
        return both.select("_q", "_h", "_own", "_vector", "_of").mapInArrow(kernel, "_q binary, _h binary, _own long, score double")

    def leading(scan: DataFrame) -> DataFrame:
        """The best of each query by estimate, an id once; their exact inner products."""
        each = scan.groupBy("_q", "_own").agg(F.max_by("_h", "_about").alias("_h"), F.max("_about").alias("_about"))
        by = Window.partitionBy("_q").orderBy(F.desc("_about"), "_own")
        return exact(each.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= FIRST * most))

    none = F.lit(float("-inf"))
    # of at most FIRST * most scores a query
    least = lambda found: found.groupBy("_q").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(most - 1)).alias("_floor"))
    floors = least(cut(leading(scanned(asked.withColumn("_floor", none), probes, FIRST * most))))
    known = cut(asked.join(floors, F.col("_h") == F.col("_q"), "left").select("_h", "_vector", "_floor"))
    enough, short = known.where("_floor IS NOT NULL"), known.where("_floor IS NULL")
    found = scanned(enough, probes, None)
    if cells > probes and short.head(1):  # too few ids in their cells: all cells
        again = least(cut(leading(scanned(short.withColumn("_floor", none), cells, FIRST * most))))
        short = short.drop("_floor").join(again, F.col("_h") == F.col("_q"), "left").select("_h", "_vector", "_floor")
    if short.head(1):
        found = found.unionByName(scanned(short.withColumn("_floor", F.coalesce("_floor", none)), cells, None))
    scored = exact(found).select("_q", F.col("_h").alias("_v"), "score")
    named = scored.join(ids.select(F.col("_h").alias("_v"), F.col("vec_id").alias("neighbour")), "_v")
    # of equal vectors among the queries each id gets its own rows
    named = named.groupBy("_q", "neighbour").agg(F.max("score").alias("score"))
    cut_off = Window.partitionBy("_q").orderBy(F.desc("score"), "neighbour")
    named = named.withColumn("_n", F.row_number().over(cut_off)).where(F.col("_n") <= most).drop("_n")
    mine = wanted.select("vec_id", F.col("_h").alias("_q")).join(named, "_q").where(F.col("vec_id") != F.col("neighbour"))
    mine = mine.groupBy("vec_id", "neighbour").agg(F.max("score").alias("score"))
    ranks = Window.partitionBy("vec_id").orderBy(F.col("score").desc(), "neighbour")
    ranked = mine.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
    return ranked.select("vec_id", "rank", "neighbour", "score")
