"""10. Quality classifier: a convolutional network over bytes, in numpy.

A document's bytes are covered by chunks of ``CHUNK`` bytes, each beginning
``STEP`` after the one before, the last padded with zeros. Bytes are embedded,
``FILTERS`` learned filters of ``WIDTH`` bytes run over each chunk, each
filter's greatest response is kept, a linear layer gives each chunk a logit,
and the mean of the chunks' logits gives the document's one probability of
being of good quality. Every byte of every document is seen.

The network is fitted on a bounded sample of labelled documents, those with the
least hash of their id: ``MOST_LABELLED`` of them and at most ``MOST_BYTES`` of
text (rows in order of their hash, without those that would go beyond it; equal
ones once). Numbers choose them, and only chosen texts come to the driver. Only these bounds and the labels matter; scoring runs over all
documents. Besides whole documents the fit sees short pieces of them
(``CROPPED`` of the steps have one more example each), as few labelled documents
are short, and both kinds of label weigh as they occur.

Defined cases. Null or empty text: null probability, kept. Null ids: scored,
never in the sample. Repeated rows: each scored. A document with several labels
is a sample for each. Labels that are null aren't used. With no labelled
document, or labels of one kind only, nothing can be learned: the probability
is null and all is kept. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import slices, text_bytes
from loomspan.session import shipped

CHUNK = 256
STEP = 192
WIDTH = 6
DEPTH = 4
FILTERS = 16
MOST_LABELLED = 1500
MOST_BYTES = 32 << 20
EPOCHS = 8
RATE = 0.01
BATCH = 32
CROPPED = 0.3
THRESHOLD = 0.5
_GROUP = 64


def chunk_matrix(data: np.ndarray) -> np.ndarray:
    """All chunks of a document as rows, padded with zeros."""
    number = max(1, -(-(len(data) - (CHUNK - STEP)) // STEP))
    padded = np.zeros((number - 1) * STEP + CHUNK, dtype=np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.as_strided(padded, (number, CHUNK), (STEP, 1))


class ByteNetwork:
    """Parameters, scoring and gradient steps."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        scale = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.values = {
            "embed": scale(256, DEPTH),
            "filters": scale(WIDTH * DEPTH, FILTERS),
            "bias": np.zeros(FILTERS, np.float32),
            "weights": scale(FILTERS),
            "offset": np.zeros(1, np.float32),
        }
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.values.items()}
        self.steps = 0

    def responses(self, chunks: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Greatest response of each filter in each chunk, and where it is."""
        best = np.empty((len(chunks), FILTERS), np.float32)
        where = np.empty((len(chunks), FILTERS), np.int64) if places else None
        span = CHUNK - WIDTH + 1
        for at in range(0, len(chunks), _GROUP):
            part = self.values["embed"][chunks[at : at + _GROUP]]
            view = np.lib.stride_tricks.as_strided(part, (len(part), span, WIDTH * DEPTH), (part.strides[0], part.strides[1], part.strides[2]))
            made = (view.reshape(-1, WIDTH * DEPTH) @ self.values["filters"]).reshape(len(part), span, FILTERS)
            best[at : at + _GROUP] = made.max(axis=1)
            if places:
                where[at : at + _GROUP] = made.argmax(axis=1)
        return best, where

    def logits(self, chunks: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Logits of documents whose chunks begin at the given rows."""
        best, _ = self.responses(chunks)
        each = np.maximum(best + self.values["bias"], 0) @ self.values["weights"] + self.values["offset"]
        return np.add.reduceat(each, begin) / np.diff(np.append(begin, len(chunks)))

    def step(self, documents: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> None:
        """One Adam step on the mean loss of some documents."""
        counts = np.array([len(d) for d in documents])
        chunks = np.concatenate(documents)
        owner = np.repeat(np.arange(len(documents)), counts)
        best, where = self.responses(chunks, places=True)
        lifted = best + self.values["bias"]
        pooled = np.maximum(lifted, 0)
        each = pooled @ self.values["weights"] + self.values["offset"]
        logit = np.bincount(owner, each) / counts
        slope = ((1 / (1 + np.exp(-logit)) - labels) * weight / len(documents) / counts)[owner].astype(np.float32)
        down = slope[:, None] * self.values["weights"] * (lifted > 0)
        places = where[:, :, None] + np.arange(WIDTH)
        seen = chunks[np.arange(len(chunks))[:, None, None], places]
        inner = self.values["embed"][seen]
        filters = self.values["filters"].reshape(WIDTH, DEPTH, FILTERS)
        embed = np.zeros_like(self.values["embed"])
        np.add.at(embed, seen, np.einsum("cf,wdf->cfwd", down, filters))
        gradients = {
            "embed": embed,
            "filters": np.einsum("cf,cfwd->wdf", down, inner).reshape(WIDTH * DEPTH, FILTERS),
            "bias": down.sum(axis=0),
            "weights": slope @ pooled,
            "offset": slope.sum(keepdims=True),
        }
        self.steps += 1
        for name, gradient in gradients.items():
            first, second = self.moments[name]
            first += 0.1 * (gradient - first)
            second += 0.001 * (gradient**2 - second)
            ahead = first / (1 - 0.9**self.steps)
            spread = np.sqrt(second / (1 - 0.999**self.steps)) + 1e-8
            self.values[name] -= (RATE * ahead / spread).astype(np.float32)


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> ByteNetwork | None:
    """A network for labelled texts; null if there is one kind of label only."""
    rows = [(np.frombuffer(t.encode(), np.uint8), y) for t, y in zip(texts, labels) if t]
    y = np.array([r[1] for r in rows], dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return None
    network, rng = ByteNetwork(seed), np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            short = batch[rng.random(len(batch)) < CROPPED]
            both = np.concatenate((batch, short))
            shown = [rows[i][0] for i in batch] + [_piece(rows[i][0], rng) for i in short]
            network.step([chunk_matrix(d) for d in shown], y[both], np.ones(len(both)))
    return network


def _piece(data: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A run of bytes of less than a chunk."""
    size = int(rng.integers(8, CHUNK))
    at = int(rng.integers(0, max(1, len(data) - size + 1)))
    return data[at : at + size]


def probabilities(network: ByteNetwork, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of the documents in a buffer; empty ones get no number."""
    some = np.flatnonzero(np.diff(offsets) > 0)
    out = np.full(len(offsets) - 1, np.nan)
    if len(some):
        chunks = [chunk_matrix(data[offsets[i] : offsets[i + 1]]) for i in some]
        begin = np.cumsum([0, *map(len, chunks)])[:-1]
        out[some] = 1 / (1 + np.exp(-network.logits(np.concatenate(chunks), begin)))
    return out


def fit_on(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, most_bytes: int = MOST_BYTES) -> ByteNetwork | None:
    """A network fitted on at most ``most`` labelled documents of ``most_bytes``, in the order of their ids' hashes."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label"))
    # few rows an id and many ids: the limit before the join keeps what is joined small, those after it bound what comes back
    known = known.withColumn("_order", F.xxhash64("_id")).orderBy("_order", "_id", "_label").limit(most)
    text = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text <> ''")
    joined = text.join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    joined = joined.select("_order", "_id", "_label", F.xxhash64("text").alias("_key"), F.octet_length("text").cast("long").alias("_size"))
    least = joined.distinct().orderBy("_order", "_id", "_label", "_key").limit(most).collect()  # numbers only
    chosen, total = [], 0
    for row in least:
        if total + row["_size"] <= most_bytes:
            chosen.append(row)
            total += row["_size"]
    if not chosen:
        return None
    wanted = docs.sparkSession.createDataFrame(chosen, joined.schema).select("_order", "_id", "_label", "_key")
    found = text.join(F.broadcast(wanted), (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_key")))
    sample = found.groupBy("_order", "_id", "_label", "_key").agg(F.first("text").alias("text")).collect()  # at most ``most_bytes``
    sample.sort(key=lambda r: (r["_order"], r["_label"], r["_key"]))
    return fit([r["text"] for r in sample], [r["_label"] for r in sample])


def score(docs: DataFrame, network: ByteNetwork | None) -> DataFrame:
    """``doc_id``, ``probability``, ``keep`` of every row."""
    source = shipped(docs).select("doc_id", F.col("text").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    if network is None:
        return source.select("doc_id", F.lit(None).cast("double").alias("probability"), F.lit(True).alias("keep"))
    held = docs.sparkSession.sparkContext.broadcast(network)  # some thousand parameters

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = probabilities(held.value, *text_bytes(batch.column(1)))
            blank = np.isnan(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, mask=blank), pa.array(blank | (found >= THRESHOLD))], names=["doc_id", "probability", "keep"])

    return source.mapInArrow(kernel, f"doc_id {kind}, probability double, keep boolean")


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    return score(docs, fit_on(docs, labels, most))
