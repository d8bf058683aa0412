"""1. Quality rules from tokeniser fertility.

Every document is measured with two public vocabularies, a byte-level BPE and a
piece vocabulary with byte fallback: characters per token, the share of tokens
that are bare bytes, and the entropy of its tokens over the logarithm of their
number. A document whose measure lies outside the band of its language (of its
script, where the language is null) is rejected.

Texts are measured whole, white space included, by exactly the tokens that
encoding them gives. As no token of either vocabulary goes on at a single space
between other characters, texts are cut there and each distinct part is encoded
once a task.

Bands. For each key and measure the band is the median over *all* documents of
that key that have ``ENOUGH`` tokens, minus and plus the two ``WIDTH`` of the
measure in robust standard deviations (quartile distance / 1.349, at least
``LEAST``), widened for short texts by sqrt(1 + SHORT / tokens). So the bands
follow the corpus, at any size. A key with fewer than ``FEWEST`` such documents
has the band of all documents. Few characters a token count less in texts with
more bare bytes than usual, by ``FOREIGN`` deviations: letters of a second
language cost tokens as well, so there the lower width is ``FOREIGN_CHARS``.

Defined cases. Ids of any type. Null or empty texts: zero tokens, null measures,
kept (nothing speaks against them). Fewer than ``ENOUGH`` tokens: measured, never
rejected, as three words of any kind have no entropy to speak of. Null ids and
repeated rows: every row is measured by itself. Null language: the key is
``script:`` and the script of most letters. Empty table: no rows.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm import vocabularies
from loomspan.llm.common import batch_of, slices
from loomspan.session import cut, shipped

BYTE_VOCABULARY = "byte_bpe_50k"
PIECE_VOCABULARY = "piece_bpe_32k"
MEASURES = ("byte_chars", "byte_fallback", "byte_entropy", "piece_chars", "piece_fallback", "piece_entropy")
WIDTH = {"byte_chars": (3.5, 8.0), "byte_fallback": (9.0, 9.0), "byte_entropy": (2.6, 2.6), "piece_chars": (6.0, 6.0), "piece_fallback": (9.0, 9.0), "piece_entropy": (2.6, 2.6)}
FOREIGN = 1.0
FOREIGN_CHARS = 8.0
LEAST = {"byte_chars": 0.02, "byte_fallback": 0.01, "byte_entropy": 0.05, "piece_chars": 0.02, "piece_fallback": 0.01, "piece_entropy": 0.05}
SHORT = 320
ENOUGH = 8
FEWEST = 30
#: Bands that are broadcast.
MOST_KEYS = 10_000
_MOST_PARTS = 400_000
_MOST_CHARACTERS = 8 << 20
_SCHEMA = "band_key string, n_tokens long, " + ", ".join(f"{m} double" for m in MEASURES)


#: Before a space between characters that aren't spaces; the mark is the piece vocabulary's own space.
_CUT = re.compile("(?<=[^\\s\u2581]) (?=[^\\s\u2581])")
#: Goes before the first part of a text, which has no space before it; no text has it.
_FIRST = "\ud800"


def _parts(text: str, size: int = 1 << 20) -> Iterator[list[str]]:
    """A text's parts, without the spaces between them, some at a time."""
    at, first = 0, _FIRST
    while at <= len(text):
        found = _CUT.search(text, at + size) if at + size < len(text) else None
        stop = found.start() if found else len(text)
        parts = _CUT.split(text[at:stop])
        parts[0] = first + parts[0]
        yield parts
        at, first = stop + 1, ""


class _Measures:
    """Part of a text -> its tokens under both vocabularies, as flat arrays."""

    def __init__(self, folder: str):
        self.bpe = vocabularies.byte_bpe(BYTE_VOCABULARY, folder)
        self.pieces = vocabularies.pieces(PIECE_VOCABULARY, folder)
        bare = np.zeros(self.bpe.n_vocab, dtype=bool)
        for token, rank in vocabularies.ranks(BYTE_VOCABULARY, folder).items():
            try:
                token.decode()
            except UnicodeDecodeError:
                bare[rank] = True
        self.bare = (bare, np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())]))
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.tokens, self.offsets, self.held = (array("i"), array("i")), (array("q", [0]), array("q", [0])), 0

    def look_up(self, parts: list[str]) -> np.ndarray:
        get = self.index.get
        found = np.fromiter(map(get, parts, [-1] * len(parts)), dtype=np.int64, count=len(parts))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [parts[i] for i in missing]
            self._add(list(dict.fromkeys(new)))
            found[missing] = np.fromiter(map(self.index.__getitem__, new), dtype=np.int64, count=len(new))
        return found

    def _add(self, parts: list[str]) -> None:
        # the piece vocabulary puts a space before a text by itself
        made = (
            [self.bpe.encode_ordinary(p[1:] if p.startswith(_FIRST) else " " + p) for p in parts],
            self.pieces.encode([p.removeprefix(_FIRST) for p in parts], num_threads=1),
        )
        for which, lists in enumerate(made):
            sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
            self.offsets[which].frombytes((np.cumsum(sizes) + len(self.tokens[which])).tobytes())
            self.tokens[which].frombytes(np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(sizes.sum())).tobytes())
        self.held += sum(map(len, parts))
        for part in parts:
            self.index[part] = len(self.index)

    def gather(self, which: int, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts' tokens in order, and each part's number of them."""
        offsets, flat = self.offsets[which], self.tokens[which]
        offsets = np.frombuffer(offsets, dtype=np.int64)
        flat = np.frombuffer(flat, dtype=np.int32) if len(flat) else np.empty(0, np.int32)
        begin = offsets[parts]
        count = offsets[parts + 1] - begin
        total = int(count.sum())
        ends = np.cumsum(count)
        place = np.arange(total) - np.repeat(ends - count, count) + np.repeat(begin, count)
        return flat[place], count


def _entropy(documents: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Entropy of each document's tokens over log2 of their number."""
    keys = np.sort((documents.astype(np.int64) << 20) | tokens)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    runs = np.diff(first, append=len(keys)).astype(float)
    owner = keys[first] >> 20
    weight = np.bincount(owner, runs * np.log2(runs), minlength=len(sizes))
    size = np.maximum(sizes, 2).astype(float)
    return np.where(sizes < 2, 1.0, (np.log2(size) - weight / size) / np.log2(size))


def _script(text: str) -> str:
    found: dict[str, int] = {}
    names: dict[str, str] = {}
    for letter in text:
        if letter.isalpha():
            if letter not in names:
                names[letter] = unicodedata.name(letter, "OTHER").split(" ", 1)[0].lower()
            found[names[letter]] = found.get(names[letter], 0) + 1
    return min(found, key=lambda s: (-found[s], s)) if found else "none"


_TABLES: dict[str, _Measures] = {}


def measure_texts(texts: list[str | None], folder: str = vocabularies.FOLDER) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of the byte vocabulary, matrix of MEASURES) for a list of texts."""
    if folder not in _TABLES:
        _TABLES[folder] = _Measures(folder)
    made = _TABLES[folder]
    if len(made.index) > _MOST_PARTS or made.held > _MOST_CHARACTERS:
        made.reset()
    out = np.full((len(texts), len(MEASURES)), np.nan)
    tokens = np.zeros(len(texts), dtype=np.int64)
    characters = np.array([len(t or "") for t in texts], dtype=float)
    flat: list[str] = []
    sizes = np.zeros(len(texts), dtype=np.int64)
    found: list[np.ndarray] = []
    for i, text in enumerate(texts):
        for parts in _parts(text) if text else ():
            flat += parts
            sizes[i] += len(parts)
            if len(flat) > 400_000:
                found.append(made.look_up(flat))
                flat = []
    found.append(made.look_up(flat))
    every = np.concatenate(found)
    documents = np.repeat(np.arange(len(texts)), sizes)
    for which, bare in enumerate(made.bare):
        ids, count = made.gather(which, every)
        of = np.repeat(documents, count)
        number = np.bincount(of, minlength=len(texts))
        some = number > 0
        divisor = np.maximum(number, 1)
        values = (characters / divisor, np.bincount(of, bare[ids], minlength=len(texts)) / divisor, _entropy(of, ids, number))
        for k, value in enumerate(values):
            out[some, 3 * which + k] = value[some]
        if which == 0:
            tokens = number.astype(np.int64)
    return tokens, out


def measure(docs: DataFrame, folder: str = vocabularies.FOLDER) -> DataFrame:
    """``doc_id``, ``band_key``, ``n_tokens`` and the six measures of each row."""
    source = shipped(docs).select("doc_id", "text", F.lit(None).cast("string").alias("lang") if "lang" not in docs.columns else F.col("lang").cast("string"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column(1).to_pylist()
            tokens, values = measure_texts(texts, folder)
            keys = [lang if lang is not None else "script:" + _script(text or "") for lang, text in zip(batch.column(2).to_pylist(), texts)]
            columns = [batch.column(0), pa.array(keys, pa.string()), pa.array(tokens)]
            columns += [pa.array(values[:, k], mask=np.isnan(values[:, k])) for k in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "band_key", "n_tokens", *MEASURES])

    return source.mapInArrow(kernel, f"doc_id {kind}, {_SCHEMA}")


def bands(measured: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Centre and deviation of each measure for each key, over all its documents; those of few are all's."""
    enough = measured.where(F.col("n_tokens") >= ENOUGH)
    quartiles = [F.percentile_approx(m, [0.25, 0.5, 0.75], accuracy).alias(m) for m in MEASURES]
    everything = enough.agg(*quartiles).head()  # one row
    found = enough.groupBy("band_key").agg(F.count("*").alias("_docs"), *quartiles)
    out = [F.col("band_key").alias("_key")]
    for m in MEASURES:
        own = F.when(F.col("_docs") >= FEWEST, F.col(m)).otherwise(F.lit(everything[m]) if everything[m] else F.lit(None).cast("array<double>"))
        out.append(own[1].alias(f"_{m}_mid"))
        out.append(F.greatest((own[2] - own[0]) / 1.349, F.lit(LEAST[m])).alias(f"_{m}_dev"))
    return found.select(*out)


def _deviations(m: str) -> Column:
    return (F.col(m) - F.col(f"_{m}_mid")) / (F.col(f"_{m}_dev") * F.sqrt(1 + SHORT / F.col("n_tokens")))


def _outside(m: str) -> Column:
    lower, upper = WIDTH[m]
    least = F.lit(-lower)
    if m == "byte_chars":
        least = F.when(_deviations("byte_fallback") > FOREIGN, F.lit(-FOREIGN_CHARS)).otherwise(least)
    return F.when((_deviations(m) < least) | (_deviations(m) > upper), F.lit(m))


def judge(measured: DataFrame) -> DataFrame:
    """Measures with ``reasons`` (names of measures outside their band) and ``keep``."""
    measured = cut(measured)
    found = cut(bands(measured))
    # one row a language; where there should be many all the same, Spark chooses how to join
    found = F.broadcast(found) if found.count() <= MOST_KEYS else found
    joined = measured.join(found, F.col("band_key") == F.col("_key"), "left")
    reasons = F.filter(F.array(*[_outside(m) for m in MEASURES]), lambda x: x.isNotNull())
    reasons = F.when(F.col("n_tokens") >= ENOUGH, reasons).otherwise(F.array().cast("array<string>"))
    return joined.select("doc_id", "band_key", "n_tokens", *MEASURES, reasons.alias("reasons")).withColumn("keep", F.size("reasons") == 0)


def fertility_rules(docs: DataFrame, folder: str = vocabularies.FOLDER) -> DataFrame:
    return judge(measure(docs, folder))
