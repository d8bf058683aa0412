"""Vocabularies: trained by aggregation, held as tables, used as small maps.

Training is exact group-and-count over the corpus; ranks are by count, then by
code point or bytes. A vocabulary has at most 65,536 entries, so that encoders
take it along as a Python object.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions.lexical import LINE_BREAK, WHITESPACE, WORD
from loomspan.operators import programs, quality
from loomspan.operators.units import CODE, Config, Provider, few_collections, units_of
from loomspan.session import shipped

PAD, BOS, EOS = 0, 1, 2
UNIT, MORPH, CODE_START, CODE_END, CHAR_BYTES, CHAR_FIRST = 3, 4, 5, 6, 7, 263
SURFACE_BYTES, SURFACE_FIRST = 3, 259
LONGEST_PIECE, MOST_ENTRIES = 96, 65_536


@dataclass(frozen=True)
class CharVocabulary:
    """Characters in code point order, ids from 263; bytes from 7."""

    chars: tuple[str, ...]
    ids: dict[str, int] = field(init=False, compare=False)

    def __post_init__(self):
        if list(self.chars) != sorted(set(self.chars)):
            raise ValueError("characters must be distinct and in code point order")
        object.__setattr__(self, "ids", {c: CHAR_FIRST + k for k, c in enumerate(self.chars)})

    def __len__(self) -> int:
        return CHAR_FIRST + len(self.chars)


@dataclass(frozen=True)
class SurfaceVocabulary:
    """Byte pieces in rank order, ids from 259; bytes from 3."""

    pieces: tuple[bytes, ...]
    ids: dict[bytes, int] = field(init=False, compare=False)

    def __post_init__(self):
        if any(not 1 <= len(p) <= LONGEST_PIECE for p in self.pieces) or len(set(self.pieces)) != len(self.pieces):
            raise ValueError("pieces must be distinct and 1 to 96 bytes long")
        if SURFACE_FIRST + len(self.pieces) > MOST_ENTRIES:
            raise ValueError("too many pieces")
        object.__setattr__(self, "ids", {p: SURFACE_FIRST + k for k, p in enumerate(self.pieces)})
        sizes: dict[bytes, set[int]] = {}
        for piece in self.pieces:
            if len(piece) > 1:
                sizes.setdefault(piece[:2], set()).add(len(piece))
        object.__setattr__(self, "sizes", {begin: tuple(sorted(some, reverse=True)) for begin, some in sizes.items()})
        object.__setattr__(self, "table", [b""] * SURFACE_BYTES + [bytes((b,)) for b in range(256)] + list(self.pieces))

    def __len__(self) -> int:
        return SURFACE_FIRST + len(self.pieces)

    def greedy(self, data: bytes) -> tuple[list[int], list[int]]:
        """Ids and byte lengths of the longest matches, bytes where none matches."""
        ids, lengths, at, end = [], [], 0, len(data)
        get, sizes = self.ids.get, self.sizes.get
        while at < end:
            for size in sizes(data[at : at + 2], ()):  # of the pieces that begin so
                found = get(data[at : at + size])
                if found is not None:
                    size = min(size, end - at)
                    break
            else:
                found, size = get(data[at : at + 1], SURFACE_BYTES + data[at]), 1
            ids.append(found)
            lengths.append(size)
            at += size
        return ids, lengths

    def decode(self, ids) -> bytes:
        ids = list(ids)
        if ids and not 0 <= min(ids) <= max(ids) < len(self):
            raise ValueError("an id is outside the vocabulary")
        return b"".join(map(self.table.__getitem__, ids))


CONTROLS = tuple(
    "<pad> <bos> <eos> <unit_end> <word_end> <char> </char> <code> </code> <glue> <space> <spaces> </spaces> <tab> <lf> <crlf> <nbsp>".split()
)
G_UNIT_END, G_WORD_END, G_CHAR, G_CHAR_END, G_CODE, G_CODE_END, G_GLUE, G_SPACE, G_SPACES, G_SPACES_END, G_TAB, G_LF, G_CRLF, G_NBSP = range(3, 17)
G_CONTROL, G_BYTE, G_CHARACTER, G_NUMBER, G_MORPHEME, G_ROOT, G_PIECE = range(7)


def root_token(dictionary_id: str, surface: bytes) -> str:
    return f"<root:{dictionary_id.encode().hex()}:{surface.hex()}>"


def morpheme_token(morpheme_id: str, surface: bytes) -> str:
    return f"<morph:{morpheme_id.encode().hex()}:{surface.hex()}>"


def code_token(surface: bytes) -> str:
    return f"<codepiece:{surface.hex()}>"


def fixed_entries() -> list[tuple[int, str, bytes]]:
    """Controls and bytes, which every generation vocabulary begins with."""
    return [(G_CONTROL, c, b"") for c in CONTROLS] + [(G_BYTE, f"<byte:{b:02x}>", bytes((b,))) for b in range(256)]


def number_entries() -> list[tuple[int, str, bytes]]:
    """All strings of one, two and three digits."""
    made = [f"{v:0{w}}" for w in (1, 2, 3) for v in range(10**w)]
    return [(G_NUMBER, f"<num:{m}>", m.encode()) for m in made]


@dataclass(frozen=True)
class GenerationVocabulary:
    """(kind, token, surface) in id order."""

    entries: tuple[tuple[int, str, bytes], ...]

    def __post_init__(self):
        fixed = fixed_entries()
        if list(self.entries[: len(fixed)]) != fixed or len({e[1] for e in self.entries}) != len(self.entries):
            raise ValueError("a generation vocabulary begins with the fixed entries and has no repetition")
        if len(self.entries) > MOST_ENTRIES:
            raise ValueError("too many entries")
        object.__setattr__(self, "ids", {e[1]: k for k, e in enumerate(self.entries)})
        object.__setattr__(self, "chars", {e[2].decode(): k for k, e in enumerate(self.entries) if e[0] == G_CHARACTER})
        object.__setattr__(self, "numbers", {e[2].decode(): k for k, e in enumerate(self.entries) if e[0] == G_NUMBER})

    def __len__(self) -> int:
        return len(self.entries)


ROOT_CONTROLS = ("<pad>", "<bos>", "<eos>", "<word_end>", "<char>", "<code>", "<text>")


@dataclass(frozen=True)
class RootVocabulary:
    """The older generation vocabulary: controls, the numbers up to 999, morphemes, frequent roots."""

    entries: tuple[str, ...]

    def __post_init__(self):
        fixed = (*ROOT_CONTROLS, *(f"<num:{n}>" for n in range(1000)))
        if self.entries[: len(fixed)] != fixed:
            raise ValueError("a root vocabulary begins with its controls and numbers")
        if len(set(self.entries)) != len(self.entries):
            raise ValueError("entries must be distinct")

    def __len__(self) -> int:
        return len(self.entries)


def train_roots(units: DataFrame, most: int) -> RootVocabulary:
    """From units with analyses: all morphemes in order of their ids, and the most frequent dictionary items.

    The sizes of both are those of a lexicon, not of a corpus.
    """
    known = units.where("analysis IS NOT NULL").select("analysis.dictionary_id", "analysis.morphemes")
    counts = known.groupBy("dictionary_id").agg(F.count("*").alias("n"))
    roots = [r["dictionary_id"] for r in counts.orderBy(F.col("n").desc(), F.encode("dictionary_id", "UTF-8")).limit(most).collect()]
    found = known.select(F.explode("morphemes.id").alias("id")).distinct().limit(MOST_ENTRIES + 1).collect()
    if len(found) > MOST_ENTRIES:
        raise ValueError("more morphemes than a vocabulary has entries")
    morphemes = sorted((r["id"] for r in found), key=str.encode)
    return RootVocabulary((*ROOT_CONTROLS, *(f"<num:{n}>" for n in range(1000)), *(f"<m:{m}>" for m in morphemes), *(f"<r:{r}>" for r in roots)))


def char_counts(docs: DataFrame, column: str = "text") -> DataFrame:
    """``ch``, ``n``: how often each character occurs. Each task adds up its own first."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0x110000, np.int64)
        for batch in programs.batches_by_size(batches, 0):
            text = "".join(v for v in batch.column(0).to_pylist() if v)
            seen = np.bincount(np.frombuffer(text.encode("utf-32-le"), np.uint32))
            counts[: len(seen)] += seen
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in found.tolist()], pa.string()), pa.array(counts[found])], names=["ch", "n"])

    made = shipped(docs).select(F.col(column).cast("string")).mapInArrow(kernel, "ch string, n long")
    return made.groupBy("ch").agg(F.sum("n").alias("n"))


def ranked_chars(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent characters with their ids, in code point order.

    UTF-8 bytes sort as code points do, so that the binary form is the key.
    """
    key = F.encode("ch", "UTF-8")
    top = counts.orderBy(F.col("n").desc(), key).limit(most)
    return top.select((F.row_number().over(Window.orderBy(key)) + CHAR_FIRST - 1).cast("long").alias("id"), "ch", "n")


def train_chars(docs: DataFrame, most: int, column: str = "text") -> CharVocabulary:
    rows = ranked_chars(char_counts(docs, column), most).collect()  # at most ``most`` rows
    return CharVocabulary(tuple(sorted(r["ch"] for r in rows)))


def piece_weights(units: DataFrame, morphology: bool = True) -> DataFrame:
    """``piece``, ``weight`` of units with surfaces: whole units weigh 1, and with morphology their pieces 4."""
    part = lambda b, e: F.substring("surface", (b - F.col("start")).cast("int") + 1, (e - b).cast("int"))
    wholes = units.select(F.col("surface").alias("piece"), F.lit(1).cast("long").alias("w"))
    if morphology:
        edges = F.concat(F.array("start"), "cuts", F.array("end"))
        parts = F.transform(F.sequence(F.lit(0), F.size("cuts")), lambda i: part(F.get(edges, i), F.get(edges, i + 1)))
        wholes = wholes.unionByName(units.select(F.explode(parts).alias("piece"), F.lit(4).cast("long").alias("w")))
    return wholes.where((F.octet_length("piece") >= 1) & (F.octet_length("piece") <= LONGEST_PIECE)).groupBy("piece").agg(F.sum("w").alias("weight"))


def weigh(batches: Iterator[pa.RecordBatch], config: Config = Config(), provider: Provider | None = None, morphology: bool = True, kinds: frozenset[int] | None = None, choose=None) -> Iterator[pa.RecordBatch]:
    """Weights of the pieces of documents; a piece comes again after as many as a worker holds."""
    singly = choose is not None and config.contextual

    def add(counts: Counter, data: bytes, kind: int, start: int, end: int, cuts, times: int) -> None:
        if kinds is not None and kind not in kinds:
            return
        whole = data[start:end]
        if not morphology or not len(cuts):
            counts[whole] += (5 if morphology else 1) * times
            return
        counts[whole] += times
        edges = [start, *cuts, end]
        for b, e in zip(edges, edges[1:]):
            counts[data[b:e]] += 4 * times

    few_collections()
    known: dict = {}
    table = programs.Programs(config, provider)
    counts: Counter[bytes] = Counter()
    seen: Counter[str] = Counter()

    def settle() -> None:
        """Counts of surfaces as counts of pieces; a word that no fallback knows is its own."""
        weight, cut = 0 if kinds is not None and WORD not in kinds else 5 if morphology else 1, []
        for surface, times in seen.items():
            if not table.plain(surface):
                cut.append(surface)
            elif weight:
                piece = surface.encode("utf-8", "surrogateescape")
                counts[piece] = counts.get(piece, 0) + weight * times
        numbers = table.of([cut])
        for number, surface in zip(numbers.tolist(), cut):
            data, at = surface.encode("utf-8", "surrogateescape"), 0
            for u in range(table.first[number], table.first[number + 1]):
                cuts = [at + c for c in table.cuts[table.cut_first[u] : table.cut_first[u + 1]]]
                add(counts, data, table.kind[u], at, at + table.size[u], cuts, seen[surface])
                at += table.size[u]
        seen.clear()

    for batch in programs.batches_by_size(batches, 0):
        for data in batch.column(0).to_pylist():
            if data is None:
                continue
            tokens = None if singly else table.tokens(data)
            if tokens is not None:
                seen.update(tokens)
                continue
            for unit in units_of(data, config, provider, choose, programs.bounded(known)):
                add(counts, data, unit.kind, unit.start, unit.end, unit.cuts, 1)
        if len(seen) > programs.MOST_KNOWN:
            settle()
        if len(counts) > programs.MOST_SURFACES:
            yield _weights(counts)
            counts.clear()
    settle()
    yield _weights(counts)


def observed_weights(raw: DataFrame, config: Config = Config(), provider: Provider | None = None, morphology: bool = True, kinds: frozenset[int] | None = None, choose=None) -> DataFrame:
    """``piece_weights`` straight from documents: each batch adds up its own pieces first.

    ``kinds`` leaves only units of those lexical kinds. Distinct surfaces are
    counted and then cut, each once; documents with code regions, and all where
    ``choose`` picks analyses by context, are cut unit by unit.
    """
    kernel = lambda batches: weigh(batches, config, provider, morphology, kinds, choose)
    made = shipped(raw).select("raw").mapInArrow(kernel, "piece binary, weight long")
    return made.groupBy("piece").agg(F.sum("weight").alias("weight"))


def _weights(counts: Counter) -> pa.RecordBatch:
    kept = {p: w for p, w in counts.items() if 1 <= len(p) <= LONGEST_PIECE}
    return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], names=["piece", "weight"])


def train_surface(weights: DataFrame, size: int) -> SurfaceVocabulary:
    if not 260 <= size <= MOST_ENTRIES:
        raise ValueError("a surface vocabulary has 260 to 65,536 entries")
    rows = weights.orderBy(F.col("weight").desc(), "piece").limit(size - SURFACE_FIRST).collect()
    return SurfaceVocabulary(tuple(bytes(r["piece"]) for r in rows))


def _code_pieces(raw: bytes, units) -> list[bytes]:
    found = []
    for unit in units:
        if unit.mode == CODE and unit.kind not in (WHITESPACE, LINE_BREAK):
            edges = [unit.start, *unit.cuts, unit.end]
            found += [raw[b:e] for b, e in zip(edges, edges[1:])]
    return found


def morpheme_surfaces(raw: bytes, unit) -> list[tuple[str, bytes]]:
    """(id, bytes) of a unit's morphemes; apostrophes between them belong to none."""
    data = raw[unit.start : unit.end]
    out, at = [], 0
    for part in unit.analysis.morphemes:
        surface = part.surface.encode()
        place = data.find(surface, at) if surface else -1
        if place >= 0:
            out.append((part.id, surface))
            at = place + len(surface)
    return out


def family_tokens(raw: bytes, units) -> list[tuple[int, str, bytes]]:
    """The roots, morphemes and code pieces of one document, with repetitions."""
    out = [(G_PIECE, code_token(p), p) for p in _code_pieces(raw, units)]
    for unit in units:
        if unit.analysis is None or unit.analysis.synthetic:
            continue
        for k, (name, surface) in enumerate(morpheme_surfaces(raw, unit)):
            out.append((G_MORPHEME, morpheme_token(name, surface), surface) if k else (G_ROOT, root_token(unit.analysis.dictionary_id, surface), surface))
    return out


def assemble_generation(chars: list[str], morphemes: list[tuple[str, bytes]], roots: list[tuple[str, bytes]], codes: list[bytes]) -> GenerationVocabulary:
    entries = fixed_entries()
    entries += [(G_CHARACTER, f"<char:{ord(c):x}>", c.encode()) for c in sorted(chars)]
    entries += number_entries()
    entries += [(G_MORPHEME, t, s) for t, s in sorted(morphemes)]
    entries += [(G_ROOT, t, s) for t, s in roots]
    entries += [(G_PIECE, code_token(s), s) for s in codes]
    return GenerationVocabulary(tuple(entries))


def is_unknown(analysis: quality.Analysis | None) -> bool:
    return analysis is not None and analysis.unknown


def surface_table(spark: SparkSession, vocabulary: SurfaceVocabulary) -> DataFrame:
    """``id``, ``piece`` of the learned entries and the bytes; at most 65,536 rows."""
    rows = [(SURFACE_BYTES + b, bytes((b,))) for b in range(256)] + [(k, p) for p, k in vocabulary.ids.items()]
    return spark.createDataFrame(rows, "id int, piece binary")


def with_ids(pieces: DataFrame, vocabulary: SurfaceVocabulary) -> DataFrame:
    """The id of each row's ``piece``, null for one that is no entry; a learned entry goes before a byte."""
    table = surface_table(pieces.sparkSession, vocabulary).groupBy("piece").agg(F.max("id").alias("id"))
    return pieces.join(F.broadcast(table), "piece", "left")
