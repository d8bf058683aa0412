"""Encoders and decoders: bytes, characters, surface pieces, model inputs, generation ids."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions.lexical import LINE_BREAK, NUMBER, PUNCTUATION, SYMBOL, WHITESPACE
from loomspan.operators import programs
from loomspan.operators import vocab as V
from loomspan.operators.scan import BATCH_BYTES, point_widths
from loomspan.operators.units import CODE, MORPHOLOGICAL, Config, Provider, Unit, few_collections, units_of
from loomspan.session import cut, shipped

Encoding = tuple[list[int], list[int]]


@dataclass(frozen=True)
class Boundaries:
    """Which marks a training encoding has."""

    units: bool = True
    morphemes: bool = True
    code: bool = True


def encode_bytes(raw: bytes, newline: bool = False) -> Encoding:
    body = [V.CHAR_BYTES + b for b in raw + b"\n" * newline]
    return [V.BOS, *body, V.EOS], [0, *[1] * len(body), 0]


def _characters(vocabulary: V.CharVocabulary, data: bytes) -> Iterator[tuple[int, int, int]]:
    """(offset, id, byte length) of a piece's characters, bytes for those not in the vocabulary."""
    at = 0
    for char in data.decode("utf-8", "surrogateescape"):
        if "\udc80" <= char <= "\udcff":
            yield at, V.CHAR_BYTES + ord(char) - 0xDC00, 1
            at += 1
            continue
        width = len(char.encode())
        found = vocabulary.ids.get(char)
        if found is not None:
            yield at, found, width
        else:
            for k in range(width):
                yield at + k, V.CHAR_BYTES + data[at + k], 1
        at += width


def encode_characters(vocabulary: V.CharVocabulary, raw: bytes, newline: bool = False) -> Encoding:
    made = [(i, n) for _, i, n in _characters(vocabulary, raw)]
    if newline:
        made.append((V.CHAR_BYTES + 10, 1))
    return [V.BOS, *(i for i, _ in made), V.EOS], [0, *(n for _, n in made), 0]


def spell_unit(vocabulary: V.CharVocabulary, data: bytes, cuts: list[int], marks: Boundaries = Boundaries()) -> Encoding:
    """A unit's characters with the marks of itself and its cuts."""
    ids, lengths = ([V.UNIT], [0]) if marks.units else ([], [])
    if data.isascii() and not cuts:
        known = list(map(vocabulary.ids.get, data.decode()))
        if None not in known:
            return ids + known, lengths + [1] * len(data)
    inside = frozenset(cuts) if marks.morphemes else ()
    for at, number, size in _characters(vocabulary, data):
        if at in inside:
            ids.append(V.MORPH)
            lengths.append(0)
        ids.append(number)
        lengths.append(size)
    return ids, lengths


def encode_units(vocabulary: V.CharVocabulary, raw: bytes, units: list[Unit], newline: bool = False, marks: Boundaries = Boundaries()) -> Encoding:
    """Characters with marks where units, morphemes and code regions begin or end."""
    ids, lengths, inside = [V.BOS], [0], False
    mark = lambda i: (ids.append(i), lengths.append(0))
    for unit in units:
        if marks.code and (unit.mode == CODE) != inside:
            inside = not inside
            mark(V.CODE_START if inside else V.CODE_END)
        found = spell_unit(vocabulary, raw[unit.start : unit.end], [c - unit.start for c in unit.cuts], marks)
        ids += found[0]
        lengths += found[1]
    if inside:
        mark(V.CODE_END)
    if newline:
        ids.append(V.CHAR_BYTES + 10)
        lengths.append(1)
    mark(V.EOS)
    if sum(lengths) != len(raw) + newline:
        raise ValueError("an encoding's byte lengths don't add up to its document")
    return ids, lengths


def encode_surface(vocabulary: V.SurfaceVocabulary, raw: bytes, units: list[Unit], newline: bool = False, morphology: bool = True, known: dict | None = None) -> Encoding:
    """Longest matches inside each piece, or each unit without morphology."""
    ids, lengths = [V.BOS], [0]
    known = {} if known is None else known
    for unit in units:
        edges = [unit.start, *unit.cuts, unit.end] if morphology else [unit.start, unit.end]
        for begin, end in zip(edges, edges[1:]):
            piece = raw[begin:end]
            found = known.get(piece)
            if found is None:
                found = vocabulary.greedy(piece)
                if len(known) < programs.MOST_KNOWN:
                    known[piece] = found
            ids += found[0]
            lengths += found[1]
    if newline:
        ids.append(V.SURFACE_BYTES + 10)
        lengths.append(1)
    ids.append(V.EOS)
    lengths.append(0)
    if sum(lengths) != len(raw) + newline:
        raise ValueError("an encoding's byte lengths don't add up to its document")
    return ids, lengths


def encode_input(vocabulary: V.CharVocabulary, raw: bytes, units: list[Unit]) -> dict:
    """Model input: runs of one group as segments; those with content are pooled."""
    ids: list[int] = []
    offsets, pooled, spans, modes, groups = [0], [], [], [], []
    at = 0
    while at < len(units):
        end = at + 1
        if units[at].group is not None:
            while end < len(units) and units[end].group == units[at].group:
                end += 1
        run = units[at:end]
        coded = run[0].mode == CODE
        if coded:
            ids.append(V.CODE_START)
        for unit in run:
            ids.append(V.UNIT)
            cuts = {c - unit.start for c in unit.cuts}
            for place, number, _ in _characters(vocabulary, raw[unit.start : unit.end]):
                if place in cuts:
                    ids.append(V.MORPH)
                ids.append(number)
        if coded:
            ids.append(V.CODE_END)
        offsets.append(len(ids))
        if any(u.kind not in (WHITESPACE, LINE_BREAK) for u in run):
            pooled.append(len(offsets) - 2)
            spans.append((run[0].start, run[-1].end))
            modes.append(("turkish", "code", "opaque")[run[0].mode - 1])
            groups.append(run[0].group)
        at = end
    return {"ids": ids, "segment_offsets": offsets, "pooled_segments": pooled, "pool_spans": spans, "pool_modes": modes, "pool_group_ids": groups}


def digit_atoms(digits: str) -> list[str]:
    """Groups of three from the right; the first has what is left over."""
    first = len(digits) % 3 or 3
    return [digits[:first], *(digits[k : k + 3] for k in range(first, len(digits), 3))] if digits else []


def digit_atoms_column(digits: Column) -> Column:
    return F.split(F.regexp_replace(digits, r"(?<=[0-9])(?=(?:[0-9]{3})+$)", " "), " ")


class _Generator:
    """Writes one document's generation ids."""

    def __init__(self, vocabulary: V.GenerationVocabulary):
        self.v, self.ids = vocabulary, []

    def atoms(self, data: bytes) -> None:
        for char in data.decode("utf-8", "surrogateescape"):
            found = self.v.chars.get(char)
            if found is not None:
                self.ids.append(found)
            else:
                self.ids += [len(V.CONTROLS) + b for b in char.encode("utf-8", "surrogateescape")]

    def escape(self, data: bytes) -> None:
        self.ids.append(V.G_CHAR)
        self.atoms(data)
        self.ids.append(V.G_CHAR_END)

    def digits(self, text: str) -> None:
        self.ids += [self.v.numbers[a] for a in digit_atoms(text)]

    def token_or_escape(self, token: str, data: bytes) -> None:
        found = self.v.ids.get(token)
        if found is None:
            self.escape(data)
        else:
            self.ids.append(found)

    def gap(self, data: bytes, after: bool = False) -> None:
        """White space by name; ``after`` a unit other characters need glue first."""
        signs = {b"\r\n": V.G_CRLF, b"\n": V.G_LF, b"\t": V.G_TAB, "\xa0".encode(): V.G_NBSP}
        at = 0
        while at < len(data):
            if data[at] == 32:
                size = len(data) - at - len(data[at:].lstrip(b" "))
                if size == 1:
                    self.ids.append(V.G_SPACE)
                else:
                    self.ids.append(V.G_SPACES)
                    self.digits(str(size))
                    self.ids.append(V.G_SPACES_END)
                at += size
                continue
            sign = next((s for s in signs if data.startswith(s, at)), None)
            if sign:
                self.ids.append(signs[sign])
                at += len(sign)
                continue
            if after and at == 0:
                self.ids.append(V.G_GLUE)
            char = data[at : at + 4].decode("utf-8", "surrogateescape")[0].encode("utf-8", "surrogateescape")
            self.atoms(char)
            at += len(char)

    def unit(self, raw: bytes, unit: Unit) -> None:
        data = raw[unit.start : unit.end]
        if unit.mode == CODE:
            edges = [unit.start, *unit.cuts, unit.end]
            for begin, end in zip(edges, edges[1:]):
                self.token_or_escape(V.code_token(raw[begin:end]), raw[begin:end])
        elif unit.status == MORPHOLOGICAL and unit.analysis and not unit.analysis.synthetic:
            at = 0
            parts = V.morpheme_surfaces(raw, unit)
            for k, (name, surface) in enumerate(parts):
                place = data.index(surface, at)
                self.atoms(data[at:place])
                if k == 0 and surface.isdigit():
                    self.digits(surface.decode())
                else:
                    self.token_or_escape(V.morpheme_token(name, surface) if k else V.root_token(unit.analysis.dictionary_id, surface), surface)
                at = place + len(surface)
            if parts:
                self.atoms(data[at:])
            else:
                self.escape(data)
        elif unit.kind == NUMBER and data.isdigit():
            self.digits(data.decode())
        elif unit.kind in (PUNCTUATION, SYMBOL):
            self.atoms(data)
        else:
            self.escape(data)


def encode_generation(vocabulary: V.GenerationVocabulary, raw: bytes, units: list[Unit]) -> list[int]:
    """Ids that spell a document as roots, morphemes, numbers and gaps; checked to decode exactly."""
    made, inside, last = _Generator(vocabulary), False, None
    made.ids.append(V.BOS)
    content = [u for u in units if u.kind not in (WHITESPACE, LINE_BREAK)]
    made.gap(raw[: content[0].start] if content else raw)
    for k, unit in enumerate(content):
        if (unit.mode == CODE) != inside:
            inside = not inside
            made.ids.append(V.G_CODE if inside else V.G_CODE_END)
        made.unit(raw, unit)
        made.ids.append(V.G_UNIT_END)
        last = content[k + 1] if k + 1 < len(content) else None
        if last is None or unit.group is None or unit.group != last.group:
            made.ids.append(V.G_WORD_END)
        gap = raw[unit.end : last.start if last else len(raw)]
        if last is None:
            made.gap(gap, True)
        elif not gap:
            made.ids.append(V.G_GLUE)
        elif gap != b" ":
            made.gap(gap, True)
    if inside:
        made.ids.append(V.G_CODE_END)
    made.ids.append(V.EOS)
    if decode_generation(vocabulary, made.ids) != raw:
        raise ValueError("a generation encoding doesn't decode to its document")
    return made.ids


def decode_generation(vocabulary: V.GenerationVocabulary, ids) -> bytes:
    out: list[bytes] = []
    pending, digits = False, None
    plain = {V.G_SPACE: b" ", V.G_TAB: b"\t", V.G_LF: b"\n", V.G_CRLF: b"\r\n", V.G_NBSP: "\xa0".encode()}
    for number in ids:
        if not 0 <= number < len(vocabulary):
            raise ValueError(f"id {number} is outside the vocabulary")
        kind, _, surface = vocabulary.entries[number]
        if digits is not None:
            if number == V.G_SPACES_END:
                if not digits:
                    raise ValueError("a run of spaces without a number")
                out.append(b" " * int(digits))
                digits = None
            elif kind == V.G_NUMBER:
                digits += surface.decode()
            else:
                raise ValueError("a run of spaces holds number atoms only")
        elif number == V.G_UNIT_END:
            pending = True
        elif number == V.G_GLUE:
            pending = False
        elif number in plain:
            pending = False
            out.append(plain[number])
        elif number == V.G_SPACES:
            pending, digits = False, ""
        elif number == V.G_SPACES_END:
            raise ValueError("the end of a run of spaces without its start")
        elif kind != V.G_CONTROL:
            out.append(b" " + surface if pending else surface)
            pending = False
    if digits is not None:
        raise ValueError("a run of spaces isn't ended")
    return b"".join(out)


def _encoded(raw: DataFrame, make) -> DataFrame:
    """``doc_id``, ``ids``, ``lengths`` by a function of a document's bytes."""
    kind = raw.schema["doc_id"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few_collections()
        run = make()
        for batch in programs.batches_by_size(batches, 1):
            made = [(None, None) if v is None else run(v) for v in batch.column(1).to_pylist()]
            columns = [pa.array([m[k] for m in made], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "ids", "lengths"])

    return shipped(raw).select("doc_id", "raw").mapInArrow(kernel, f"doc_id {kind}, ids array<int>, lengths array<int>")


def _encoded_together(raw: DataFrame, make: Callable[[], Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]], newline: bool) -> DataFrame:
    """``doc_id``, ``ids``, ``lengths`` by a function that gives those of several documents, one after another, and their numbers of ids."""
    kind = raw.schema["doc_id"].dataType.simpleString()
    kernel = lambda batches: encoded_batches(batches, make(), newline)
    return shipped(raw).select("doc_id", "raw").mapInArrow(kernel, f"doc_id {kind}, ids array<int>, lengths array<int>")


def encoded_batches(batches: Iterator[pa.RecordBatch], run: Callable, newline: bool = False) -> Iterator[pa.RecordBatch]:
    """Encodings of bounded runs of rows, in numpy."""
    for batch in programs.batches_by_size(batches, 1):
        values = batch.column(1).to_pylist()
        there = [k for k, v in enumerate(values) if v is not None]
        parts = [([k], [pa.array([None], pa.list_(pa.int32()))] * 2) for k, v in enumerate(values) if v is None]
        if there:
            ids, lengths, counts = run([values[k] for k in there])
            parts.append((there, list(_framed(ids, lengths, np.concatenate(([0], np.cumsum(counts))), V.CHAR_BYTES + 10 if newline else None))))
        yield pa.RecordBatch.from_arrays([batch.column(0), *programs.in_order(parts)], names=["doc_id", "ids", "lengths"])


def many_bytes(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bodies of ``encode_bytes``."""
    data = np.frombuffer(b"".join(values), np.uint8)
    return data.astype(np.int32) + V.CHAR_BYTES, np.ones(len(data), np.int32), np.array([len(v) for v in values])


def _counted_together(raw: DataFrame, make: Callable[[], Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]], newline: bool) -> DataFrame:
    """``doc_id``, ``n_ids``, ``n_bytes`` of the same encodings, counted where they are made: eight bytes of lists for each id don't leave the kernel."""
    kind = raw.schema["doc_id"].dataType.simpleString()
    kernel = lambda batches: counted_batches(batches, make(), newline)
    return shipped(raw).select("doc_id", "raw").mapInArrow(kernel, f"doc_id {kind}, n_ids long, n_bytes long")


def counted_batches(batches: Iterator[pa.RecordBatch], run: Callable, newline: bool = False) -> Iterator[pa.RecordBatch]:
    """``doc_id``, ``n_ids``, ``n_bytes`` of encodings, without their lists; a long document is encoded in slices."""
    for batch in programs.batches_by_size(batches, 1):
        values = [v.as_buffer() for v in batch.column(1)]
        there = [k for k, v in enumerate(values) if v is not None]
        counts: list[tuple[int | None, int | None]] = [(None, None)] * len(values)
        parts = [p for k in there for p in _slices(values[k], k)]
        for some in [parts] if len(there) > 1 else [[p] for p in parts]:
            _, lengths, made = run([p for _, p in some])
            ends = np.concatenate(([0], np.cumsum(made)))
            sizes = np.diff(np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))[ends])
            for (k, _), n, size in zip(some, made.tolist(), sizes.tolist()):
                before = counts[k] if counts[k][0] is not None else (2 + newline, int(newline))
                counts[k] = before[0] + n, before[1] + size
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1))], names=["doc_id", "n_ids", "n_bytes"])


def _slices(value: pa.Buffer, of: int) -> Iterator[tuple[int, bytes]]:
    """Parts of at most ``BATCH_BYTES`` bytes that cut no character, at least one, each with the number of its document."""
    view, at = memoryview(value), 0
    while at < len(view) or not at:
        end = min(at + BATCH_BYTES, len(view))
        if end < len(view):
            end -= next((k for k in range(4) if view[end - k] & 0xC0 != 0x80), 0)
        yield of, bytes(view[at:end])
        if end == len(view):
            return
        at = end


def many_characters(vocabulary: V.CharVocabulary) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The bodies of ``encode_characters``."""
    table = np.full(0x110000, -1, np.int32)
    for char, number in vocabulary.ids.items():
        table[ord(char)] = number
    table[0xD800:0xE000] = -1

    def run(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        texts = [v.decode("utf-8", "surrogateescape") for v in values]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        width = point_widths(points)
        found = table[points]
        spelled = found < 0  # in bytes
        many = np.where(spelled, width, 1)
        ids, lengths = np.repeat(found, many), np.repeat(np.where(spelled, 1, width), many).astype(np.int32)
        data = np.frombuffer(b"".join(values), np.uint8)
        ids[np.repeat(spelled, many)] = data[np.repeat(spelled, width)].astype(np.int32) + V.CHAR_BYTES
        total = np.concatenate(([0], np.cumsum(many)))
        return ids, lengths, np.diff(total[np.concatenate(([0], np.cumsum([len(t) for t in texts])))])

    return run


def byte_encoding(raw: DataFrame, newline: bool = False) -> DataFrame:
    return _encoded_together(raw, lambda: many_bytes, newline)


def byte_counts(raw: DataFrame, newline: bool = False) -> DataFrame:
    return _counted_together(raw, lambda: many_bytes, newline)


def character_counts(raw: DataFrame, vocabulary: V.CharVocabulary, newline: bool = False) -> DataFrame:
    return _counted_together(raw, lambda: many_characters(vocabulary), newline)


def character_encoding(raw: DataFrame, vocabulary: V.CharVocabulary, newline: bool = False) -> DataFrame:
    return _encoded_together(raw, lambda: many_characters(vocabulary), newline)


def training_encoding(raw: DataFrame, vocabulary: V.CharVocabulary, config: Config = Config(), newline: bool = False, marks: Boundaries = Boundaries(), provider: Provider | None = None, choose=None) -> DataFrame:
    """``doc_id``, ``ids``, ``lengths``: characters with marks; distinct surfaces are spelled once, as in ``surface_encoding``."""
    spell = lambda data, cuts: spell_unit(vocabulary, data, cuts, marks)
    by_one = lambda: lambda data, units: encode_units(vocabulary, data, units, newline, marks)
    return _by_surfaces(raw, config, provider, choose, spell, by_one, V.CHAR_BYTES + 10 if newline else None)


def _framed(ids: np.ndarray, lengths: np.ndarray, ends: np.ndarray, newline: int | None) -> tuple[pa.Array, pa.Array]:
    """Both lists of documents that lie between ``ends``, with what stands for their begin and their end."""
    last = ([] if newline is None else [(newline, 1)]) + [(V.EOS, 0)]
    tail = len(last)
    offsets = ends + np.arange(len(ends)) * (1 + tail)
    inside = np.ones(int(offsets[-1]), bool)
    inside[offsets[:-1]] = False
    for k in range(tail):
        inside[offsets[1:] - tail + k] = False
    out = []
    for flat, which in ((ids, 0), (lengths, 1)):
        values = np.empty(len(inside), np.int32)
        values[offsets[:-1]] = (V.BOS, 0)[which]
        for k, pair in enumerate(last):
            values[offsets[1:] - tail + k] = pair[which]
        values[inside] = flat
        out.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values)))
    return out[0], out[1]


class _Surfaces:
    """Ids and byte lengths of each distinct surface, as flat arrays; ``spell`` gives those of a unit with its cuts."""

    def __init__(self, table: programs.Programs, spell: Callable[[bytes, list[int]], Encoding]):
        self.table, self.spell = table, spell
        self._reset()

    def _reset(self) -> None:
        self.held, self.first, self.ids, self.lengths = self.table.surfaces, array("q", [0]), array("i"), array("i")

    def encoded(self, numbers: np.ndarray, counts: np.ndarray, newline: int | None) -> tuple[pa.Array, pa.Array]:
        """Both lists of documents with so many surfaces each."""
        table = self.table
        if self.held is not table.surfaces:  # they start again when there are too many
            self._reset()
        begins, cut_first, ids, lengths, many = table.first, table.cut_first, [], [], len(self.ids)
        for number in range(len(self.first) - 1, len(table.surfaces)):
            data, begin, end = table.surfaces[number].encode("utf-8", "surrogateescape"), begins[number], begins[number + 1]
            if end == begin + 1 and cut_first[begin] == cut_first[end]:
                made = self.spell(data, [])
                ids += made[0]
                lengths += made[1]
            else:
                at = 0
                for u in range(begin, end):
                    made = self.spell(data[at : at + table.size[u]], list(table.cuts[cut_first[u] : cut_first[u + 1]]))
                    ids += made[0]
                    lengths += made[1]
                    at += table.size[u]
            self.first.append(many + len(ids))
        self.ids.extend(ids)
        self.lengths.extend(lengths)
        first = np.frombuffer(self.first, np.int64)
        place, many = programs._ranges(first[numbers], first[numbers + 1] - first[numbers])
        ends = np.concatenate(([0], np.cumsum(many)))[np.concatenate(([0], np.cumsum(counts)))]
        ids, lengths = ((np.frombuffer(flat, np.int32) if len(flat) else np.empty(0, np.int32))[place] for flat in (self.ids, self.lengths))
        return _framed(ids, lengths, ends, newline)


def _by_surfaces(raw: DataFrame, config: Config, provider: Provider | None, choose, spell: Callable[[bytes, list[int]], Encoding], by_one: Callable, newline: int | None) -> DataFrame:
    """Encodings put together from those of distinct surfaces.

    Documents with code regions, and all where ``choose`` picks analyses by
    context, go unit by unit through what ``by_one`` makes.
    """
    kind = raw.schema["doc_id"].dataType.simpleString()
    singly = choose is not None and config.contextual

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few_collections()
        analysed: dict = {}
        table = programs.Programs(config, provider)
        held, single = _Surfaces(table, spell), by_one()
        for batch in programs.batches_by_size(batches, 1):
            values = batch.column(1).to_pylist()
            tokens = [None if v is None or singly else table.tokens(v) for v in values]
            fast = [k for k, t in enumerate(tokens) if t is not None]
            slow = [k for k, t in enumerate(tokens) if t is None]
            parts = []
            if fast:
                some = [tokens[k] for k in fast]
                made = held.encoded(table.of(some), np.array([len(t) for t in some]), newline)
                total = pc.sum(made[1].flatten()).as_py()
                if total != sum(len(values[k]) + (newline is not None) for k in fast):
                    raise ValueError("an encoding's byte lengths don't add up to its documents")
                parts.append((fast, list(made)))
            if slow:
                programs.bounded(analysed)
                rows = [(None, None) if values[k] is None else single(values[k], units_of(values[k], config, provider, choose, analysed)) for k in slow]
                parts.append((slow, [pa.array(list(c), pa.list_(pa.int32())) for c in zip(*rows)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *programs.in_order(parts)], names=["doc_id", "ids", "lengths"])

    return shipped(raw).select("doc_id", "raw").mapInArrow(kernel, f"doc_id {kind}, ids array<int>, lengths array<int>")


def surface_encoding(raw: DataFrame, vocabulary: V.SurfaceVocabulary, config: Config = Config(), newline: bool = False, morphology: bool = True, provider: Provider | None = None, choose=None) -> DataFrame:
    """``doc_id``, ``ids``, ``lengths``: longest matches inside each piece.

    Distinct surfaces are encoded once; documents with code regions, and all where
    ``choose`` picks analyses by context, unit by unit.
    """

    def spell(data: bytes, cuts: list[int]) -> Encoding:
        if not morphology or not cuts:
            return vocabulary.greedy(data)
        edges = [0, *cuts, len(data)]
        made = [vocabulary.greedy(data[b:e]) for b, e in zip(edges, edges[1:])]
        return [i for ids, _ in made for i in ids], [n for _, lengths in made for n in lengths]

    def by_one():
        known: dict = {}
        return lambda data, units: encode_surface(vocabulary, data, units, newline, morphology, known)

    return _by_surfaces(raw, config, provider, choose, spell, by_one, V.SURFACE_BYTES + 10 if newline else None)


def content_ids(ids: Column) -> Column:
    """Ids without the first and the last, which stand for the document's ends."""
    return F.slice(ids, 2, F.greatest(F.size(ids) - 2, F.lit(0)))


def surface_decoding(encoded: DataFrame, vocabulary: V.SurfaceVocabulary) -> DataFrame:
    """``doc_id``, ``raw`` of rows with ``doc_id``, ``ids``."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in programs.batches_by_size(batches, 1):
            out = [vocabulary.decode(v.values.to_numpy().tolist()) if v.is_valid else None for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "raw"])

    return shipped(encoded).select("doc_id", "ids").mapInArrow(kernel, f"doc_id {kind}, raw binary")


def unaccounted(encoded: DataFrame, raw: DataFrame, newline: bool = False) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_accounted`` of encodings whose byte lengths don't add up to their documents."""
    made = encoded.select("doc_id", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_accounted"))
    sizes = raw.select("doc_id", (F.octet_length("raw") + int(newline)).cast("long").alias("n_bytes"))
    return sizes.join(made, "doc_id", "left").where(~F.col("n_bytes").eqNullSafe(F.col("n_accounted")))


def document_offsets(sizes: DataFrame, key: str = "doc_id", size: str = "n_ids", parts: int | None = None) -> DataFrame:
    """Where each document begins in the concatenation of all, in key order.

    Totals of key ranges are summed first, so that no task sees the whole table.
    """
    ranged = sizes.select(F.col(key), F.col(size).cast("long").alias("_n"))
    ranged = ranged.repartitionByRange(parts, key) if parts else ranged.repartitionByRange(key)
    placed = cut(ranged.withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(F.sum("_n").alias("_t")).select("_part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(totals, "_part").select(key, (F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("offset"), F.col("_n").alias(size))
