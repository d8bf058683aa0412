"""Binary forms of documents, lattices, sidecars and vocabularies.

A blob is eight bytes of magic, a version, the SHA-256 of what follows, and
that: numbers as variable-length integers, byte strings with their length
before them. Readers check the sum, every bound and every invariant, and raise
``CodecError`` for anything that their writer wouldn't write. Blobs are BINARY
columns; ``column_writer`` and ``column_reader`` run a codec over one.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomspan.functions.lexical import CONTROL, OPAQUE
from loomspan.operators import vocab as V
from loomspan.operators.lattice import Choice
from loomspan.operators.morphology import TABLES, Bundle
from loomspan.operators.quality import Analysis, Morpheme
from loomspan.operators.units import BYTES, CODE, CODED, MORPHOLOGICAL, OPAQUE_STATUS, STRUCTURAL, TURKISH, UNKNOWN, Unit
from loomspan.session import shipped

VERSION = 1
DOCUMENT, TOKENIZED, LATTICE, SIDECAR = b"LSPANDOC", b"LSPANTOK", b"LSPANLAT", b"LSPANSID"
CHARS, SURFACES, GENERATION = b"LSPANCHR", b"LSPANSRF", b"LSPANGEN"
ROOTS, BUNDLE = b"LSPANRTS", b"LSPANBDL"
_STATUSES = {TURKISH: {STRUCTURAL, MORPHOLOGICAL, UNKNOWN}, CODE: {CODED}, BYTES: {OPAQUE_STATUS}}


class CodecError(ValueError):
    """A blob that isn't what it says it is."""


def varint(value: int) -> bytes:
    if value < 0:
        raise CodecError("negative number")
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _text(data: bytes) -> bytes:
    return varint(len(data)) + data


class Reader:
    """Bounds-checked reading; numbers have to be in their shortest form."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, size: int) -> bytes:
        if size < 0 or self.at + size > len(self.data):
            raise CodecError("truncated")
        self.at += size
        return self.data[self.at - size : self.at]

    def number(self) -> int:
        value = shift = 0
        while True:
            (byte,) = self.take(1)
            value |= (byte & 127) << shift
            if byte < 128:
                if byte == 0 and shift:
                    raise CodecError("number isn't in its shortest form")
                return value
            shift += 7
            if shift > 63:
                raise CodecError("number is too large")

    def text(self) -> bytes:
        return self.take(self.number())

    def string(self) -> str:
        try:
            return self.text().decode()
        except UnicodeDecodeError as error:
            raise CodecError("text isn't UTF-8") from error

    def count(self, least: int = 1) -> int:
        """A number of items that take ``least`` bytes each at least."""
        value = self.number()
        if value * least > len(self.data) - self.at:
            raise CodecError("impossible count")
        return value

    def end(self) -> None:
        if self.at != len(self.data):
            raise CodecError("bytes after the end")


def seal(magic: bytes, payload: bytes) -> bytes:
    return magic + bytes((VERSION,)) + hashlib.sha256(payload).digest() + payload


def unseal(magic: bytes, blob: bytes) -> Reader:
    if blob[:8] != magic:
        raise CodecError("wrong magic")
    if len(blob) < 41:
        raise CodecError("truncated")
    if blob[8] != VERSION:
        raise CodecError("unknown version")
    if hashlib.sha256(blob[41:]).digest() != blob[9:41]:
        raise CodecError("checksum differs")
    return Reader(blob[41:])


def _cuts(start: int, cuts: list[int]) -> bytes:
    return varint(len(cuts)) + b"".join(varint(c - start) for c in cuts)


def _read_cuts(reader: Reader, start: int, end: int) -> list[int]:
    cuts = [start + reader.number() for _ in range(reader.count())]
    if any(not start < c < end for c in cuts) or any(a >= b for a, b in zip(cuts, cuts[1:])):
        raise CodecError("cuts aren't increasing inside their unit")
    return cuts


def write_document(raw: bytes, units: list[tuple[int, int, list[int]]]) -> bytes:
    """A document with (start, end, cuts) of ordered units; gaps are allowed."""
    at = 0
    for start, end, cuts in units:
        if start < at or start >= end or end > len(raw):
            raise CodecError("units overlap, are empty or leave the document")
        if any(not start < c < end for c in cuts) or any(a >= b for a, b in zip(cuts, cuts[1:])):
            raise CodecError("cuts aren't increasing inside their unit")
        at = end
    body = b"".join(varint(s) + varint(e - s) + _cuts(s, c) for s, e, c in units)
    return seal(DOCUMENT, _text(raw) + varint(len(units)) + body)


def read_document(blob: bytes) -> tuple[bytes, list[tuple[int, int, list[int]]]]:
    reader = unseal(DOCUMENT, blob)
    raw, units, at = reader.text(), [], 0
    for _ in range(reader.count(3)):
        start = reader.number()
        end = start + reader.number()
        if start < at or start >= end or end > len(raw):
            raise CodecError("units overlap, are empty or leave the document")
        units.append((start, end, _read_cuts(reader, start, end)))
        at = end
    reader.end()
    return raw, units


def _analysis(found: Analysis) -> bytes:
    out = [_text(t.encode()) for t in (found.dictionary_id, found.lemma, found.primary_pos, found.secondary_pos)]
    out.append(varint(len(found.morphemes)))
    for m in found.morphemes:
        optional = [varint(0) if t is None else varint(1) + _text(t.encode()) for t in (m.pos, m.mapped_id)]
        out += [_text(m.id.encode()), _text(m.surface.encode()), varint(m.derivational + 2 * m.informal), *optional]
    out.append(varint(len(found.cuts)) + b"".join(map(varint, found.cuts)))
    return b"".join(out)


def _flag(reader: Reader) -> bool:
    value = reader.number()
    if value > 1:
        raise CodecError("flag is neither 0 nor 1")
    return bool(value)


def _read_analysis(reader: Reader) -> Analysis:
    names = [reader.string() for _ in range(4)]
    parts = []
    for _ in range(reader.count(5)):
        ident, surface, flags = reader.string(), reader.string(), reader.number()
        if flags > 3:
            raise CodecError("unknown morpheme flags")
        optional = [reader.string() if _flag(reader) else None for _ in range(2)]
        parts.append(Morpheme(ident, surface, bool(flags & 1), bool(flags & 2), *optional))
    return Analysis(*names, tuple(parts), tuple(reader.number() for _ in range(reader.count())))


def _check(unit: Unit, at: int, size: int) -> None:
    if unit.start != at or unit.end <= unit.start or unit.end > size:
        raise CodecError("units don't cover the document")
    if not 1 <= unit.kind <= 8 or unit.mode not in _STATUSES or unit.status not in _STATUSES[unit.mode]:
        raise CodecError("kind, mode and status don't go together")
    if (unit.kind in (CONTROL, OPAQUE)) != (unit.mode == BYTES):
        raise CodecError("kind, mode and status don't go together")
    if (unit.analysis is not None) != (unit.status in (MORPHOLOGICAL, UNKNOWN)):
        raise CodecError("an analysis is missing or has no place")
    if unit.analysis is not None and unit.analysis.unknown != (unit.status == UNKNOWN):
        raise CodecError("an unknown unit has a known analysis")


def write_tokenized(raw: bytes, units: list[Unit]) -> bytes:
    out, at = [_text(raw), varint(len(units))], 0
    for u in units:
        _check(u, at, len(raw))
        at = u.end
        out += [varint(u.end - u.start), bytes((u.kind, u.mode, u.status)), varint(0 if u.group is None else u.group + 1), _cuts(u.start, u.cuts)]
        out.append(varint(0) if u.analysis is None else varint(1) + _analysis(u.analysis))
    if at != len(raw):
        raise CodecError("units don't cover the document")
    return seal(TOKENIZED, b"".join(out))


def read_tokenized(blob: bytes) -> tuple[bytes, list[Unit]]:
    reader = unseal(TOKENIZED, blob)
    raw, units, at = reader.text(), [], 0
    for _ in range(reader.count(7)):
        end = at + reader.number()
        kind, mode, status = reader.take(3)
        group = reader.number()
        unit = Unit(at, end, kind, mode, status, group - 1 if group else None, _read_cuts(reader, at, end))
        unit.analysis = _read_analysis(reader) if _flag(reader) else None
        _check(unit, at, len(raw))
        units.append(unit)
        at = end
    reader.end()
    if at != len(raw):
        raise CodecError("units don't cover the document")
    return raw, units


def _choices(start: int, choices: list[Choice], scored: bool) -> bytes:
    out = [varint(len(choices))]
    for c in choices:
        out.append(varint(c.status) + _cuts(start, list(c.cuts)) + varint(c.count) + bytes((c.selected,)))
        if scored:
            out.append(struct.pack("<f", c.score))
    return b"".join(out)


def _read_choices(reader: Reader, start: int, end: int) -> list[Choice]:
    out = []
    for _ in range(reader.count(8)):
        status, cuts, count = reader.number(), tuple(_read_cuts(reader, start, end)), reader.number()
        (selected,) = reader.take(1)
        if selected > 1 or count < 1:
            raise CodecError("a class has no analyses or an unclear mark")
        out.append(Choice(cuts, status, count, np.frombuffer(reader.take(4), "<f4")[0], bool(selected)))
    if sum(c.selected for c in out) != 1 or len({(c.cuts, c.status) for c in out}) != len(out):
        raise CodecError("a unit has one selected class, and each class once")
    return out


def write_lattice(raw: bytes, units: list[Unit], choices: list[list[Choice]]) -> bytes:
    """A document with all classes of analyses of each unit; scores keep their bits."""
    out = [_text(raw), varint(len(units))]
    for u, found in zip(units, choices, strict=True):
        out += [varint(u.end - u.start), bytes((u.kind, u.mode)), varint(0 if u.group is None else u.group + 1), _choices(u.start, found, True)]
    return seal(LATTICE, b"".join(out))


def read_lattice(blob: bytes) -> tuple[bytes, list[Unit], list[list[Choice]]]:
    reader = unseal(LATTICE, blob)
    raw = reader.text()
    units, choices = _read_lattice_units(reader, len(raw))
    return raw, units, choices


def _read_lattice_units(reader: Reader, size: int) -> tuple[list[Unit], list[list[Choice]]]:
    units, choices, at = [], [], 0
    for _ in range(reader.count(6)):
        end = at + reader.number()
        kind, mode = reader.take(2)
        group = reader.number()
        if end <= at or end > size or not 1 <= kind <= 8 or mode not in _STATUSES:
            raise CodecError("units don't cover the document")
        found = _read_choices(reader, at, end)
        best = next(c for c in found if c.selected)
        units.append(Unit(at, end, kind, mode, best.status, group - 1 if group else None, list(best.cuts)))
        choices.append(found)
        at = end
    reader.end()
    if at != size:
        raise CodecError("units don't cover the document")
    return units, choices


def write_sidecar(raw: bytes, units: list[Unit], choices: list[list[Choice]]) -> bytes:
    """A lattice without its text, bound to it by a checksum. Groups have to be numbered in order of use."""
    out, group, following = [hashlib.sha256(raw).digest(), varint(len(raw)), varint(len(units))], None, 0
    for u, found in zip(units, choices, strict=True):
        if u.group is None:
            state = 2
        elif u.group == group:
            state = 1
        elif u.group == following:
            state, following = 0, following + 1
        else:
            raise CodecError("groups aren't numbered in order of use")
        group = u.group
        several = len(found) > 1
        flags = (u.kind - 1) | (u.mode - 1) << 3 | state << 5 | several << 7
        out += [bytes((flags,)), varint(u.end - u.start)]
        out.append(_choices(u.start, found, True) if several else varint(found[0].status) + _cuts(u.start, list(found[0].cuts)) + varint(found[0].count))
    return seal(SIDECAR, b"".join(out))


def read_sidecar(raw: bytes, blob: bytes) -> tuple[list[Unit], list[list[Choice]]]:
    reader = unseal(SIDECAR, blob)
    if reader.take(32) != hashlib.sha256(raw).digest() or reader.number() != len(raw):
        raise CodecError("the sidecar belongs to another document")
    units, choices, at, group, following = [], [], 0, None, 0
    for _ in range(reader.count(5)):
        (flags,) = reader.take(1)
        kind, mode, state = (flags & 7) + 1, (flags >> 3 & 3) + 1, flags >> 5 & 3
        end = at + reader.number()
        if end <= at or end > len(raw) or mode not in _STATUSES or state > 2 or (state == 1 and group is None):
            raise CodecError("units don't cover the document")
        if state == 0:
            group, following = following, following + 1
        elif state == 2:
            group = None
        if flags >> 7:
            found = _read_choices(reader, at, end)
            if len(found) < 2:
                raise CodecError("one class is marked as several")
        else:
            status, cuts, count = reader.number(), tuple(_read_cuts(reader, at, end)), reader.number()
            found = [Choice(cuts, status, count, np.float32(0), True)]
        best = next(c for c in found if c.selected)
        units.append(Unit(at, end, kind, mode, best.status, group, list(best.cuts)))
        choices.append(found)
        at = end
    reader.end()
    if at != len(raw):
        raise CodecError("units don't cover the document")
    return units, choices


def write_chars(vocabulary: V.CharVocabulary) -> bytes:
    return seal(CHARS, _text("".join(vocabulary.chars).encode()))


def read_chars(blob: bytes) -> V.CharVocabulary:
    reader = unseal(CHARS, blob)
    made = _made(V.CharVocabulary, tuple(reader.string()))
    reader.end()
    return made


def write_surfaces(vocabulary: V.SurfaceVocabulary) -> bytes:
    return seal(SURFACES, varint(len(vocabulary.pieces)) + b"".join(map(_text, vocabulary.pieces)))


def read_surfaces(blob: bytes) -> V.SurfaceVocabulary:
    reader = unseal(SURFACES, blob)
    pieces = tuple(reader.text() for _ in range(reader.count(2)))
    reader.end()
    return _made(V.SurfaceVocabulary, pieces)


def write_generation(vocabulary: V.GenerationVocabulary) -> bytes:
    rows = (bytes((k,)) + _text(t.encode()) + _text(s) for k, t, s in vocabulary.entries)
    return seal(GENERATION, varint(len(vocabulary)) + b"".join(rows))


def read_generation(blob: bytes) -> V.GenerationVocabulary:
    reader = unseal(GENERATION, blob)
    entries = []
    for _ in range(reader.count(3)):
        (kind,) = reader.take(1)
        if kind > V.G_PIECE:
            raise CodecError("unknown kind of entry")
        entries.append((kind, reader.string(), reader.text()))
    reader.end()
    return _made(V.GenerationVocabulary, tuple(entries))


def write_roots(vocabulary: V.RootVocabulary) -> bytes:
    return seal(ROOTS, varint(len(vocabulary)) + b"".join(_text(e.encode()) for e in vocabulary.entries))


def read_roots(blob: bytes) -> V.RootVocabulary:
    reader = unseal(ROOTS, blob)
    entries = tuple(reader.string() for _ in range(reader.count(1)))
    reader.end()
    return _made(V.RootVocabulary, entries)


def write_bundle(bundle: Bundle) -> bytes:
    """A morphology bundle as one checked, packed file."""
    wrong = bundle.problems()
    if wrong:
        raise CodecError("; ".join(wrong[:5]))
    tables = {name: list(getattr(bundle, name)) for name in TABLES}
    return seal(BUNDLE, zlib.compress(json.dumps(tables, ensure_ascii=False, sort_keys=True).encode(), 9))


def read_bundle(blob: bytes) -> Bundle:
    reader = unseal(BUNDLE, blob)
    try:
        tables = json.loads(zlib.decompress(reader.data))
        made = Bundle(**{name: tuple(tables.pop(name)) for name in TABLES})
    except (zlib.error, ValueError, KeyError, AttributeError) as error:
        raise CodecError("unreadable bundle") from error
    wrong = made.problems() + [f"unknown table {name}" for name in tables]
    if wrong:
        raise CodecError("; ".join(wrong[:5]))
    return made


def bundle_fingerprint(bundle: Bundle) -> str:
    return hashlib.sha256(write_bundle(bundle)).hexdigest()


def assets(bundle: Bundle | None = None, model: bytes | None = None) -> dict:
    """Versions of what this package reads and writes, and digests of the lexicon and the model in use."""
    return {
        "schema_version": VERSION,
        "morphology_sha256": None if bundle is None else bundle_fingerprint(bundle),
        "model_sha256": None if model is None else hashlib.sha256(model).hexdigest(),
        "runtime": "spark",
        "kernels": "arrow",
        "compiled_analysis_table": True,
        "lattices": True,
        "sidecars": True,
    }


def _made(kind, values):
    try:
        return kind(values)
    except ValueError as error:
        raise CodecError(str(error)) from error


def fingerprint(config, chars: V.CharVocabulary, generation: V.GenerationVocabulary) -> str:
    """One digest of the version, the settings and both vocabularies."""
    parts = [bytes((VERSION,)), repr(config).encode(), write_chars(chars), write_generation(generation)]
    return hashlib.sha256(b"".join(map(_text, parts))).hexdigest()


def column_writer(raw: DataFrame, make: Callable[[bytes], bytes]) -> DataFrame:
    """``doc_id``, ``blob`` of a table of ``doc_id``, ``raw``."""
    kind = raw.schema["doc_id"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [make(v.as_py()) if v.is_valid else None for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["doc_id", "blob"])

    return shipped(raw).select("doc_id", "raw").mapInArrow(kernel, f"doc_id {kind}, blob binary")


def column_reader(blobs: DataFrame, read: Callable[[bytes], bytes], strict: bool = True) -> DataFrame:
    """``doc_id``, ``raw``, ``error``; an unreadable blob raises, or unless strict is told in ``error``."""
    kind = blobs.schema["doc_id"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, errors = [], []
            for value in batch.column(1):
                try:
                    made.append(read(value.as_py()) if value.is_valid else None)
                    errors.append(None)
                except CodecError as error:
                    if strict:
                        raise
                    made.append(None)
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), pa.array(errors, pa.string())], names=["doc_id", "raw", "error"])

    return shipped(blobs).select("doc_id", "blob").mapInArrow(kernel, f"doc_id {kind}, raw binary, error string")
