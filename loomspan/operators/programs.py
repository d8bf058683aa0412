"""Units of whole batches of documents by way of their distinct surfaces.

Outside code regions, and where no context chooses between analyses, the units
that a lexical span gives depend on its surface alone. So each distinct surface
is split, analysed and chunked once, as a short program of units held in flat
arrays, and documents are put together from these by index: tokens are found by
the grammar, looked up in one map, and everything else is numpy on whole batches.
Documents with code regions go through ``units.units_of``.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from loomspan.functions import lexical
from loomspan.functions.lexical import CONTROL, GROUP_KINDS, LINE_BREAK, OPAQUE, WHITESPACE, WORD
from loomspan.operators import code, quality, units
from loomspan.operators.hints import LEADING_WORDS, HintTracker
from loomspan.operators.scan import batches_by_size, token_kind

#: What a worker holds at a time: distinct surfaces, entries of other maps.
MOST_SURFACES = 200_000
MOST_KNOWN = 50_000


def bounded(known: dict) -> dict:
    """The map, emptied if it has grown too large."""
    if len(known) > MOST_KNOWN:
        known.clear()
    return known


class _Loud:
    """Finds every text for which a scan's hints could be anything but false, and some others.

    One sign after another is looked for, which takes a tenth of the time of one pattern for all.
    """

    signs = (*"{}(@=`", "::", "??", "?.", "//", "/*", "->", "<<", ">>", "http", "www")

    def __init__(self):
        spaces, number = lexical._class(WHITESPACE), lexical._class(lexical.NUMBER)
        opens = "|".join(["[&#\\[\"<]", *sorted(w.decode() for w in LEADING_WORDS)])
        tail = r"(?:[eEfFiIuUtT][0-9_+\-]|[xXbBoO])"
        self.finders = (
            re.compile(r"&&(?!&)(?<!&&&)").search,  # longer runs are other tokens
            re.compile(r"\|\|(?!\|)(?<!\|\|\|)").search,
            re.compile(rf"[0-9]{tail}").search,
            re.compile(rf"[^\x00-\x7f](?={tail})(?<=[{number}])").search,  # the class of all numbers is slow to search for
            re.compile(rf"[{spaces}]*(?:{opens})").match,
            re.compile(rf"[\r\n\x85\u2028\u2029][{spaces}]*(?:{opens})").search,
        )

    def search(self, text: str) -> bool:
        return any(s in text for s in self.signs) or any(found(text) for found in self.finders)


@lru_cache(maxsize=1)
def loud() -> _Loud:
    return _Loud()


_LINES = re.compile(r"[\r\n\x85\u2028\u2029]+")


def hints(text: str) -> tuple[bool, bool, bool]:
    """``scan.early_hints`` from the loud lines alone: each line begins anew."""
    if not loud().search(text):
        return False, False, False
    tracker = HintTracker()
    for line in _LINES.split(text):
        if not loud().search(line):
            continue
        for token in lexical.token_grammar().findall(line):
            tracker.observe(token_kind(token[:4]), token.encode("utf-8", "surrogateescape"))
            if tracker.code:
                return True, True, "`" in text
        tracker.observe(LINE_BREAK, b"\n")
    return tracker.finish()


@dataclass
class Flat:
    """Units of several documents one after another."""

    offsets: np.ndarray  # of documents, in units
    sizes: np.ndarray  # bytes of each unit
    start: np.ndarray
    kind: np.ndarray
    mode: np.ndarray
    status: np.ndarray
    group: np.ndarray  # -1: none
    cut_offsets: np.ndarray
    cuts: np.ndarray


class Programs:
    """Surface -> its units, under fixed settings."""

    def __init__(self, config: units.Config, provider: units.Provider | None = None):
        self.config, self.provider = config, provider
        self.requested = units.MODES[config.mode]
        self.longest = config.max_fallback_chars if provider is None else 0  # of plain words
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.surfaces: list[str] = []
        self.first, self.cut_first = array("q", [0]), array("q", [0])
        self.kind, self.mode, self.status, self.clitic = array("b"), array("b"), array("b"), array("b")
        self.size, self.cuts = array("q"), array("q")

    def _put(self, made: list[units.Unit], raw: bytes) -> None:
        for unit in made:
            self.kind.append(unit.kind)
            self.mode.append(unit.mode)
            self.status.append(unit.status)
            self.clitic.append(unit.end - unit.start <= 4 and raw[unit.start : unit.end].decode("utf-8", "replace").lower() in units.CLITICS)
            self.size.append(unit.end - unit.start)
            self.cuts.extend(c - unit.start for c in unit.cuts)
            self.cut_first.append(len(self.cuts))
        self.first.append(len(self.kind))

    def plain(self, surface: str) -> bool:
        """Whether it is a word that no fallback knows: one unit without cuts."""
        return surface[0].isalpha() and 1 < len(surface) <= self.longest and quality._MARKED.isdisjoint(surface)

    def _add_plain(self, surfaces: list[str]) -> None:
        many, units_before = len(surfaces), len(self.kind)
        self.kind.frombytes(bytes([WORD]) * many)
        self.mode.frombytes(bytes([units.TURKISH]) * many)
        self.status.frombytes(bytes([units.UNKNOWN]) * many)
        sizes = [len(s.encode("utf-8", "surrogateescape")) for s in surfaces]
        self.clitic.extend([n <= 4 and s.lower() in units.CLITICS for s, n in zip(surfaces, sizes)])
        self.size.extend(sizes)
        self.cut_first.extend([len(self.cuts)] * many)
        self.first.extend(range(units_before + 1, units_before + many + 1))

    def _add(self, surface: str) -> None:
        raw = surface.encode("utf-8", "surrogateescape")
        kind = GROUP_KINDS[lexical.grammar().match(surface).lastindex]
        made = units.split_units(raw, [(0, len(raw), kind)], [], self.requested)
        for unit in made:
            if unit.mode == units.TURKISH and unit.kind not in (WHITESPACE, LINE_BREAK, CONTROL, OPAQUE):
                units.apply_analysis(raw, unit, quality.analyses(raw[unit.start : unit.end].decode(), self.provider)[0])
        self._put(units.chunk(raw, made, self.config.max_fallback_chars), raw)

    def look_up(self, tokens: list[str]) -> np.ndarray:
        found = np.fromiter(map(self.index.get, tokens, [-1] * len(tokens)), dtype=np.int64, count=len(tokens))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [tokens[k] for k in missing]
            plain, others = [], []
            for surface in dict.fromkeys(new):
                (plain if self.plain(surface) else others).append(surface)
            self._add_plain(plain)
            for surface in others:
                self._add(surface)
            self.index.update(zip(plain + others, range(len(self.surfaces), len(self.surfaces) + len(plain) + len(others))))
            self.surfaces += plain
            self.surfaces += others
            found[missing] = np.fromiter(map(self.index.__getitem__, new), dtype=np.int64, count=len(new))
        return found

    def tokens(self, raw: bytes) -> list[str] | None:
        """A document's surfaces; null if it has code regions."""
        text = raw.decode("utf-8", "surrogateescape")
        if self.config.mode == "code":
            return None
        if self.config.mode == "auto":
            if not self.config.detect_unmarked_code:
                if b"`" in raw and code.fenced_spans(raw):
                    return None
            else:
                found = hints(text)
                if any(found) and code.code_spans(raw, *found):
                    return None
        return lexical.token_grammar().findall(text)

    def of(self, tokens: list[list[str]]) -> np.ndarray:
        """Numbers of the surfaces of several documents."""
        if len(self.surfaces) > MOST_SURFACES:
            self.reset()
        return self.look_up([t for some in tokens for t in some])

    def flat(self, numbers: np.ndarray, counts: np.ndarray) -> Flat:
        """The units of documents with so many surfaces each."""
        view = lambda values, kind: np.frombuffer(values, dtype=kind) if len(values) else np.empty(0, kind)
        first = view(self.first, np.int64)
        place, many = _ranges(first[numbers], first[numbers + 1] - first[numbers])
        ends = np.concatenate(([0], np.cumsum(many)))
        offsets = ends[np.concatenate(([0], np.cumsum(counts)))]
        kind, mode, status, clitic = (view(a, np.int8)[place] for a in (self.kind, self.mode, self.status, self.clitic))
        sizes = view(self.size, np.int64)[place]
        total = np.concatenate(([0], np.cumsum(sizes)))
        of = np.repeat(np.arange(len(counts)), np.diff(offsets))
        start = total[:-1] - total[offsets[:-1]][of]
        cut_first = view(self.cut_first, np.int64)
        where, cuts = _ranges(cut_first[place], cut_first[place + 1] - cut_first[place])
        cut_offsets = np.concatenate(([0], np.cumsum(cuts)))
        return Flat(offsets, sizes, start, kind, mode, status, _groups(offsets, kind, mode, clitic.astype(bool)), cut_offsets, view(self.cuts, np.int64)[where] + np.repeat(start, cuts))


def flat_of(found: list[list[units.Unit]]) -> Flat:
    """Units of several documents, made one by one, in this form."""
    every = [u for some in found for u in some]
    column = lambda name, kind: np.array([getattr(u, name) for u in every], kind)
    starts = lambda counts: np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    start = column("start", np.int64)
    group = np.array([-1 if u.group is None else u.group for u in every], np.int64)
    cuts = np.array([c for u in every for c in u.cuts], np.int64)
    kinds = (column(name, np.int8) for name in ("kind", "mode", "status"))
    return Flat(starts([len(some) for some in found]), column("end", np.int64) - start, start, *kinds, group, starts([len(u.cuts) for u in every]), cuts)


@dataclass
class Batch:
    """Units of several documents, with the documents' ids and their bytes one after another."""

    keys: pa.Array
    flat: Flat
    data: bytes
    lengths: np.ndarray  # of documents, in bytes

    @property
    def of(self) -> np.ndarray:
        """The document of each unit."""
        return np.repeat(np.arange(len(self.lengths)), np.diff(self.flat.offsets))

    @property
    def place(self) -> np.ndarray:
        """Where each unit begins in the bytes of all."""
        return self.flat.start + np.concatenate(([0], np.cumsum(self.lengths)))[self.of]

    def per_document(self, what: np.ndarray) -> np.ndarray:
        """Sums over each document's units."""
        return np.diff(np.concatenate(([0], np.cumsum(what)))[self.flat.offsets]).astype(np.int64)

    def text(self, which: np.ndarray) -> list[bytes]:
        """Bytes of units."""
        place, end = self.place[which], (self.place + self.flat.sizes)[which]
        return [self.data[b:e] for b, e in zip(place.tolist(), end.tolist())]


def unit_batches(batches: Iterator[pa.RecordBatch], config: units.Config = units.Config(), provider: units.Provider | None = None) -> Iterator[Batch]:
    """The units of documents that aren't null, in bounded runs of them."""
    known: dict = {}
    table = Programs(config, provider)
    for batch in batches_by_size(batches, 1):
        values = batch.column(1).to_pylist()
        there = [k for k, v in enumerate(values) if v is not None]
        tokens = {k: table.tokens(values[k]) for k in there}
        for some in ([k for k in there if tokens[k] is not None], [k for k in there if tokens[k] is None]):
            if not some:
                continue
            if tokens[some[0]] is not None:
                flat = table.flat(table.of([tokens[k] for k in some]), np.array([len(tokens[k]) for k in some]))
            else:
                flat = flat_of([units.units_of(values[k], config, provider, None, bounded(known)) for k in some])
            yield Batch(batch.column(0).take(pa.array(some, pa.int64())), flat, b"".join(values[k] for k in some), np.array([len(values[k]) for k in some]))


def _ranges(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of runs of ``count`` from ``begin``, and the counts."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - count, count) + np.repeat(begin, count), count


def _groups(offsets: np.ndarray, kind: np.ndarray, mode: np.ndarray, clitic: np.ndarray) -> np.ndarray:
    """``units.group_clitics`` on several documents: each unit's group, -1 without one."""
    size = len(kind)
    if not size:
        return np.empty(0, np.int64)
    at = np.arange(size)
    breaks = (mode != units.TURKISH) | (kind == LINE_BREAK)
    content = ~breaks & (kind != WHITESPACE)
    begin = np.repeat(offsets[:-1], np.diff(offsets))
    before = lambda mask: np.concatenate(([-1], np.maximum.accumulate(np.where(mask, at, -1))[:-1]))
    host, stop = before(content), before(breaks)
    joined = content & clitic & (host >= begin) & (host > stop)
    opens = np.cumsum(content & ~joined)
    base = np.concatenate(([0], opens))[begin]
    group = np.where(content, opens - base - 1, -1)
    # white space between a host and its clitic: the next content unit is joined and nothing breaks before it
    following = np.minimum.accumulate(np.where(content | breaks, at, size)[::-1])[::-1]
    inside = (kind == WHITESPACE) & ~breaks & (following < size)
    inside[inside] = joined[following[inside]]
    return np.where(inside, opens - base - 1, group)


def arrow_columns(flat: Flat) -> list[pa.Array]:
    """One list a document: start, end, kind, mode, status, group, cuts."""
    lists = lambda values: pa.ListArray.from_arrays(pa.array(flat.offsets.astype(np.int32)), values)
    group = pa.array(flat.group.astype(np.int32), mask=flat.group < 0)
    cuts = pa.ListArray.from_arrays(pa.array(flat.cut_offsets.astype(np.int32)), pa.array(flat.cuts))
    plain = [pa.array(flat.start), pa.array(flat.start + flat.sizes), *(pa.array(a.astype(np.int32)) for a in (flat.kind, flat.mode, flat.status)), group, cuts]
    return [lists(a) for a in plain]


def surfaces(flat: Flat, raw: bytes) -> pa.Array:
    """One list a document of its units' bytes; ``raw`` are the documents one after another."""
    offsets = np.concatenate(([0], np.cumsum(flat.sizes))).astype(np.int32)
    values = pa.Array.from_buffers(pa.binary(), len(flat.sizes), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    return pa.ListArray.from_arrays(pa.array(flat.offsets.astype(np.int32)), values)


def in_order(parts: list[tuple[list[int], list[pa.Array]]]) -> list[pa.Array]:
    """Columns of several sets of rows, put into the rows' order."""
    rows = [r for some, _ in parts for r in some]
    order = pa.array(np.argsort(rows, kind="stable"))
    return [pa.concat_arrays(column).take(order) for column in zip(*(columns for _, columns in parts))]
