"""Tokenisation units: splitting, segments, analyses, chunks and clitic groups.

``units_of`` is the per-document composition. Morphology is a provider, a
function from a surface to analyses; the default one knows none, which is a
mode of its own: clock times with a suffix and single letters are still
morphological, everything else that can be analysed is unknown.
"""

from __future__ import annotations

import gc
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions import lexical
from loomspan.functions.lexical import CONTROL, LINE_BREAK, NUMBER, OPAQUE, PUNCTUATION, SYMBOL, WHITESPACE, WORD
from loomspan.operators import code, quality
from loomspan.operators.scan import early_hints, scan_with_hints
from loomspan.session import shipped

TURKISH, CODE, BYTES = 1, 2, 3
STRUCTURAL, MORPHOLOGICAL, UNKNOWN, CODED, OPAQUE_STATUS = 1, 2, 3, 4, 5
MODES = {"auto": 0, "turkish": TURKISH, "code": CODE}
_WHOLE = frozenset((WHITESPACE, LINE_BREAK, CONTROL, OPAQUE))
CLITICS = frozenset(("mi", "mı", "mu", "mü", "de", "da"))


@dataclass(frozen=True)
class Config:
    """How documents are tokenised."""

    mode: str = "auto"
    max_sentence_tokens: int = 512
    max_fallback_chars: int = 48
    contextual: bool = True
    detect_unmarked_code: bool = True

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError("mode must be auto, turkish or code")
        if self.max_sentence_tokens < 1:
            raise ValueError("max_sentence_tokens must be positive")
        if not 1 <= self.max_fallback_chars <= 4096:
            raise ValueError("max_fallback_chars must lie between 1 and 4096")


@dataclass(slots=True)
class Unit:
    start: int
    end: int
    kind: int
    mode: int
    status: int
    group: int | None = None
    cuts: list[int] = field(default_factory=list)
    analysis: quality.Analysis | None = None


Provider = Callable[[str], list[quality.Analysis]]


def _mode(start: int, end: int, kind: int, spans: list[tuple[int, int]], at: int, requested: int) -> int:
    if kind in (OPAQUE, CONTROL):
        return BYTES
    if requested:
        return requested
    return CODE if at < len(spans) and spans[at][0] <= start and end <= spans[at][1] else TURKISH


def split_units(raw: bytes, lexical: list[tuple[int, int, int]], spans: list[tuple[int, int]], requested: int = 0) -> list[Unit]:
    """Lexical spans cut where punctuation, identifiers and code regions meet."""
    edges = sorted({e for span in spans for e in span})
    out, at, edge = [], 0, 0
    status = {TURKISH: STRUCTURAL, CODE: CODED, BYTES: OPAQUE_STATUS}
    for start, end, kind in lexical:
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        mode = _mode(start, end, kind, spans, at, requested)
        while edge < len(edges) and edges[edge] <= start:
            edge += 1
        inside = edge < len(edges) and edges[edge] < end
        plain = kind in _WHOLE or (kind in (PUNCTUATION, SYMBOL) and end - start == 1) or (mode != CODE and kind in (WORD, NUMBER))
        if plain and not inside:
            out.append(Unit(start, end, kind, mode, status[mode]))
            continue
        data = raw[start:end]
        cuts: set[int] = set()
        if kind == PUNCTUATION or (mode == TURKISH and kind == SYMBOL and all(33 <= b < 127 for b in data)):
            if len(data) > 1:
                here = start
                for char in data.decode():
                    here += len(char.encode())
                    cuts.add(here)
        elif mode == CODE and kind in (WORD, NUMBER):
            cuts.update(start + c for c in code.identifier_cuts(data.decode()))
        while edge < len(edges) and edges[edge] < end:
            cuts.add(edges[edge])
            edge += 1
        cuts.discard(end)
        begin, which = start, at
        for stop in (*sorted(cuts), end):
            while which < len(spans) and spans[which][1] <= begin:
                which += 1
            own = _mode(begin, stop, kind, spans, which, requested)
            out.append(Unit(begin, stop, kind, own, status[own]))
            begin = stop
    return out


def segments(raw: bytes, units: list[Unit], most: int = 512) -> list[list[int]]:
    """Runs of unit indexes that are analysed together."""
    out: list[list[int]] = []
    here: list[int] = []
    for k, unit in enumerate(units):
        if unit.mode != TURKISH or unit.kind in (LINE_BREAK, CONTROL, OPAQUE):
            if here:
                out.append(here)
            here = []
        elif unit.kind != WHITESPACE:
            here.append(k)
            ends = unit.kind == PUNCTUATION and raw[unit.start : unit.end] in (b".", b"!", b"?")
            if ends or len(here) >= most:
                out.append(here)
                here = []
    return [*out, here] if here else out




def numeric_cuts(raw: bytes, start: int, end: int) -> list[int]:
    """Both sides of each separator between numeric characters."""
    text, at, cuts = raw[start:end].decode(), start, set()
    numeric = lambda c: bool(c) and quality.is_numeric(c)
    for k, char in enumerate(text):
        if char in ".,:/-" and k and numeric(text[k - 1]) and numeric(text[k + 1 : k + 2]):
            cuts.update((at, at + 1))
        at += len(char.encode())
    return sorted(cuts)


def apply_analysis(raw: bytes, unit: Unit, analysis: quality.Analysis) -> None:
    """Give a unit its analysis: cuts, status, and for numbers the separators' cuts."""
    if unit.kind in (PUNCTUATION, SYMBOL):
        unit.status, unit.cuts, unit.analysis = STRUCTURAL, [], None
        return
    unit.analysis = analysis
    unit.status = UNKNOWN if analysis.unknown else MORPHOLOGICAL
    unit.cuts = [unit.start + c for c in analysis.cuts]
    if unit.kind == NUMBER:
        unit.cuts = sorted({*unit.cuts, *numeric_cuts(raw, unit.start, unit.end)})


def chunk(raw: bytes, units: list[Unit], most: int = 48) -> list[Unit]:
    """Cut long unknown, code and opaque units; pieces have no cuts and no group."""
    out = []
    for unit in units:
        if unit.status not in (UNKNOWN, CODED) and unit.mode != BYTES or unit.end - unit.start <= most:
            out.append(unit)
            continue
        if unit.mode == BYTES:
            stops = [*range(unit.start + most, unit.end, most), unit.end]
        else:
            text = raw[unit.start : unit.end].decode()
            if len(text) <= most:
                out.append(unit)
                continue
            stops, at = [], unit.start
            for k in range(0, len(text), most):
                at += len(text[k : k + most].encode())
                stops.append(at)
        begin = unit.start
        for stop in stops:
            analysis = quality.unknown(raw[begin:stop].decode()) if unit.status == UNKNOWN else None
            out.append(replace(unit, start=begin, end=stop, group=None, cuts=[], analysis=analysis))
            begin = stop
    return out


def group_clitics(raw: bytes, units: list[Unit]) -> None:
    """Number the content units; clitics and the space before them join their host."""
    following, host = 0, None
    for k, unit in enumerate(units):
        if unit.mode != TURKISH or unit.kind == LINE_BREAK:
            host = None
            continue
        if unit.kind == WHITESPACE:
            continue
        if host is not None and unit.end - unit.start <= 4 and raw[unit.start : unit.end].decode().lower() in CLITICS:
            for member in units[host + 1 : k + 1]:
                member.group = units[host].group
        else:
            unit.group = following
            following += 1
        host = k


def units_of(raw: bytes, config: Config = Config(), provider: Provider | None = None, choose=None, known: dict | None = None) -> list[Unit]:
    """All units of a document.

    ``choose`` picks one of each token's analyses from those of a whole segment;
    without it the first is taken. ``known`` keeps surfaces' analyses from one
    document to the next.
    """
    lexical, (unmarked, artifact, backtick) = scan_with_hints(raw)
    requested = MODES[config.mode]
    spans: list[tuple[int, int]] = []
    if not requested:
        spans = code.code_spans(raw, unmarked, artifact, backtick) if config.detect_unmarked_code else code.fenced_spans(raw)
    units = split_units(raw, lexical, spans, requested)
    known = {} if known is None or len(known) > 200_000 else known
    for segment in segments(raw, units, config.max_sentence_tokens):
        tokens = [raw[units[k].start : units[k].end].decode() for k in segment]
        for token in tokens:
            if token not in known:
                known[token] = quality.analyses(token, provider)
        sets = [known[t] for t in tokens]
        picked = choose(sets) if choose and config.contextual else [0] * len(sets)
        for k, found, which in zip(segment, sets, picked):
            apply_analysis(raw, units[k], found[which])
    units = chunk(raw, units, config.max_fallback_chars)
    group_clitics(raw, units)
    return units


def few_collections() -> None:
    """Kernels make many small objects and no cycles; a worker needn't look for them often."""
    gc.set_threshold(200_000, 50, 100)


SCHEMA = "start array<bigint>, end array<bigint>, kind array<int>, mode array<int>, status array<int>, group_id array<int>, cuts array<array<bigint>>"
ANALYSIS = "struct<canonical:string,dictionary_id:string,lemma:string,primary_pos:string,secondary_pos:string,morphemes:array<struct<id:string,surface:string,derivational:boolean>>>"
_PART = pa.struct([("id", pa.string()), ("surface", pa.string()), ("derivational", pa.bool_())])
_ANALYSIS = pa.struct([*((n, pa.string()) for n in ("canonical", "dictionary_id", "lemma", "primary_pos", "secondary_pos")), ("morphemes", pa.list_(_PART))])
_TYPES = [*(pa.int64(),) * 2, *(pa.int32(),) * 4, pa.list_(pa.int64())]
_FIELDS = ("start", "end", "kind", "mode", "status", "group", "cuts")


def analysis_row(found: quality.Analysis | None) -> dict | None:
    if found is None:
        return None
    parts = [{"id": m.id, "surface": m.surface, "derivational": m.derivational} for m in found.morphemes]
    return {"canonical": found.canonical, "dictionary_id": found.dictionary_id, "lemma": found.lemma, "primary_pos": found.primary_pos, "secondary_pos": found.secondary_pos, "morphemes": parts}


def unit_arrays(raw: DataFrame, config: Config = Config(), provider: Provider | None = None, choose=None, surfaces: bool = False, analyses: bool = False) -> DataFrame:
    """One row a document with its units as arrays; null for null bytes.

    ``surfaces`` adds each unit's bytes, so that nothing has to be joined to get
    them; ``analyses`` adds the analysis chosen for each content unit. Documents
    without code regions are put together from their distinct surfaces
    (``programs``), unless ``choose`` or ``analyses`` need them one by one.
    """
    from loomspan.operators import programs

    kind = raw.schema["doc_id"].dataType.simpleString()
    names = ["start", "end", "kind", "mode", "status", "group_id", "cuts"] + ["surface"] * surfaces + ["analysis"] * analyses
    types = [pa.list_(t) for t in [*_TYPES, *[pa.binary()] * surfaces, *[_ANALYSIS] * analyses]]
    singly = analyses or (choose is not None and config.contextual)

    def by_one(data: bytes | None, known: dict) -> list:
        if data is None:
            return [None] * len(names)
        found = units_of(data, config, provider, choose, known)
        out = [[getattr(u, name) for u in found] for name in _FIELDS]
        if surfaces:
            out.append([data[u.start : u.end] for u in found])
        if analyses:
            out.append([analysis_row(u.analysis) for u in found])
        return out

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few_collections()
        known: dict = {}
        table = programs.Programs(config, provider)
        for batch in programs.batches_by_size(batches, 1):
            values = batch.column(1).to_pylist()
            programs.bounded(known)
            tokens = [None if v is None or singly else table.tokens(v) for v in values]
            fast = [k for k, t in enumerate(tokens) if t is not None]
            slow = [k for k, t in enumerate(tokens) if t is None]
            parts = []
            if fast:
                some = [tokens[k] for k in fast]
                flat = table.flat(table.of(some), np.array([len(t) for t in some]))
                columns = programs.arrow_columns(flat)
                if surfaces:
                    columns.append(programs.surfaces(flat, b"".join(values[k] for k in fast)))
                parts.append((fast, columns))
            if slow:
                rows = [by_one(values[k], known) for k in slow]
                parts.append((slow, [pa.array(list(c), t) for c, t in zip(zip(*rows), types)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *programs.in_order(parts)], names=["doc_id", *names])

    more = ", surface array<binary>" * surfaces + f", analysis array<{ANALYSIS}>" * analyses
    return shipped(raw).select("doc_id", "raw").mapInArrow(kernel, f"doc_id {kind}, {SCHEMA}{more}")


def tokenize(raw: DataFrame, config: Config = Config(), provider: Provider | None = None, choose=None, surfaces: bool = False, analyses: bool = False) -> DataFrame:
    """A row for each unit: ``doc_id``, ``unit_idx``, span, kind, mode, status, ``group_id``, ``cuts``; ``surface``, ``analysis``."""
    names = ["start", "end", "kind", "mode", "status", "group_id", "cuts"] + ["surface"] * surfaces + ["analysis"] * analyses
    made = unit_arrays(raw, config, provider, choose, surfaces, analyses)
    return made.select("doc_id", F.posexplode(F.arrays_zip(*names)).alias("unit_idx", "u")).select("doc_id", "unit_idx", "u.*")


def reduced(raw: DataFrame, make: Callable, schema: str, config: Config = Config(), provider: Provider | None = None) -> DataFrame:
    """What ``make`` gives of the units of bounded runs of documents, as columns of ``schema``; null documents have none.

    Units are added up where they are made, instead of a row of the table for each.
    """
    from loomspan.operators import programs

    names = [f.split()[0] for f in schema.split(", ")]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few_collections()
        for batch in programs.unit_batches(batches, config, provider):
            yield pa.RecordBatch.from_arrays(make(batch), names=names)

    return shipped(raw).select("doc_id", "raw").mapInArrow(kernel, schema)


def _key(raw: DataFrame) -> str:
    return f"doc_id {raw.schema['doc_id'].dataType.simpleString()}"


def status_counts(raw: DataFrame, config: Config = Config(), provider: Provider | None = None) -> DataFrame:
    """``doc_id``, ``n_unknown_words``, ``n_letters`` (words with an analysis), ``n_numbers``: units of each document."""

    def make(b) -> list[pa.Array]:
        word, status = b.flat.kind == WORD, b.flat.status
        return [b.keys, *(pa.array(b.per_document(x)) for x in (word & (status == UNKNOWN), word & (status == MORPHOLOGICAL), b.flat.kind == NUMBER))]

    return reduced(raw, make, f"{_key(raw)}, n_unknown_words long, n_letters long, n_numbers long", config, provider)


def joined_clitics(raw: DataFrame, config: Config = Config(), provider: Provider | None = None) -> DataFrame:
    """``clitic``, ``n``: units that joined the group of their host, in lower case."""

    def make(b) -> list[pa.Array]:
        flat, of = b.flat, b.of
        member = np.flatnonzero((flat.group >= 0) & (flat.kind != WHITESPACE))
        same = (flat.group[member][1:] == flat.group[member][:-1]) & (of[member][1:] == of[member][:-1])
        found = Counter(s.decode("utf-8", "replace").lower() for s in b.text(member[1:][same]))
        return [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())]

    made = reduced(raw, make, "clitic string, n long", config, provider)
    return made.groupBy("clitic").agg(F.sum("n").alias("n"))


def group_sizes(raw: DataFrame, config: Config = Config(), provider: Provider | None = None) -> DataFrame:
    """``doc_id``, ``n_units``, ``n_groups``: how many groups of a document have so many units."""

    def make(b) -> list[pa.Array]:
        inside = np.flatnonzero(b.flat.group >= 0)
        pairs, many = np.unique(np.stack((b.of[inside], b.flat.group[inside])), axis=1, return_counts=True) if len(inside) else (np.empty((2, 0), np.int64), np.empty(0, np.int64))
        (of, size), n = np.unique(np.stack((pairs[0], many)), axis=1, return_counts=True) if len(many) else ((np.empty(0, np.int64),) * 2, np.empty(0, np.int64))
        return [b.keys.take(pa.array(of, pa.int64())), pa.array(size, pa.int64()), pa.array(n, pa.int64())]

    return reduced(raw, make, f"{_key(raw)}, n_units long, n_groups long", config, provider)


def segment_sizes(raw: DataFrame, config: Config = Config(), provider: Provider | None = None) -> DataFrame:
    """``doc_id``, ``seg_id``, ``n_units``: the content units of each segment, numbered as by ``segment_ids``."""

    def make(b) -> list[pa.Array]:
        flat, of = b.flat, b.of
        first = np.frombuffer(b.data, np.uint8)[b.place] if len(of) else np.empty(0, np.uint8)
        closes = (flat.kind == PUNCTUATION) & (flat.sizes == 1) & np.isin(first, list(b".!?"))
        breaks = (flat.mode != TURKISH) | np.isin(flat.kind, (LINE_BREAK, CONTROL, OPAQUE))
        total = np.concatenate(([0], np.cumsum(breaks | closes)))
        step = total[:-1] - total[flat.offsets[:-1]][of]
        content = ~breaks & (flat.kind != WHITESPACE)
        # units lie in order, so that those of a segment follow each other
        of, step = of[content], step[content]
        opens = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (step[1:] != step[:-1])))[: len(of)])
        many = np.diff(np.concatenate((opens, [len(of)])))
        return [b.keys.take(pa.array(of[opens], pa.int64())), pa.array(step[opens], pa.int64()), pa.array(many[: len(opens)], pa.int64())]

    return reduced(raw, make, f"{_key(raw)}, seg_id long, n_units long", config, provider)


def unknown_widths(raw: DataFrame, config: Config = Config(), provider: Provider | None = None) -> DataFrame:
    """``width``, ``n``: unknown words by their number of characters."""

    def make(b) -> list[pa.Array]:
        unknown = (b.flat.kind == WORD) & (b.flat.status == UNKNOWN)
        begins = np.concatenate(([0], np.cumsum((np.frombuffer(b.data, np.uint8) & 0xC0) != 0x80)))
        place = b.place[unknown]
        width, n = np.unique(begins[place + b.flat.sizes[unknown]] - begins[place], return_counts=True)
        return [pa.array(width, pa.int32()), pa.array(n, pa.int64())]

    made = reduced(raw, make, "width int, n long", config, provider)
    return made.groupBy("width").agg(F.sum("n").alias("n"))


def document_violations(raw: DataFrame, config: Config = Config(), provider: Provider | None = None) -> DataFrame:
    """``doc_id``, ``n_bytes`` in units, ``n_wrong``: what ``violations`` finds, counted in each document."""

    def make(b) -> list[pa.Array]:
        wrong = flaws(b.flat, b.lengths)
        return [b.keys, pa.array(b.per_document(b.flat.sizes)), pa.array(wrong, pa.int64())]

    return reduced(raw, make, f"{_key(raw)}, n_bytes long, n_wrong long", config, provider)


@lru_cache(maxsize=1)
def _bytes_mode() -> re.Pattern:
    return re.compile(rf"[{lexical._class(CONTROL)}\ud800-\udfff]+")


def code_units(raw: bytes) -> list[tuple[int, int]]:
    """Spans that units in code mode cover together: code regions without controls and broken bytes."""
    out = []
    for begin, end in code.code_spans(raw, *early_hints(raw)):
        text, at, last = raw[begin:end].decode("utf-8", "surrogateescape"), begin, 0
        for found in _bytes_mode().finditer(text):
            stop = at + len(text[last : found.start()].encode("utf-8", "surrogateescape"))
            if stop > at:
                out.append((at, stop))
            at = stop + len(found[0].encode("utf-8", "surrogateescape"))
            last = found.end()
        if end > at:
            out.append((at, end))
    return out


def code_regions(raw: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``end`` of ``code_units``, without making the units."""
    return code._rows(raw, code_units, "start long, end long", [pa.int64(), pa.int64()])


def flaws(flat, lengths: np.ndarray) -> np.ndarray:
    """The number of each document's units that break an invariant, and one more if they don't reach its end."""
    of = np.repeat(np.arange(len(lengths)), np.diff(flat.offsets))
    end, some = flat.start + flat.sizes, np.diff(flat.offsets) > 0
    before = np.concatenate(([0], end[:-1]))[: len(end)]
    before[flat.offsets[:-1][some]] = 0
    opaque = np.isin(flat.kind, (CONTROL, OPAQUE))
    bad = (before != flat.start) | (flat.sizes <= 0) | (opaque != (flat.mode == BYTES))
    bad |= ((flat.mode == CODE) != (flat.status == CODED)) | ((flat.mode == BYTES) != (flat.status == OPAQUE_STATUS))
    unit = np.repeat(np.arange(len(of)), np.diff(flat.cut_offsets))
    outside = (flat.cuts <= flat.start[unit]) | (flat.cuts >= end[unit])
    outside[1:] |= (unit[1:] == unit[:-1]) & (flat.cuts[1:] <= flat.cuts[:-1])
    bad[unit[outside]] = True
    # the furthest end, as in the table
    reached = np.zeros(len(lengths), np.int64)
    np.maximum.at(reached, of, end)
    return np.bincount(of, weights=bad, minlength=len(lengths)).astype(np.int64) + (reached != lengths)


def preserved(raw: DataFrame) -> DataFrame:
    """Documents that aren't analysed, in the form of ``unit_arrays``: no units, the bytes beside them."""
    types = dict(f.rsplit(" ", 1) for f in SCHEMA.split(", "))
    return raw.select("doc_id", *[F.when(F.col("raw").isNotNull(), F.array().cast(t)).alias(n) for n, t in types.items()], "raw")


def pieces(units: DataFrame) -> DataFrame:
    """The parts between a unit's cuts: ``piece_idx``, ``start``, ``end``."""
    edges = F.concat(F.array("start"), "cuts", F.array("end"))
    parts = F.transform(F.sequence(F.lit(0), F.size("cuts")), lambda i: F.struct(F.get(edges, i).alias("start"), F.get(edges, i + 1).alias("end")))
    return units.select("doc_id", "unit_idx", F.posexplode(parts).alias("piece_idx", "p")).select("doc_id", "unit_idx", "piece_idx", "p.start", "p.end")


def segment_ids(units: DataFrame, most: int = 512) -> DataFrame:
    """Segments by windows: ``seg_id`` and ``seg_part`` of each content unit, from units with surfaces.

    A boundary is carried as a running count, the cap as a division of the row
    number inside a segment.
    """
    closes = (F.col("kind") == PUNCTUATION) & F.col("surface").isin(bytearray(b"."), bytearray(b"!"), bytearray(b"?"))
    breaks = (F.col("mode") != TURKISH) | F.col("kind").isin(LINE_BREAK, CONTROL, OPAQUE)
    order = Window.partitionBy("doc_id").orderBy("unit_idx")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    step = F.coalesce(F.sum(F.when(breaks | closes, 1).otherwise(0)).over(before), F.lit(0))
    content = units.withColumn("seg_id", step).where(~breaks & (F.col("kind") != WHITESPACE))
    inside = F.row_number().over(Window.partitionBy("doc_id", "seg_id").orderBy("unit_idx")) - 1
    return content.select("doc_id", "unit_idx", F.col("seg_id").cast("long"), F.floor(inside / most).cast("long").alias("seg_part"))


def violations(units: DataFrame, raw: DataFrame) -> DataFrame:
    """Units that break an invariant of a tokenised document, with the reason."""
    order = Window.partitionBy("doc_id").orderBy("unit_idx")
    marked = units.withColumn("_before", F.coalesce(F.lag("end").over(order), F.lit(0).cast("long")))
    opaque = F.col("kind").isin(CONTROL, OPAQUE)
    inside = F.forall("cuts", lambda c: (c > F.col("start")) & (c < F.col("end")))
    rising = F.col("cuts") == F.array_sort(F.array_distinct("cuts"))
    reason = (
        F.when(F.col("_before") != F.col("start"), "gap")
        .when(F.col("end") <= F.col("start"), "empty")
        .when(opaque != (F.col("mode") == BYTES), "mode")
        .when((F.col("mode") == CODE) != (F.col("status") == CODED), "status")
        .when((F.col("mode") == BYTES) != (F.col("status") == OPAQUE_STATUS), "status")
        .when(~(inside & rising), "cuts")
    )
    wrong = marked.withColumn("reason", reason).where("reason IS NOT NULL").select("doc_id", "unit_idx", "reason")
    sizes = raw.select("doc_id", F.octet_length("raw").cast("long").alias("size")).join(units.groupBy("doc_id").agg(F.max("end").alias("reached")), "doc_id", "left")
    short = sizes.where(F.coalesce("reached", F.lit(0)) != F.col("size")).select("doc_id", F.lit(None).cast("int").alias("unit_idx"), F.lit("cover").alias("reason"))
    return wrong.unionByName(short)
