"""Analyses of a surface: a provider's, or the fallbacks that need less than a lexicon."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from loomspan.functions.turkish import turkish_lower
from loomspan.session import shipped

UNKNOWN_ID = "UNK_Unk_Unk"


@dataclass(frozen=True)
class Morpheme:
    id: str
    surface: str
    derivational: bool = False
    informal: bool = False
    pos: str | None = None
    mapped_id: str | None = None


@dataclass(frozen=True)
class Analysis:
    """One reading of a surface; ``cuts`` are byte offsets inside it."""

    dictionary_id: str
    lemma: str
    primary_pos: str
    secondary_pos: str
    morphemes: tuple[Morpheme, ...]
    cuts: tuple[int, ...] = field(default=())

    @property
    def unknown(self) -> bool:
        return self.dictionary_id == UNKNOWN_ID

    @property
    def synthetic(self) -> bool:
        return self.dictionary_id.startswith("SYN_") and self.dictionary_id.endswith("_Fallback")

    @property
    def canonical(self) -> str:
        return self.dictionary_id + "\x01" + "".join(f"{m.id}={m.surface}\x02" for m in self.morphemes)

    @property
    def stem(self) -> str:
        return self.morphemes[0].surface if self.morphemes else ""


Provider = Callable[[str], list[Analysis]]


def is_numeric(char: str) -> bool:
    """In one of the number categories."""
    return unicodedata.category(char)[0] == "N"


def unknown(surface: str) -> Analysis:
    return Analysis(UNKNOWN_ID, surface, "Unk", "Unk", (Morpheme("Unknown", surface),))


def synthetic(surface: str, cuts: list[int], lemma: str, primary: str, secondary: str, label: str, informal: bool = False) -> Analysis:
    """An analysis named after the fallback that made it, with a part for each cut."""
    data = surface.encode()
    edges = sorted({0, len(data), *(c for c in cuts if 0 < c < len(data) and data[c] & 0xC0 != 0x80)})
    parts = []
    for k, (begin, end) in enumerate(zip(edges, edges[1:])):
        name = f"{label}Part{k}" if k else f"{label}Root"
        parts.append(Morpheme(name, data[begin:end].decode(), informal=informal, pos=None if k else primary))
    return Analysis(f"SYN_{label}_Fallback", lemma, primary, secondary, tuple(parts), tuple(edges[1:-1]))


_CLOCK = re.compile(r"([0-9]{1,2}(?::[0-9]{2}){1,2})['‘’ʼ＇](.+)\Z", re.S)


def clock_with_suffix(surface: str) -> Analysis | None:
    found = _CLOCK.match(surface)
    if not found or not all(c.isalpha() for c in found[2]):
        return None
    parts = (Morpheme("ClockRoot", found[1], pos="Num"), Morpheme("ClockSuffix", found[2]))
    begin = len(found[1].encode())
    mark = len(surface[len(found[1])].encode())
    return Analysis("SYN_ClockSuffix_Fallback", found[1], "Num", "Clock", parts, (begin, begin + mark))


_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZçÇğĞıİöÖşŞüÜ")
_COMPOSED = {
    b + m: c
    for b, m, c in (
        ("g", "̆", "ğ"), ("G", "̆", "Ğ"), ("s", "̧", "ş"), ("S", "̧", "Ş"), ("c", "̧", "ç"), ("C", "̧", "Ç"),
        ("o", "̈", "ö"), ("O", "̈", "Ö"), ("u", "̈", "ü"), ("U", "̈", "Ü"), ("a", "̂", "â"), ("A", "̂", "Â"),
        ("i", "̂", "î"), ("I", "̂", "Î"), ("u", "̂", "û"), ("U", "̂", "Û"), ("I", "̇", "İ"), ("i", "̇", "i"),
    )
}


_MARKED = frozenset(pair[1] for pair in _COMPOSED)


@dataclass(frozen=True)
class Candidate:
    """A normalised surface; for each of its characters, where that ends in the original."""

    text: str
    ends: tuple[int, ...]

    def original(self, boundary: int) -> int | None:
        """Byte offset in the original of a byte offset in ``text``."""
        if boundary == 0:
            return 0
        at = 0
        for char, end in zip(self.text, self.ends):
            at += len(char.encode())
            if at == boundary:
                return end
        return None


def _ends(text: str) -> list[int]:
    out, at = [], 0
    for char in text:
        at += len(char.encode())
        out.append(at)
    return out


def composed(surface: str) -> Candidate | None:
    """Letter and combining mark made one letter."""
    if _MARKED.isdisjoint(surface):
        return None
    text, ends, original, k = [], [], _ends(surface), 0
    while k < len(surface):
        pair = _COMPOSED.get(surface[k : k + 2])
        text.append(pair or surface[k])
        k += 2 if pair else 1
        ends.append(original[k - 1])
    return Candidate("".join(text), tuple(ends)) if len(text) < len(surface) else None


def without_emphasis(surface: str) -> Candidate | None:
    """A last letter that is written three to eight times, once."""
    if len(surface) < 4 or surface[-1].lower() != surface[-2].lower() or not surface[-1].isalpha():
        return None
    same = (lambda c: c.lower() == surface[-1].lower()) if surface[-1].isascii() else (lambda c: c == surface[-1])
    start = len(surface) - 1
    while start and surface[start - 1].isascii() == surface[-1].isascii() and same(surface[start - 1]):
        start -= 1
    if start == 0 or not 3 <= len(surface) - start <= 8:
        return None
    ends = _ends(surface)
    return Candidate(surface[: start + 1], (*ends[:start], ends[-1]))


def lowered(surface: str) -> Candidate | None:
    out = []
    for char in surface:
        low = {"I": "ı", "İ": "i"}.get(char) or char.lower()
        if len(low) != 1:
            return None
        out.append(low)
    return Candidate("".join(out), tuple(_ends(surface)))


_PLAIN = str.maketrans("cgiosu", "çğıöşü")


def deasciified(base: Candidate, most: int = 64) -> list[Candidate]:
    """Variants with Turkish letters for plain ones, unchanged letters first."""
    variants = [""]
    for char in base.text:
        other = char.translate(_PLAIN)
        grown = []
        for text in variants:
            grown.append(text + char)
            if other != char:
                grown.append(text + other)
        variants = grown[:most]
    return [Candidate(v, base.ends) for v in variants if v != base.text]


def _through(surface: str, candidate: Candidate | None, label: str, provider: Provider | None) -> Analysis | None:
    """Analysis of a surface by way of a normalised form of it."""
    if candidate is None or candidate.text == surface:
        return None
    found = provider(candidate.text) if provider else []
    if not found and candidate.text in _LETTERS:
        return synthetic(surface, [], candidate.text, "Noun", "Abbrv", label)
    for base in found:
        cuts = [candidate.original(c) for c in base.cuts]
        if None not in cuts:
            return synthetic(surface, cuts, base.lemma, base.primary_pos, base.secondary_pos, label, label == "Emphasis")
    return None


def _question(surface: str, provider: Provider | None) -> Analysis | None:
    if provider is None or len(surface) <= 3 or not turkish_lower(surface).endswith(("mı", "mi", "mu", "mü")):
        return None
    for base in provider(surface[:-2]):
        cuts = [*base.cuts, len(surface[:-2].encode())]
        return synthetic(surface, cuts, base.lemma, base.primary_pos, base.secondary_pos, "QuestionAttached", True)
    return None


def fallbacks(surface: str, provider: Provider | None = None) -> list[Analysis]:
    """A provider's analyses, or those of the first fallback that has one; else none."""
    if not surface or len(surface) > 512:
        return []
    clock = clock_with_suffix(surface)
    if clock:
        return [clock]
    found = provider(surface) if provider else []
    if found:
        return found
    for made in (
        _question(surface, provider),
        _through(surface, composed(surface), "Normalized", provider),
        _through(surface, without_emphasis(surface), "Emphasis", provider),
    ):
        if made:
            return [made]
    return [synthetic(surface, [], surface, "Noun", "Abbrv", "Letter")] if surface in _LETTERS else []


def analyses(surface: str, provider: Provider | None = None) -> list[Analysis]:
    """As ``fallbacks``, with the unknown analysis where there is none."""
    return fallbacks(surface, provider) or [unknown(surface)]


def shadow_analyses(surface: str, provider: Provider | None = None) -> list[Analysis]:
    """For lattices: also by way of lower case and Turkish letters."""
    direct = fallbacks(surface, provider)
    base = None if direct else lowered(surface)
    if base is None:
        return direct
    out = []
    for candidate, label in ((base, "ShadowLower"), *((c, "ShadowDeasciify") for c in deasciified(base))):
        made = _through(surface, candidate, label, provider)
        if made and made.canonical not in {m.canonical for m in out}:
            out.append(made)
    return out


def shadow_variants(words: DataFrame) -> DataFrame:
    """``word``, ``variants``: the spellings with Turkish letters that a word's shadow analyses try."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases = [None if w is None else lowered(w) for w in batch.column(0).to_pylist()]
            made = [None if b is None else [c.text for c in deasciified(b)] for b in bases]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.string()))], names=["word", "variants"])

    return shipped(words).select("word").mapInArrow(kernel, "word string, variants array<string>")
