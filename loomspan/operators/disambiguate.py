"""Choosing among analyses in context, with a linear model over word trigrams.

Features are strings over lemmas and inflectional groups; a model maps them to
weights in single precision. A trigram's score adds its weights in the order of
a hash table that grows at 55 % load, so that scores come out bit for bit.
``causal`` decodes from left to right, ``best_path`` over whole sentences.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from loomspan.functions.turkish import java_hash, mphf_hash, rehash
from loomspan.operators.quality import Analysis

LOAD = 55
_SECONDARY = {
    "Unk": "UnknownSec", "Demons": "DemonstrativePron", "Time": "Time", "Quant": "QuantitivePron", "Ques": "QuestionPron", "Prop": "ProperNoun",
    "Pers": "PersonalPron", "Reflex": "ReflexivePron", "Ord": "Ordinal", "Card": "Cardinal", "Percent": "Percentage", "Ratio": "Ratio", "Range": "Range",
    "Real": "Real", "Dist": "Distribution", "Clock": "Clock", "Date": "Date", "Email": "Email", "Url": "Url", "Mention": "Mention", "HashTag": "HashTag",
    "Emoticon": "Emoticon", "RomanNumeral": "RomanNumeral", "RegAbbrv": "RegularAbbreviation", "Abbrv": "Abbreviation",
    **{f"PC{c}": f"PC{c}" for c in ("Dat", "Acc", "Ins", "Nom", "Gen", "Abl")},
}
Model = Callable[[str], np.float32]


@dataclass(frozen=True)
class Word:
    """What the model sees of an analysis."""

    lemma: str
    groups: tuple[str, ...]
    identity: str = ""
    hash: int = 0


def _wrap(value: int) -> int:
    value &= 0xFFFFFFFF
    return value - (1 << 32) if value >> 31 else value


def analysis_hash(analysis: Analysis) -> int:
    """Hash of the dictionary item and the list of morphemes, in 32 bits."""
    total = 1
    for part in analysis.morphemes:
        total = 31 * total + 31 * java_hash(part.id) + java_hash(part.surface)
    return _wrap((31 * java_hash(analysis.dictionary_id) + total) * 31)


def word_of(analysis: Analysis) -> Word:
    """First group: the kind's long name and the morphemes before a derivation; it is repeated for each derivation."""
    first = ""
    for part in analysis.morphemes:
        if part.derivational:
            break
        first += part.mapped_id or part.id
    more = sum(p.derivational for p in analysis.morphemes)
    groups = (_SECONDARY.get(analysis.secondary_pos, "") + first, *[first] * more)
    return Word(analysis.lemma, groups, analysis.canonical, analysis_hash(analysis))


def boundary(surface: str) -> Word:
    canonical = f"UNK_Unk_Unk\x01Unknown={surface}\x02"
    total = 31 + 31 * java_hash("Unknown") + java_hash(surface)
    return Word("UNK", ("UnknownSecUnknown",), canonical, _wrap((31 * java_hash("UNK_Unk_Unk") + total) * 31))


BEGIN, END = boundary("<s>"), boundary("</s>")


class PerceptronModel:
    """Weights by a minimal perfect hash with fingerprints, as they are stored."""

    MAGIC = 0xCAFEBEEF

    def __init__(self, data: np.ndarray, levels: list[tuple[int, bytes, list[int]]]):
        self.prints, self.weights, self.levels = data[0::2], data[1::2].view(np.float32), levels

    @classmethod
    def parse(cls, blob: bytes) -> PerceptronModel:
        at = 0

        def take(size: int) -> bytes:
            nonlocal at
            if size < 0 or at + size > len(blob):
                raise ValueError("model is truncated")
            at += size
            return blob[at - size : at]

        number = lambda: struct.unpack(">i", take(4))[0]
        if number() & 0xFFFFFFFF != cls.MAGIC:
            raise ValueError("model has wrong magic")
        size = number()
        if size <= 0 or size % 2:
            raise ValueError("model has an odd number of weights")
        data = np.frombuffer(take(4 * size), ">i4").astype(np.int32)
        levels = []
        for _ in range(number()):
            keys, buckets = number(), number()
            if keys <= 0 or buckets <= 0:
                raise ValueError("model has an empty level")
            seeds = take(buckets)
            failed = [number() for _ in range(number())]
            if any(not 0 <= f < size // 2 for f in failed):
                raise ValueError("model refers beyond its weights")
            levels.append((keys, seeds, failed))
        if at != len(blob) or not levels or levels[0][0] != size // 2:
            raise ValueError("model has another size than it says")
        return cls(data, levels)

    def __call__(self, key: str) -> np.float32:
        first = mphf_hash(key)
        for k, (keys, seeds, _) in enumerate(self.levels):
            seed = seeds[first % len(seeds)]
            if seed:
                slot = mphf_hash(key, seed) % keys
                if k:
                    before = self.levels[k - 1][2]
                    if slot >= len(before):
                        break
                    slot = before[slot]
                if self.prints[slot] == java_hash(key) & 0x07FFFFFF:
                    return self.weights[slot]
                break
        return np.float32(0)


def features(one: Word, two: Word, three: Word) -> list[tuple[tuple, str]]:
    """(identity, key) of a trigram's features, in order; equal identities are one feature."""
    g2, g3 = "+".join(two.groups), "+".join(three.groups)
    made = [
        ((2,), f"2:{one.lemma}{g2}{three.lemma}+{g3}"),
        ((3,), f"3:{two.lemma}+{g2}-{three.lemma}+{g3}"),
        ((4,), f"4:{three.lemma}+{g3}"),
        ((9,), f"9:{two.lemma}-{three.lemma}"),
        ((10,), f"10:{three.lemma}"),
        ((11,), f"10b:{two.lemma}"),
        ((12,), f"10c:{one.lemma}"),
    ]
    last1, last2 = (one.groups or ("",))[-1], (two.groups or ("",))[-1]
    for group in three.groups:
        made += [((15, group), f"15:{last1}-{last2}-{group}"), ((17, group), f"17:{last2}{group}")]
    made += [((20, k), f"20:{k}-{group}") for k, group in enumerate(three.groups)]
    return [*made, ((22,), f"22:{len(three.groups)}")]


class _Table:
    """Entries in open addressing, by hash, in the order of their slots."""

    def __init__(self, size: int):
        self.slots: list = [None] * size
        self.count = 0

    def place(self, value: int, same: Callable) -> int:
        mask = len(self.slots) - 1
        slot = rehash(value) & mask
        while self.slots[slot] is not None and not same(self.slots[slot]):
            slot = (slot + 1) & mask
        return slot

    def full(self) -> bool:
        return self.count == len(self.slots) * LOAD // 100

    def grow(self, hash_of: Callable, wide: bool = True) -> None:
        """Twice the slots; a narrow growth still probes within the old ones."""
        old = [e for e in self.slots if e is not None]
        mask = len(self.slots) * (2 if wide else 1) - 1
        self.slots = [None] * (2 * len(self.slots))
        for entry in old:
            slot = rehash(hash_of(entry)) & mask
            while self.slots[slot] is not None:
                slot = (slot + 1) & mask
            self.slots[slot] = entry


def trigram_score(model: Model, one: Word, two: Word, three: Word) -> np.float32:
    table = _Table(32)
    for identity, key in features(one, two, three):
        if table.full():
            table.grow(lambda e: e[1])
        value = java_hash(key)
        slot = table.place(value, lambda e: e[0] == identity)
        if table.slots[slot] is None:
            table.slots[slot] = [identity, value, np.float32(model(key)), 1]
            table.count += 1
        else:
            table.slots[slot][3] += 1
    total = np.float32(0)
    for entry in table.slots:
        if entry is not None:
            total = np.float32(total + entry[2] * np.float32(entry[3]))
    return total


class Disambiguator:
    """Scores are remembered for a task's repeated trigrams."""

    def __init__(self, model: Model, remember: int = 200_000):
        self.model, self.remember = model, remember
        self.score = lru_cache(maxsize=remember)(lambda a, b, c: trigram_score(model, a, b, c))

    def __getstate__(self):
        return self.model, self.remember

    def __setstate__(self, state):
        self.__init__(*state)

    def __call__(self, sets: list[list[Analysis]]) -> list[int]:
        """Index of an analysis for each token of a segment."""
        return self.causal([[word_of(a) for a in found] for found in sets])

    def causal(self, words: list[list[Word]]) -> list[int]:
        """Each token's best given the two before it; the first of equal ones. Unambiguous tokens aren't scored."""
        picked: list[int] = []
        one = two = BEGIN
        for found in words:
            best = 0
            if len(found) > 1:
                scores = [self.score(one, two, w) for w in found]
                best = max(range(len(found)), key=lambda k: (scores[k], -k))
            picked.append(best)
            one, two = two, found[best]
        return picked

    def causal_scores(self, words: list[list[Word]], picked: list[int]) -> list[list[np.float32]]:
        """Scores of all candidates given what was picked before; zero where there is one only."""
        out, one, two = [], BEGIN, BEGIN
        for found, best in zip(words, picked, strict=True):
            out.append([self.score(one, two, w) for w in found] if len(found) > 1 else [np.float32(0)])
            one, two = two, found[best]
        return out

    def conditional_scores(self, words: list[list[Word]], picked: list[int]) -> list[list[np.float32]]:
        """Scores of all trigrams that a candidate is part of, the others being as picked."""
        chosen = [BEGIN, BEGIN, *(f[k] for f, k in zip(words, picked, strict=True)), END]
        out = []
        for place, found in enumerate(words, 2):
            row = []
            for word in found:
                line = [*chosen[:place], word, *chosen[place + 1 :]]
                total = self.score(line[place - 2], line[place - 1], word)
                for last in range(place + 1, min(place + 3, len(line))):
                    total = np.float32(total + self.score(line[last - 2], line[last - 1], line[last]))
                row.append(total)
            out.append(row)
        return out

    def best_path(self, words: list[list[Word]]) -> tuple[list[int], np.float32]:
        """The path of the greatest sum of trigram scores, ties as the hash order of states has them."""
        # a state: (previous word, current word, score, state before, index)
        pair = lambda s: (s[0].identity, s[1].identity)
        value = lambda s: _wrap(31 * s[0].hash + s[1].hash)
        current = [(BEGIN, BEGIN, np.float32(0), None, -1)]
        for found in words:
            table = _Table(8)
            for k, word in enumerate(found):
                for state in current:
                    made = (state[1], word, np.float32(state[2] + self.score(state[0], state[1], word)), state, k)
                    slot = table.place(value(made), lambda s: pair(s) == pair(made))
                    if table.slots[slot] is None:
                        table.count += 1
                        table.slots[slot] = made
                    elif table.slots[slot][2] < made[2]:
                        table.slots[slot] = made
                    if table.full():
                        table.grow(value, wide=False)
            current = [s for s in table.slots if s is not None]
        ended = [(s, np.float32(s[2] + self.score(s[0], s[1], END))) for s in current]
        best = max(range(len(ended)), key=lambda k: (ended[k][1], -k))
        state, total, picked = ended[best][0], ended[best][1], []
        while state[3] is not None:
            picked.append(state[4])
            state = state[3]
        return picked[::-1], total
