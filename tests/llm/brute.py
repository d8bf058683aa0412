"""The pipeline's stages once more, on lists in plain Python, without any code of the operators' joins and kernels."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np

from loomspan.llm import common, fertility, minmax, vocabularies


def measured(text: str) -> tuple[int, tuple[float, ...]]:
    """Tokens and the six measures of a text, from encoding it as a whole."""
    encode, pieces = vocabularies.byte_bpe(fertility.BYTE_VOCABULARY), vocabularies.pieces(fertility.PIECE_VOCABULARY)
    one, two = encode.encode_ordinary(text), pieces.encode(text)
    entropy = lambda s: -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) / math.log2(len(s)) if len(s) > 1 else 1.0
    bare = sum(not decodes(encode.decode_single_token_bytes(t)) for t in one)
    return len(one), (len(text) / len(one), bare / len(one), entropy(one), len(text) / len(two), sum(map(pieces.is_byte, two)) / len(two), entropy(two))


def decodes(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def verdicts(rows: list[dict]) -> list[list[str]]:
    """Reasons against each of some rows with ``band_key``, ``n_tokens`` and measures."""
    enough = [r for r in rows if r["n_tokens"] >= fertility.ENOUGH]
    groups = defaultdict(list)
    for r in enough:
        groups[r["band_key"]].append(r)
    at = lambda values, share: values[max(0, math.ceil(share * len(values)) - 1)]
    known: dict[tuple, tuple] = {}
    out = []
    for r in rows:
        group = groups[r["band_key"]]
        key = r["band_key"] if len(group) >= fertility.FEWEST else None
        group = group if key is not None else enough
        off = {}
        for m in fertility.MEASURES:
            if r[m] is not None and r["n_tokens"] >= fertility.ENOUGH:
                if (key, m) not in known:
                    values = sorted(x[m] for x in group)
                    known[key, m] = tuple(at(values, q) for q in (0.25, 0.5, 0.75))
                low, mid, high = known[key, m]
                off[m] = (r[m] - mid) / (max((high - low) / 1.349, fertility.LEAST[m]) * math.sqrt(1 + fertility.SHORT / r["n_tokens"]))
        reasons = []
        for m, x in off.items():
            lower, upper = fertility.WIDTH[m]
            if m == "byte_chars" and off["byte_fallback"] > fertility.FOREIGN:
                lower = fertility.FOREIGN_CHARS
            if x < -lower or x > upper:
                reasons.append(m)
        out.append(reasons)
    return out


Docs = list[tuple[int, str, str]]  # id, text, language


def quality(docs: Docs) -> Docs:
    rows = []
    for _, text, lang in docs:
        n, values = measured(text) if text else (0, (None,) * 6)
        rows.append({"band_key": lang, "n_tokens": n, **dict(zip(fertility.MEASURES, values))})
    return [d for d, reasons in zip(docs, verdicts(rows)) if not reasons]


def lines(docs: Docs) -> Docs:
    seen, out = set(), []
    for ident, text, lang in sorted(docs):
        kept, dropped = [], False
        for line in text.split("\n"):
            bare = line.encode().strip()
            if bare and bare in seen:
                dropped = True
                continue
            seen.add(bare)
            kept.append(line)
        left = "\n".join(kept)
        if not dropped or re.search(r"[^ \t\n\x0b\f\r]", left):
            out.append((ident, left, lang))
    return out


def kind(char: str) -> str:
    """Of a character: alone, joined or apart."""
    if char.isascii():
        return "joined" if char.isalnum() else "apart"
    category = unicodedata.category(char)
    if ord(char) < 1 << 16 and (category[0] in "PZ" or category == "Cc"):
        return "apart"
    return "alone" if any(low <= ord(char) <= high for low, high in (*common._SCRIPTS, (0x20000, 0x3FFFF))) else "joined"


def words(text: str) -> list[tuple[str, int, int]]:
    """Words in lower case with their places in the text."""
    out, begin = [], None
    kinds = [*map(kind, text), "apart"]
    for k, now in enumerate(kinds):
        if begin is not None and now != "joined":
            out.append((begin, k))
            begin = None
        if now == "alone":
            out.append((k, k + 1))
        elif now == "joined" and begin is None:
            begin = k
    return [(re.sub("[A-Z]", lambda m: m[0].lower(), text[b:e]), b, e) for b, e in out]


def near(docs: Docs) -> Docs:
    """One of each component of pairs that share a band and whose estimate reaches the threshold."""
    sigs = {}
    for ident, text, _ in docs:
        data = text.encode()
        hashes, _ = minmax.shingle_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        made = [[(int(h) * int(f) + int(s)) % (1 << 64) for h in hashes] for f, s in zip(minmax._FACTORS, minmax._SHIFTS)]
        sigs[ident] = np.array([min(m) >> 32 for m in made] + [max(m) >> 32 for m in made], dtype=np.uint32)
    ids = sorted(sigs)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            same = sigs[a] == sigs[b]
            if same.sum() >= math.ceil(minmax.THRESHOLD * len(same)) and same.reshape(-1, minmax.BAND_ROWS).all(axis=1).any():
                one, two = root(a), root(b)
                parent[max(one, two)] = min(one, two)
    return [d for d in docs if root(d[0]) == d[0]]


def passages(docs: Docs, least: int) -> Docs:
    seen, out = set(), []
    for ident, text, lang in sorted(docs):
        found = words(text)
        gone = np.zeros(len(text), bool)
        dropped, begin = False, None
        runs = [tuple(w for w, _, _ in found[p : p + least]) for p in range(len(found) - least + 1)]
        for p in range(len(runs) + 1):
            again = p < len(runs) and runs[p] in seen
            if p < len(runs):
                seen.add(runs[p])
            if again and begin is None:
                begin = p
            elif not again and begin is not None:
                gone[found[begin][1] : found[p + least - 2][2]] = True
                dropped, begin = True, None
        left = "".join(c for c, g in zip(text, gone) if not g)
        if not dropped or words(left):
            out.append((ident, left, lang))
    return out


def bins(docs: Docs, capacity: int) -> list[int]:
    """What the bins of best-fit decreasing hold, which doesn't depend on how ties are broken."""
    count = vocabularies.byte_bpe(fertility.BYTE_VOCABULARY).encode_ordinary
    pieces = []
    for _, text, _ in docs:
        n = len(count(text))
        pieces += [capacity] * (n // capacity) + [n % capacity] * (n % capacity > 0)
    room: list[int] = []
    for length in sorted(pieces, reverse=True):
        fitting = [(r, k) for k, r in enumerate(room) if r >= length]
        if fitting:
            room[min(fitting)[1]] -= length
        else:
            room.append(capacity - length)
    return sorted(capacity - r for r in room)
