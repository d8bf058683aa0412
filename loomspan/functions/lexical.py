"""Lexical classes of characters and the token grammar built from them.

The grammar exists twice: for Python's ``re`` over text whose invalid bytes are
escaped as lone surrogates, and for Java's regular expressions over valid text,
so that a scan can stay inside Catalyst. Tests hold them against each other.
"""

from __future__ import annotations

import re
from functools import lru_cache

import regex

WHITESPACE, LINE_BREAK, WORD, NUMBER, PUNCTUATION, SYMBOL, CONTROL, OPAQUE = range(1, 9)
KIND_NAMES = {
    WHITESPACE: "whitespace",
    LINE_BREAK: "line_break",
    WORD: "word",
    NUMBER: "number",
    PUNCTUATION: "punctuation",
    SYMBOL: "symbol",
    CONTROL: "control",
    OPAQUE: "opaque",
}

ASCII_PUNCTUATION = ".,;:!?'\"()[]{}<>-/\\`"
ASCII_SYMBOLS = "#$%&*+=@^|~"
#: Blocks, not general categories: guillemets and inverted marks are symbols.
PUNCTUATION_BLOCKS = (
    (0x2000, 0x206F),
    (0x2E00, 0x2E7F),
    (0x3000, 0x303F),
    (0xFE10, 0xFE1F),
    (0xFE30, 0xFE4F),
    (0xFF01, 0xFF0F),
    (0xFF1A, 0xFF20),
    (0xFF3B, 0xFF40),
    (0xFF5B, 0xFF65),
)
MARK_BLOCKS = ((0x0300, 0x036F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F))
OPERATORS = (
    r"==?=|!==?|<<=?|>>=?|\*\*=?|//=?|\?\?=?|<=|>=|->|=>|::|&&|\|\||\+\+|--|"
    r"\+=|-=|\*=|/=|%=|&=|\|=|\^=|/\*|\*/|\?\."
)
GROUP_KINDS = {1: WHITESPACE, 2: LINE_BREAK, 3: WORD, 4: NUMBER, 5: SYMBOL, 6: PUNCTUATION, 7: CONTROL, 8: OPAQUE}


@lru_cache(maxsize=1)
def class_table() -> bytes:
    """Kind of each code point on its own; surrogates are opaque."""
    table = bytearray([SYMBOL]) * 0x110000
    low, high = 0xD800, 0xE000
    runs = ("".join(map(chr, range(low))), 0), ("".join(map(chr, range(high, 0x110000))), high)

    def put(kind: int, pattern: str) -> None:
        for text, base in runs:
            for found in regex.finditer(pattern, text):
                begin, end = found.span()
                table[base + begin : base + end] = bytes([kind]) * (end - begin)

    for begin, end in PUNCTUATION_BLOCKS:
        table[begin : end + 1] = bytes([PUNCTUATION]) * (end + 1 - begin)
    for begin, end in MARK_BLOCKS:
        table[begin : end + 1] = bytes([WORD]) * (end + 1 - begin)
    put(WORD, r"\p{Alphabetic}+")
    put(NUMBER, r"\p{N}+")
    put(CONTROL, r"\p{Cc}+")
    put(WHITESPACE, r"\p{White_Space}+")
    put(LINE_BREAK, r"[\r\n\x85\u2028\u2029]+")
    for char in ASCII_PUNCTUATION:
        table[ord(char)] = PUNCTUATION
    table[ord("_")] = WORD
    table[low:high] = bytes([OPAQUE]) * (high - low)
    return bytes(table)


@lru_cache(maxsize=16)
def _class(kind: int) -> str:
    """Inside of a character class that holds the code points of a kind."""
    table, parts, point = class_table(), [], 0
    marker = bytes([kind])
    while (point := table.find(marker, point)) >= 0:
        end = point
        while end + 1 < 0x110000 and table[end + 1] == kind:
            end += 1
        parts.append(f"\\U{point:08x}" if point == end else f"\\U{point:08x}-\\U{end:08x}")
        point = end + 1
    return "".join(parts)


def _alternatives() -> tuple[str, ...]:
    """One for each kind; every character matches."""
    word, number, symbol, mark = (_class(k) for k in (WORD, NUMBER, SYMBOL, PUNCTUATION))
    either = f"[{word}{number}]"
    joined = rf"{either}*+(?:['’\-‐‑]{either}++)*+"  # runs at a time, not a choice for each character
    sign = f"(?:{OPERATORS}|[{symbol}])"
    return (
        f"[{_class(WHITESPACE)}]+",
        rf"(?:\r\n|[{_class(LINE_BREAK)}])+",
        f"[{word}]{joined}",
        rf"[{number}]++(?:[.,:/\-٫٬][{number}]++)*+(?:['’](?=[{word}]){joined})?",
        rf"{sign}(?:{sign}|‍{sign})*",
        f"(?:(?!{OPERATORS})[{mark}])+",
        f"[{_class(CONTROL)}]+",
        r"[\ud800-\udfff]+",
    )


@lru_cache(maxsize=1)
def grammar() -> re.Pattern:
    """One group for each kind."""
    return re.compile("|".join(f"({a})" for a in _alternatives()))


@lru_cache(maxsize=1)
def token_grammar() -> re.Pattern:
    """The same without groups; plain words, blanks, single marks and line feeds first, where what follows can't lengthen them."""
    quick = (
        r"[A-Za-z_][A-Za-z0-9_]*+(?=[\x00-&(-,./:-@\[-^`{-\x7f]|\Z)| ++(?=[!-~\xa1-\u167f])"
        r"|[.,;:!?'\"()\[\]{}<>\-/\\`](?=[A-Za-z0-9_ \n])|\n++(?=[ -~])"
    )
    return re.compile("|".join((quick, *_alternatives())))


_J_WORD = r"\p{IsAlphabetic}_\x{300}-\x{36f}\x{1ab0}-\x{1aff}\x{1dc0}-\x{1dff}\x{20d0}-\x{20ff}\x{fe20}-\x{fe2f}&&[^\p{N}]"
_J_ANY = r"\p{IsAlphabetic}_\p{N}\x{300}-\x{36f}\x{1ab0}-\x{1aff}\x{1dc0}-\x{1dff}\x{20d0}-\x{20ff}\x{fe20}-\x{fe2f}"
_J_JOINED = rf"(?:[{_J_ANY}]|['\x{{2019}}\-\x{{2010}}\x{{2011}}](?=[{_J_ANY}]))*+"
#: For ``regexp_extract_all`` over valid text.
JAVA_WORD = rf"(?:[{_J_WORD}]{_J_JOINED})"
JAVA_NUMBER = rf"(?:\p{{N}}(?:\p{{N}}|[.,:/\-\x{{66b}}\x{{66c}}](?=\p{{N}}))*+(?:['\x{{2019}}](?=[{_J_WORD}]){_J_JOINED})?)"
JAVA_SPACE = r"(?:[\p{IsWhite_Space}&&[^\r\n\x{85}\x{2028}\x{2029}]]+)"
JAVA_BREAK = r"(?:(?:\r\n|[\r\n\x{85}\x{2028}\x{2029}])+)"
_J_REST = rf"[^\p{{IsWhite_Space}}\p{{Cc}}{_J_ANY}]"
_J_MARK = r"[.,;:!?'\"()\[\]{}<>\-/\\`\x{2000}-\x{206f}\x{2e00}-\x{2e7f}\x{3000}-\x{303f}\x{fe10}-\x{fe1f}\x{fe30}-\x{fe4f}\x{ff01}-\x{ff0f}\x{ff1a}-\x{ff20}\x{ff3b}-\x{ff40}\x{ff5b}-\x{ff65}]"
_J_PLAIN = rf"[{_J_REST}&&{_J_MARK}]"
_J_SIGN = rf"(?:{OPERATORS}|[{_J_REST}&&[^{_J_MARK[1:-1]}]])"
JAVA_SYMBOL = rf"(?:{_J_SIGN}(?:{_J_SIGN}|\x{{200d}}{_J_SIGN})*+)"
JAVA_PUNCTUATION = rf"(?:(?:(?!{OPERATORS}){_J_PLAIN})+)"
JAVA_CONTROL = r"(?:[\p{Cc}&&[^\t\n\x{b}\f\r\x{85}]]+)"
#: The common cases first: ASCII words and blanks that what follows can't lengthen.
_J_QUICK_WORD = r"[A-Za-z_][A-Za-z0-9_]*+(?=[\x00-&(-,.-\x7f]|\z)"
_J_QUICK = _J_QUICK_WORD + r"| ++(?=[!-~])"
JAVA_TOKEN = "|".join((_J_QUICK, JAVA_SPACE, JAVA_BREAK, JAVA_WORD, JAVA_NUMBER, JAVA_SYMBOL, JAVA_PUNCTUATION, JAVA_CONTROL))
#: Words and numbers alone: what lies between begins neither.
JAVA_WORD_OR_NUMBER = "|".join((_J_QUICK_WORD, JAVA_WORD, JAVA_NUMBER))
#: A character that is neither part of a word or number nor white space or a control.
JAVA_SIGN = _J_REST
