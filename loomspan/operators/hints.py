"""Cheap signs, seen while scanning, of what a document may contain.

They only gate the expensive detectors: a detector that a hint rules out would
have found nothing.
"""

from __future__ import annotations

import re

from loomspan.functions.lexical import LINE_BREAK, NUMBER, PUNCTUATION, SYMBOL, WHITESPACE, WORD

LEADING_WORDS = frozenset(
    b"pub async unsafe extern fn struct enum trait impl mod use let const static type def class import from function "
    b"var package namespace interface export if for while match loop else return break continue pass raise try except "
    b"finally with yield await SELECT INSERT UPDATE DELETE CREATE ALTER WITH".split()
)
STRONG_SIGNS = frozenset(b"=> :: -> += -= *= /= %= == != <= >= && || ?? ?. := << >>".split())
_OPENING_SIGNS = frozenset((b"//", b"/*", b"#!", b"#["))
_TIME_TAIL = re.compile(rb"[Tt][0-9]{2}")
_PREFIXED_TAIL = re.compile(rb"[xXbBoO][0-9a-fA-F_]+\Z")
_NUMBER_TAIL = re.compile(rb"(?:[eE][+-]?[0-9_]+|[fFiIuU][0-9]+)\Z")
_SECTION = re.compile(rb"[.:\-\[]*\Z")


class HintTracker:
    """Watches spans in order. Once code may be there, only cheap tests go on."""

    def __init__(self):
        self.code = self.artifact = self.backtick = False
        self._new_line()

    def _new_line(self) -> None:
        self.first, self.call, self.member, self.hash = True, False, False, False
        self.key = self.section = self.entity = 0
        self.number = self.zero = False

    def finish(self) -> tuple[bool, bool, bool]:
        return self.code or self.section == 2, self.artifact, self.backtick

    def observe(self, kind: int, data: bytes) -> None:
        if kind == LINE_BREAK:
            self.code |= self.section == 2
            self._new_line()
            return
        if kind == WHITESPACE:
            self.number = self.zero = False
            if self.section == 1:
                self.section = 0
            return
        sign = kind in (SYMBOL, PUNCTUATION)
        if kind == PUNCTUATION and b"`" in data:
            self.backtick = True
        if sign and (b"@" in data or b"=" in data or b"://" in data):
            self.artifact = True
        if kind == WORD and (data in (b"http", b"https", b"www") or (self.number and _TIME_TAIL.match(data))):
            self.artifact = True
        if self.code:
            self.first = False
            return
        first, number, zero = self.first, self.number, self.zero
        self.number = self.zero = False
        self.code = self._shows_code(kind, sign, data, first, number, zero)
        if self.code:
            return
        if first:
            self._open_line(data)
        self.first = False

    def _shows_code(self, kind: int, sign: bool, data: bytes, first: bool, number: bool, zero: bool) -> bool:
        if self.key == 2:
            if data == b":":
                return True
            self.key = 0
        elif self.key == 1 and sign and b'"' in data:
            rest = data[data.index(b'"') + 1 :]
            if rest == b":":
                return True
            self.key = 0 if rest else 2
        if self.section == 2:
            self.section = 0
        if self.entity == 1:
            self.entity = 2 if kind == WORD and data == b"lt" else 0
        elif self.entity == 2:
            if kind == PUNCTUATION and b";" in data:
                return True
            self.entity = 0
        if kind == WORD:
            if number and ((zero and _PREFIXED_TAIL.match(data)) or (not (zero and data[:1] in b"xXbBoO") and _NUMBER_TAIL.match(data))):
                return True
            if first and data in LEADING_WORDS:
                return True
            self.call = b"a" <= data[:1] <= b"z" and (first or self.member)
            self.member = False
        elif sign:
            return self._sign(data, first)
        elif kind == NUMBER:
            self.number, self.zero = True, data == b"0"
            self.call = self.member = False
        else:
            self.call = self.member = False
            self.key = self.section = self.entity = 0
        return False

    def _sign(self, data: bytes, first: bool) -> bool:
        if first and (data[:1] == b"<" or data in _OPENING_SIGNS):
            return True
        if self.call and (data == b"=" or b"(" in data):
            return True
        if b"{" in data or b"}" in data or data in STRONG_SIGNS or (self.hash and b"!" in data):
            return True
        if self.section == 1 and not _SECTION.match(data):
            self.section = 0 if data.strip(b"]") else 2
        self.member = data in (b".", b"::")
        if data not in (b"!", b".", b"::"):
            self.call = False
        return False

    def _open_line(self, data: bytes) -> None:
        if data[:1] == b'"':
            _, quote, after = data[1:].partition(b'"')
            if not quote:
                self.key = 1
            elif after == b":":
                self.code = True
                return
            else:
                self.key = 0 if after else 2
        if not data.strip(b"["):
            self.section = 1
        if data == b"&":
            self.entity = 1
        self.hash = data[:1] == b"#"
