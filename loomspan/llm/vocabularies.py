"""Public vocabularies, read from a folder that the caller names.

Each Python worker loads a file once. ``lengths_of`` counts tokens through a
bounded table of pieces, which gives the same count as encoding the text.
"""

from __future__ import annotations

import base64
import os
import re

FOLDER = "/opt/tokenizers"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same split, for texts in which Python's own character classes agree with it.
_QUICK = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_AGREES = re.compile(
    "[\t-\r -~\xa0-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-ɏ‐-‧‰-‾€]*"
)
_LOADED: dict = {}


def ranks(name: str, folder: str = FOLDER) -> dict[bytes, int]:
    key = ("ranks", folder, name)
    if key not in _LOADED:
        with open(os.path.join(folder, name + ".tiktoken"), "rb") as lines:
            _LOADED[key] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return _LOADED[key]


def byte_bpe(name: str, folder: str = FOLDER):
    import tiktoken

    key = ("bpe", folder, name)
    if key not in _LOADED:
        _LOADED[key] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks(name, folder), special_tokens={})
    return _LOADED[key]


def pieces(name: str, folder: str = FOLDER):
    import sentencepiece

    key = ("pieces", folder, name)
    if key not in _LOADED:
        _LOADED[key] = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, name + ".model"))
    return _LOADED[key]


def split(text: str) -> list[str]:
    """The text's pre-tokens, in order; joined they are the text."""
    if _AGREES.fullmatch(text):
        return _QUICK.findall(text)
    import regex

    if "regex" not in _LOADED:
        _LOADED["regex"] = regex.compile(PATTERN)
    return _LOADED["regex"].findall(text)


class _Counts(dict):
    """Piece -> number of tokens; starts again when it gets large."""

    def __init__(self, encoding, most: int = 300_000):
        super().__init__()
        self.encode, self.most = encoding.encode_ordinary, most

    def __missing__(self, piece: str) -> int:
        count = len(self.encode(piece))
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = count
        return count


def segments(text: str, size: int = 1 << 20):
    """Cut a long text just before a space that follows a non-space.

    No pre-token crosses such a place, whatever stands around it.
    """
    if len(text) <= size:
        yield text
        return
    at = 0
    cut = re.compile(r"(?<=\S) (?=\S)")
    while at < len(text):
        found = cut.search(text, at + size) if at + size < len(text) else None
        stop = found.start() if found else len(text)
        yield text[at:stop]
        at = stop


def length_counter(name: str, folder: str = FOLDER):
    """A function from a text to its exact number of tokens."""
    key = ("counts", folder, name)
    if key not in _LOADED:
        _LOADED[key] = _Counts(byte_bpe(name, folder))
    get = _LOADED[key].__getitem__
    return lambda text: sum(sum(map(get, split(part))) for part in segments(text))
