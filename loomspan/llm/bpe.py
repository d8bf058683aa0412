"""5. Byte-level BPE encoding and decoding as a reduction over a tree.

The encodings of texts form a monoid: ``encode_tree`` encodes a text's halves
and joins them. A join re-encodes only a window around the seam, which starts
small and doubles until on both sides the tokens outside provably stay:

* at a place where a pre-token ends whatever stands around: between a letter or
  a number and a character of another class, or between a mark that isn't an
  apostrophe and a letter, number or space. Or else,
* inside a run of letters or numbers (as of scripts without spaces, or very long words),
  where the window's outermost token is the one that was there before. A run is
  one pre-token, a sequence of tokens is its encoding if every two neighbours
  are that of their bytes, and of all neighbours in the joined sequence each pair
  stands in an encoding already.

At worst the window reaches the end of a half. So the result is that of encoding
the whole text, and characters near seams only are encoded twice
(``TreeCodec.encoded`` counts them). Decoding concatenates the tokens' bytes up
the same tree.

Defined cases. Ids of any type. Null text: null tokens, null number. Empty text:
no tokens. Null ids and repeated rows: every row by itself. Empty table: no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import vocabularies
from loomspan.llm.common import list_of, slices
from loomspan.session import shipped

VOCABULARY = "byte_bpe_50k"
LEAF = 512
WINDOW = 8


_WIDTH = lambda c: 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
#: Characters of a letter run before a window's first one, so that no contraction reaches into it.
_CONTRACTION = 3


def _kind(char: str) -> str:
    """l(etter), n(umber), s(pace), a(postrophe), o(ther) or ?, as the vocabulary's pattern tells them apart."""
    if char.isspace():
        return "o" if "\x1c" <= char <= "\x1f" else "s"
    first = unicodedata.category(char)
    # what isn't assigned here may be so in the vocabulary's tables
    return "l" if first[0] == "L" else "n" if first[0] == "N" else "a" if char == "'" else "?" if first == "Cn" else "o"


#: Whether a pre-token ends between two characters of these kinds whatever stands around them.
_CERTAIN = {a + b: b not in (a, "?") if a in "ln" else a == "o" and b in "lns" for a in "lnsao?" for b in "lnsao?"}
_RUNS = ({"l"}, {"n"})


class TreeCodec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: str = VOCABULARY, folder: str = vocabularies.FOLDER):
        self.encoding = vocabularies.byte_bpe(vocabulary, folder)
        table = vocabularies.ranks(vocabulary, folder)
        self.bytes = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            self.bytes[rank] = token
        #: Kinds of each token's first and last character, ? where it has but part of it.
        self.opens, self.ends = [], []
        for token in self.bytes:
            whole = token.decode("utf-8", "ignore")
            self.opens.append(_kind(whole[0]) if whole and token.startswith(whole[0].encode()) else "?")
            self.ends.append(_kind(whole[-1]) if whole and token.endswith(whole[-1].encode()) else "?")
        #: Characters that were given to the encoder.
        self.encoded = 0

    def _leaf(self, text: str) -> list[int]:
        self.encoded += len(text)
        return self.encoding.encode_ordinary(text)

    def encode_tree(self, text: str, leaf: int = LEAF) -> np.ndarray:
        return np.array(self._tree(text, leaf), dtype=np.uint32)

    def _tree(self, text: str, leaf: int) -> list[int]:
        if len(text) <= leaf:
            return self._leaf(text)
        middle = len(text) // 2
        return self.join(self._tree(text[:middle], leaf), self._tree(text[middle:], leaf))

    def _text(self, tokens: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, tokens))

    def _edge(self, tokens: list[int], last: bool) -> tuple[int, bool] | None:
        """The innermost place before a token of these at which a window may end, and whether it is certain.

        ``tokens`` stand at the seam's left (``last``: take the rightmost place) or
        at its right. In a run of letters or numbers only the outermost place is given.
        """
        opens, ends = self.opens, self.ends
        for k in range(len(tokens) - 1, 0, -1) if last else range(1, len(tokens)):
            if _CERTAIN[ends[tokens[k - 1]] + opens[tokens[k]]]:
                return k, True
        # by characters, as tokens may have parts of them
        starts = [k for k, t in enumerate(tokens) if self.bytes[t][0] & 0xC0 != 0x80]
        if len(starts) < 2:
            return None
        text = self._text(tokens[starts[0] :]).decode("utf-8", "ignore")
        sizes = np.cumsum([0, *(len(self.bytes[t]) for t in tokens[starts[0] :])])
        at = np.cumsum([0, *map(_WIDTH, text)])  # of each character in bytes
        places = np.searchsorted(at, [sizes[k - starts[0]] for k in starts])
        kinds = "".join(map(_kind, text))
        order = list(zip(starts, places.tolist()))[1:]
        for k, place in reversed(order) if last else order:
            if 0 < place < len(text) and _CERTAIN[kinds[place - 1 : place + 1]]:
                return k, True
        if last:
            for k, place in order:
                if place >= _CONTRACTION and set(kinds[place - _CONTRACTION :]) in _RUNS:
                    return k, False
            return None
        k, place = order[-1]
        return (k, False) if place < len(text) and set(kinds[: place + 1]) in _RUNS else None

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both texts together, from the encoding of each."""
        if not left or not right:
            return left or right
        wide = [WINDOW, WINDOW]
        while True:
            begin, end, sure = 0, len(right), [True, True]
            while wide[0] < len(left):
                found = self._edge(left[-wide[0] :], True)
                if found:
                    begin, sure[0] = len(left) - wide[0] + found[0], found[1]
                    break
                wide[0] *= 2
            while wide[1] < len(right):
                found = self._edge(right[: wide[1]], False)
                if found:
                    end, sure[1] = found
                    break
                wide[1] *= 2
            window = self._leaf((self._text(left[begin:]) + self._text(right[:end])).decode())
            stays = (sure[0] or window[0] == left[begin], sure[1] or window[-1] == right[end - 1])
            if all(stays):
                return left[:begin] + window + right[end:]
            for side in (0, 1):
                if not stays[side]:
                    wide[side] *= 2

    def decode_tree(self, tokens: np.ndarray, leaf: int = 4096) -> bytes:
        if len(tokens) <= leaf:
            return b"".join(map(self.bytes.__getitem__, tokens.tolist()))
        middle = len(tokens) // 2
        return self.decode_tree(tokens[:middle], leaf) + self.decode_tree(tokens[middle:], leaf)


_CODECS: dict[tuple, TreeCodec] = {}


def codec(vocabulary: str = VOCABULARY, folder: str = vocabularies.FOLDER) -> TreeCodec:
    key = (vocabulary, folder)
    if key not in _CODECS:
        _CODECS[key] = TreeCodec(*key)
    return _CODECS[key]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, folder: str = vocabularies.FOLDER, check: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``tokens``; with ``check`` also ``exact``: the text came back."""
    source = shipped(docs).select("doc_id", F.col("text").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(vocabulary, folder)
        for batch in slices(batches, "text", 2 << 20):
            texts = batch.column(1).to_pylist()
            tokens = [np.empty(0, np.uint32) if t is None else made.encode_tree(t) for t in texts]
            missing = np.array([t is None for t in texts])
            sizes = np.array([len(t) for t in tokens], dtype=np.int64)
            flat = np.concatenate(tokens).astype(np.int32)
            lists = list_of(flat, np.concatenate(([0], np.cumsum(sizes))))
            if missing.any():
                lists = pa.array([None if m else x.tolist() for x, m in zip(tokens, missing)], pa.list_(pa.int32()))
            columns = [batch.column(0), pa.array(sizes, mask=missing), lists]
            names = ["doc_id", "n_tokens", "tokens"]
            if check:
                same = [None if t is None else made.decode_tree(x) == t.encode() for t, x in zip(texts, tokens)]
                columns.append(pa.array(same, pa.bool_()))
                names.append("exact")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(kernel, f"doc_id {kind}, n_tokens long, tokens array<int>" + (", exact boolean" if check else ""))


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, folder: str = vocabularies.FOLDER) -> DataFrame:
    """``doc_id`` and ``text`` of rows with ``doc_id`` and ``tokens``."""
    source = shipped(encoded).select("doc_id", F.col("tokens").cast("array<int>").alias("tokens"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(vocabulary, folder)
        for batch in batches:
            rows = batch.column(1)
            texts = [made.decode_tree(rows[i].values.to_numpy()).decode("utf-8", "replace") if rows[i].is_valid else None for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return source.mapInArrow(kernel, f"doc_id {kind}, text string")
