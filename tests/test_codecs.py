"""Binary forms: round trips and everything they refuse."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.operators import lattice, units
from loomspan.operators import vocab as V
from loomspan.sources import codecs as C


@given(st.binary(max_size=150))
@settings(max_examples=150, deadline=None)
def test_tokenized_round_trip(raw):
    found = units.units_of(raw)
    assert C.read_tokenized(C.write_tokenized(raw, found)) == (raw, found)
    plain = [(u.start, u.end, u.cuts) for u in found]
    assert C.read_document(C.write_document(raw, plain)) == (raw, plain)


def test_document_errors():
    for parts in ([(0, 4, [2, 2])], [(0, 3, []), (2, 4, [])], [(2, 2, [])], [(0, 9, [])], [(0, 4, [4])]):
        with pytest.raises(C.CodecError):
            C.write_document(b"abcd", parts)
    blob = C.write_document(b"evler\x00\xff\r\n", [(0, 5, [2])])
    assert blob == C.write_document(b"evler\x00\xff\r\n", [(0, 5, [2])])
    for bad in (b"X" + blob[1:], blob[:8] + b"\x63" + blob[9:], blob[:-1], blob + b"\x00", blob[:50] + bytes((blob[50] ^ 1,)) + blob[51:], b""):
        with pytest.raises(C.CodecError):
            C.read_document(bad)


def test_resigned_blobs_are_still_checked():
    raw = b"ev 12"
    found = units.units_of(raw)
    payload = C.write_tokenized(raw, found)[41:]
    refused = 0
    for k in range(len(raw) + 2, len(payload)):
        for value in (0, 255, payload[k] ^ 1):
            changed = C.seal(C.TOKENIZED, payload[:k] + bytes((value,)) + payload[k + 1 :])
            try:
                again, made = C.read_tokenized(changed)
            except C.CodecError:
                refused += 1
                continue
            assert again == raw and b"".join(raw[u.start : u.end] for u in made) == raw
    assert refused
    with pytest.raises(C.CodecError):
        C.Reader(b"\x80\x00").number()


def choices_of(found):
    out = []
    for u in found:
        own = [lattice.Choice(tuple(u.cuts), u.status, 1, np.float32(0.25), True)]
        if u.end - u.start > 2 and u.status == units.UNKNOWN:
            own.append(lattice.Choice((u.start + 1,), units.MORPHOLOGICAL, 2, np.float32(-1.5), False))
        out.append(own)
    return out


def test_lattice_and_sidecar():
    raw = "koyun çocuk UNIQUE_8731 geldi mi?".encode()
    found = units.units_of(raw)
    made = choices_of(found)
    again, read, back = C.read_lattice(C.write_lattice(raw, found, made))
    assert again == raw and back == made and [u.group for u in read] == [u.group for u in found]
    blob = C.write_sidecar(raw, found, made)
    many = units.units_of(raw * 64)
    assert b"UNIQUE" not in blob and len(C.write_sidecar(raw * 64, many, [c[:1] for c in choices_of(many)])) < 2 * len(raw) * 64
    read, back = C.read_sidecar(raw, blob)
    for policy, seed in (("best", 0), ("uniform", 1), ("uniform", 91), ("weighted", 2026)):
        assert lattice.draw(back, policy, seed) == lattice.draw(made, policy, seed)
    assert [u.group for u in read] == [u.group for u in found]
    with pytest.raises(C.CodecError):
        C.read_sidecar(raw + b"x", blob)
    found[0].group = 5
    with pytest.raises(C.CodecError):
        C.write_sidecar(raw, found, made)


def test_vocabularies():
    chars = V.CharVocabulary(tuple(sorted("abcçğ🙂")))
    surfaces = V.SurfaceVocabulary((b"the", b"\xff\x00", b" a"))
    generation = V.assemble_generation(list("ab"), [("<morph:61:62>", b"b")], [("<root:61:61>", b"a")], [b"fn"])
    assert C.read_chars(C.write_chars(chars)) == chars and C.read_surfaces(C.write_surfaces(surfaces)) == surfaces
    assert C.read_generation(C.write_generation(generation)) == generation
    with pytest.raises(C.CodecError):
        C.read_surfaces(C.seal(C.SURFACES, C.varint(2) + b"\x01a\x01a"))
    with pytest.raises(C.CodecError):
        C.read_chars(C.seal(C.CHARS, b"\x02ba"))
    one = C.fingerprint(units.Config(), chars, generation)
    assert one == C.fingerprint(units.Config(), chars, generation) != C.fingerprint(units.Config(mode="code"), chars, generation)
