"""Kernels on hand-made inputs, without Spark."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.functions import lexical
from loomspan.functions import lexical as L
from loomspan.functions import turkish as T
from loomspan.operators import code, encode, lattice, programs, quality, scan, units
from loomspan.operators import vocab as V


def spans(data):
    raw = data.encode() if isinstance(data, str) else data
    return [(raw[s:e], k) for s, e, k in scan.scan_spans(raw)]


def auto(data):
    raw = data.encode() if isinstance(data, str) else data
    return code.code_spans(raw, *scan.scan_with_hints(raw)[1])


@given(st.binary(max_size=300))
@settings(max_examples=300, deadline=None)
def test_scan_covers_any_bytes(raw):
    found = scan.scan_spans(raw)
    assert b"".join(raw[s:e] for s, e, _ in found) == raw
    assert all(s < e for s, e, _ in found) and all(a[1] == b[0] for a, b in zip(found, found[1:]))


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("26.07.2026 3,1415", [L.NUMBER, L.WHITESPACE, L.NUMBER]),
        ("2026'da 3'üncü", [L.NUMBER, L.WHITESPACE, L.NUMBER]),
        ("Ankara'da İstanbul’daydı", [L.WORD, L.WHITESPACE, L.WORD]),
        (b"A\xff\xfe \xc4\xb0", [L.WORD, L.OPAQUE, L.WHITESPACE, L.WORD]),
        ("2XX", [L.NUMBER, L.WORD]),
        ("«a»", [L.SYMBOL, L.WORD, L.SYMBOL]),
        ("\x00\x1b", [L.CONTROL]),
        ("👩‍👩", [L.SYMBOL]),
        ("a\r\n\rb", [L.WORD, L.LINE_BREAK, L.WORD]),
    ],
)
def test_scan_kinds(text, kinds):
    assert [k for _, k in spans(text)] == kinds


def test_scan_operators():
    assert [d for d, k in spans("a != b && c::d -> e") if k == L.SYMBOL] == [b"!=", b"&&", b"::", b"->"]
    assert [d for d, _ in spans("x === y>>=z")] == [b"x", b" ", b"===", b" ", b"y", b">>=", b"z"]


def test_class_table():
    table = L.class_table()
    assert [table[ord(c)] for c in "aĞ1²Ⅷ _-§…\u00a0\u2028\u0085\u0301"] == [
        L.WORD, L.WORD, L.NUMBER, L.NUMBER, L.NUMBER, L.WHITESPACE, L.WORD, L.PUNCTUATION, L.SYMBOL, L.PUNCTUATION, L.WHITESPACE, L.LINE_BREAK, L.LINE_BREAK, L.WORD,
    ]


def test_hints():
    assert scan.scan_with_hints(b"a" * 800 + b"\nfn main() {}")[1][0]
    assert scan.scan_with_hints(b"a" * 800 + b'\n&lt;SyncML version="1.2"&gt;\n')[1][0]
    assert scan.scan_with_hints("Bugün hava çok güzel, dışarı çıktık.".encode())[1] == (False, False, False)
    assert scan.scan_with_hints(b"[a.b]\nx")[1][0] and scan.scan_with_hints(b'"key": 1')[1][0]
    assert scan.scan_with_hints(b"see `x`")[1][2] and scan.scan_with_hints(b"a@b.co")[1][1]


def test_artifacts():
    text = b"mail a@b.co https://x.y/z?q=1 request_id=abc-123 2024-01-02T03:04:05+03:00 0xDEAD_BEEF 1e-9 3.14f64"
    assert [text[s:e] for s, e in auto(text)] == text.split(b" ")[1:]
    assert auto("Fiyat 12,50 lira (yaklaşık) idi.") == []


def test_fences():
    text = "metin `x += 1` ve ```rust\nx\n``` son".encode()
    assert [text[s:e] for s, e in code.fenced_spans(text)] == [b"`x += 1`", b"```rust\nx\n```"]
    assert code.fenced_spans(b"a ` b") == [] and code.fenced_spans(b"``a``") == [(0, 2), (3, 5)]


@pytest.mark.parametrize(
    "text",
    [
        "x = value\nprint(x)\n",
        "foo_bar += 42\n",
        "#!/bin/sh\necho hello\nplain words here\n",
        'def f(x):\n    return x + 1\n\nclass A:\n    pass\n',
        "const x = 1;\nfunction f() {\n  return x;\n}\n",
        '{\n  "a": 1,\n  "b": [2, 3]\n}\n',
        '[section]\nname = "x"\nsize = 3\n',
        "SELECT a, b FROM t WHERE a = 1;\n",
        "<html>\n<body>\n</body>\n</html>\n",
    ],
)
def test_whole_code(text):
    assert auto(text) == [(0, len(text))]


@pytest.mark.parametrize("text", ["Bu bir cümledir ve kod değildir.\n", "f(x) = x + 1 olsun.\n", "- elma\n- armut\n", "Not: (1) oku, (2) yaz.\n", "&lt;br&gt;Türkçe açıklama."])
def test_prose_is_not_code(text):
    assert auto(text) == []


def test_block_inside_prose():
    text = "Merhaba dünya, bu bir metindir.\nfn main() {\n    let x = 1;\n    run(x);\n}\nSon cümle burada bitiyor.\n".encode()
    (begin, end), = auto(text)
    assert text[begin:end] == b"fn main() {\n    let x = 1;\n    run(x);\n}\n"


def test_identifier_cuts():
    assert code.identifier_cuts("parseHttpRequest2XX") == [5, 9, 16, 17]
    assert code.identifier_cuts("parse_http-header") == [5, 6, 10, 11]
    assert code.identifier_cuts("simple") == []


def units_of(text, **config):
    raw = text.encode() if isinstance(text, str) else text
    return raw, units.units_of(raw, units.Config(**config))


def test_units():
    raw, found = units_of("(. ... !?", mode="turkish")
    assert sum(u.kind == L.PUNCTUATION for u in found) == 7
    assert len(units_of("?.")[1]) == 2
    assert [u.status for u in units_of("?.", mode="code")[1]] == [units.CODED]
    _, found = units_of("q" * 65, mode="turkish")
    assert [u.end - u.start for u in found] == [48, 17] and all(u.status == units.UNKNOWN for u in found)
    _, (clock,) = units_of("14:30:05'te")
    assert clock.status == units.MORPHOLOGICAL and [m.surface for m in clock.analysis.morphemes] == ["14:30:05", "te"] and clock.cuts == [2, 3, 5, 6, 8, 9]
    _, found = units_of("geliyor mu?")
    assert [u.group for u in found] == [0, 0, 0, 1]
    assert all(u.mode == units.CODE for u in units_of("foo_bar += 42")[1])
    assert any(u.mode == units.TURKISH for u in units_of("foo_bar += 42", detect_unmarked_code=False)[1])
    with pytest.raises(ValueError):
        units.Config(max_fallback_chars=0)


@given(st.binary(max_size=200), st.sampled_from(["auto", "turkish", "code"]))
@settings(max_examples=200, deadline=None)
def test_units_cover_any_bytes(raw, mode):
    found = units.units_of(raw, units.Config(mode=mode, max_fallback_chars=5))
    assert b"".join(raw[u.start : u.end] for u in found) == raw
    for unit in found:
        assert all(unit.start < c < unit.end for c in unit.cuts) and unit.cuts == sorted(set(unit.cuts))
        assert (unit.mode == units.BYTES) == (unit.kind in (L.CONTROL, L.OPAQUE))


def test_fallback_analyses():
    assert quality.composed("g\u0306eldi").text == "ğeldi"
    trimmed = quality.without_emphasis("tamamdırrr")
    assert trimmed.text == "tamamdır" and trimmed.original(len("tamamdır".encode())) == len("tamamdırrr".encode())
    known = lambda w: [quality.Analysis("ev_Noun", "ev", "Noun", "None", (quality.Morpheme("ev", "ev"), quality.Morpheme("A3pl", "ler")), (2,))] if w == "evler" else []
    assert quality.analyses("evler", known)[0].cuts == (2,)
    assert quality.analyses("evlerrrr", known)[0].dictionary_id == "SYN_Emphasis_Fallback"
    attached = quality.analyses("evlermi", known)[0]
    assert attached.dictionary_id == "SYN_QuestionAttached_Fallback" and attached.cuts == (2, 5)
    assert quality.analyses("xyz", known)[0].unknown and quality.analyses("ş")[0].secondary_pos == "Abbrv"
    low = lambda w: [quality.Analysis("x", w, "Noun", "None", (quality.Morpheme("x", w),))] if w == "çocuk" else []
    assert [a.dictionary_id for a in quality.shadow_analyses("COCUK", low)] == ["SYN_ShadowDeasciify_Fallback"]


def test_encoders():
    chars = V.CharVocabulary(("a", "b", "c"))
    unit = lambda s, e, mode=1, cuts=(), kind=L.WORD: units.Unit(s, e, kind, mode, 1, None, list(cuts))
    assert encode.encode_units(chars, b"abc", [unit(0, 3, cuts=[1])], True) == ([1, 3, 263, 4, 264, 265, 17, 2], [0, 0, 1, 0, 1, 1, 1, 0])
    mixed = encode.encode_units(chars, b"abc", [unit(0, 1, 2), unit(1, 2), unit(2, 3, 2)])
    assert mixed == ([1, 5, 3, 263, 6, 3, 264, 5, 3, 265, 6, 2], [0, 0, 0, 1, 0, 0, 1, 0, 0, 1, 0, 0])
    assert encode.encode_units(V.CharVocabulary(("ç",)), "ç🙂".encode(), [unit(0, 6)])[1] == [0, 0, 2, 1, 1, 1, 1, 0]
    assert encode.encode_units(V.CharVocabulary(("a",)), b"\xffa", [unit(0, 1, 3, kind=L.OPAQUE), unit(1, 2)])[0] == [1, 3, 262, 3, 263, 2]
    plain = encode.encode_units(chars, b"ab", [unit(0, 2, 2, [1])], marks=encode.Boundaries(False, False, False))
    assert plain == ([1, 263, 264, 2], [0, 1, 1, 0])
    assert encode.encode_bytes(b"\x00\xff", True) == ([1, 7, 262, 17, 2], [0, 1, 1, 1, 0])
    none = V.SurfaceVocabulary(())
    assert encode.encode_surface(none, b"\x00\xff", [unit(0, 2, 3)])[0] == [1, 3, 258, 2]
    with pytest.raises(ValueError):
        none.decode([259])


@given(st.lists(st.sampled_from([b"a", b"ab", b"abc", b"b ", b"\xff", b" "]), unique=True), st.binary(max_size=60))
def test_surface_round_trip(pieces, raw):
    vocabulary = V.SurfaceVocabulary(tuple(pieces))
    ids, lengths = encode.encode_surface(vocabulary, raw, units.units_of(raw))
    assert vocabulary.decode(ids) == raw and sum(lengths) == len(raw)


GENERATION = V.assemble_generation(list("abcdefgh "), [], [], [b"parse", b"Http", b"_"])


@pytest.mark.parametrize("text", ["a  b\r\n c\td e", "```python\nparseHttpRequest2XX_ = 1\n``` son", "🙂 ÿ 12345 x12", "", "   \n", "a\xa0b c", "x` y"])
def test_generation_round_trip(text):
    ids = encode.encode_generation(GENERATION, text.encode(), units.units_of(text.encode()))
    assert encode.decode_generation(GENERATION, ids) == text.encode()


@given(st.binary(max_size=120))
@settings(max_examples=200, deadline=None)
def test_generation_round_trip_of_any_bytes(raw):
    assert encode.decode_generation(GENERATION, encode.encode_generation(GENERATION, raw, units.units_of(raw))) == raw


def test_generation_errors():
    for ids in ([V.G_SPACES_END], [V.G_SPACES], [V.G_SPACES, V.G_SPACES_END], [60_000]):
        with pytest.raises(ValueError):
            encode.decode_generation(GENERATION, ids)


def test_input_encoding():
    raw = "geliyor mu?".encode()
    made = encode.encode_input(V.CharVocabulary(()), raw, units.units_of(raw))
    assert made["pool_spans"] == [(0, 10), (10, 11)] and made["segment_offsets"] == [0, 13, 15] and made["pool_group_ids"] == [0, 1]


def test_digit_atoms():
    assert encode.digit_atoms("1234567") == ["1", "234", "567"] and encode.digit_atoms("012") == ["012"] and encode.digit_atoms("") == []


def test_lattice():
    found = lattice.collapse([((1,), 2, 0.5), ((2,), 2, 1.0), ((1,), 2, 0.25)], 1)
    assert [(c.cuts, c.count, c.selected) for c in found] == [((2,), 1, True), ((1,), 2, False)]
    assert found[1].score == pytest.approx(np.log(np.exp(0.5) + np.exp(0.25)), rel=1e-6)
    one = [lattice.Choice((), 2, 1, np.float32(0), True)]
    assert lattice.draw([one, found, one, found], "best") == [0, 0, 0, 0]
    drawn = lattice.draw([one, found, one, found], "uniform", 9)
    assert drawn == [0, lattice.splitmix(9, 1) % 2, 0, lattice.splitmix(9, 2) % 2]
    assert lattice.splitmix(0, 1) == 0xE220A8397B1DCDAF
    cold = [lattice.draw([found], "weighted", s, 0.01)[0] for s in range(30)]
    assert set(cold) == {int(np.argmax([c.score for c in found]))}
    with pytest.raises(ValueError):
        lattice.draw([found], "weighted", 1, 0.0)


def test_turkish():
    assert T.turkish_lower("IİŞ") == "ıiş" and T.turkish_capital("istanbul") == "İstanbul"
    assert (T.java_hash("abc"), T.rehash(96354), T.mphf_hash("abc")) == (96354, 201612502, 440920331)
    assert (T.a_vowel("ev"), T.i_vowel("okul"), T.i_vowel("göz"), T.a_vowel("kitap")) == ("e", "u", "ü", "a")
    assert [T.from_roman(x) for x in ("IX", "MCMXC", "IIII", "")] == [9, 1990, None, None]
    assert T.numeral_classes("14.30") == ["real", "clock"] and T.numeral_classes("23.07.2026") == ["distribution", "date"] or "date" in T.numeral_classes("23.07.2026")
    assert [T.dotted_abbreviation(x) for x in (".", "...", "T.B.M.M.", "A.B.D.'nin")] == [False, False, True, True]


_PROGRAM_TEXTS = st.lists(st.sampled_from(list("aIiıbZ çé'’-.,;:!?… \n\r\t0159½٣@#\"`=(<_\\/️‍🙂g̃ầ\x01\x85 ") + ["mi ", " de", " da.", "http", "3f", "14:30'te", "for "]), max_size=60).map("".join)


@given(st.lists(st.one_of(_PROGRAM_TEXTS.map(str.encode), st.binary(max_size=20)), max_size=5), st.sampled_from(["auto", "turkish"]), st.sampled_from([3, 48]))
@settings(max_examples=300, deadline=None)
def test_programs_are_the_units(raws, mode, most):
    """Documents put together from surfaces are those tokenised one by one."""
    config = units.Config(mode=mode, max_fallback_chars=most)
    table = programs.Programs(config)
    tokens = [table.tokens(r) for r in raws]
    raws, tokens = [r for r, t in zip(raws, tokens) if t is not None], [t for t in tokens if t is not None]
    if not tokens:
        return
    columns = [c.to_pylist() for c in programs.arrow_columns(table.flat(table.of(tokens), np.array([len(t) for t in tokens])))]
    for k, raw in enumerate(raws):
        wanted = units.units_of(raw, config)
        found = list(zip(*(c[k] for c in columns)))
        assert found == [(u.start, u.end, u.kind, u.mode, u.status, u.group, u.cuts) for u in wanted]


@given(_PROGRAM_TEXTS)
@settings(max_examples=300, deadline=None)
def test_quiet_texts_have_no_hints(text):
    if not programs.loud().search(text):
        assert scan.scan_with_hints(text.encode())[1] == (False, False, False)
    assert lexical.token_grammar().findall(text) == [text.encode()[b:e].decode() for b, e, _ in scan.scan_spans(text.encode())]
