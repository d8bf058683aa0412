"""Findings of reviews: each test failed on the code before."""

from __future__ import annotations

import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan import plans
from loomspan.functions import lexical
from loomspan.operators import code, encode, hints, programs, scan, units
from loomspan.operators import vocab as V

SMALL = "/root/testdata/sf0.001"
TEXTS = ["Oyun 3.14 mi? a.b\r\nx_y  de", "", None, "!!!", "\n\n", "é" * 60 + " çok\tgüzel. Ev mi, ev de!", "the 1/2-3 und . ! ?", " "]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents that are empty, null or without words, as a table."""
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(k, t, "en", "web", None) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


def _same(spark, folder, name):
    found = plans.QUERIES[name](spark, folder)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    columns = ", ".join(sorted(found.columns))
    wanted = connection.execute(f"SELECT {columns} FROM ({plans.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, found.select(*sorted(found.columns)).collect())) == sorted(wanted)


def test_training_tokens_of_odd_texts(spark, odd):
    _same(spark, odd, "training_tokens")


def test_training_encoding_spells_surfaces_once(spark, monkeypatch):
    """repeated words aren't analysed and spelled again."""
    spelled = []
    real = encode.spell_unit
    table = encode.programs.Programs(units.Config(mode="turkish"))
    held = encode._Surfaces(table, lambda data, cuts: spelled.append(data) or real(chars, data, cuts))
    chars = V.CharVocabulary(tuple("abc"))
    raw = b"abc 1.2 abd " * 50
    tokens = table.tokens(raw)
    ids, lengths = held.encoded(table.of([tokens]), encode.np.array([len(tokens)]), None)
    assert len(spelled) == len(set(spelled)) == 4
    assert (ids[0].as_py(), lengths[0].as_py()) == encode.encode_units(chars, raw, units.units_of(raw, units.Config(mode="turkish")))


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_coverage_of_odd_texts(spark, odd):
    _same(spark, odd, "coverage_violations")
    assert not any(n in _plan(plans.QUERIES["coverage_violations"](spark, odd)) for n in ("Generate", "Window", "Join"))


def test_unit_summary_of_odd_texts(spark, odd):
    _same(spark, odd, "unit_summary")


def test_surface_greedy_of_odd_texts(spark, odd):
    _same(spark, odd, "surface_greedy")


#: With code regions, controls and broken bytes.
MIXED = [*(None if t is None else t.encode() for t in TEXTS), b"a `code x` b\r\nfoo_bar += 42\nde da", b"Ev mi\x00 de\xff mi", b"<p>x(1);</p> ev\tde", b""]


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame([(k, None if d is None else bytearray(d)) for k, d in enumerate(MIXED)], "doc_id long, raw binary")


def test_unit_violations_of_odd_texts(spark, odd, mixed):
    _same(spark, odd, "unit_violations")
    found = {r["doc_id"]: (r["n_bytes"], r["n_wrong"]) for r in units.document_violations(mixed).collect()}
    assert found == {k: (len(d), 0) for k, d in enumerate(MIXED) if d is not None}


def test_flaws_are_found():
    made = [[units.Unit(0, 2, 3, 1, 3, cuts=[1]), units.Unit(2, 4, 3, 1, 3)], [], [units.Unit(0, 3, 3, 1, 3)]]
    flat = programs.flat_of(made)
    assert units.flaws(flat, np.array([4, 0, 3])).tolist() == [0, 0, 0]
    assert units.flaws(flat, np.array([5, 1, 3])).tolist() == [1, 1, 0]
    flat.start[1], flat.mode[2] = 3, units.CODE
    flat.cuts[0] = 2
    assert units.flaws(flat, np.array([5, 0, 3])).tolist() == [2, 0, 1]


def test_code_regions_are_the_units_in_code_mode(spark, mixed):
    for data in MIXED:
        if data is not None:
            wanted = code.merged([(u.start, u.end) for u in units.units_of(data) if u.mode == units.CODE])
            assert units.code_units(data) == wanted
    assert "Generate" not in _plan(plans.QUERIES["page_code_spans"](spark, SMALL))


def test_fences_without_an_end_take_linear_time():
    many = b" ".join(b"`" * n for n in range(3000, 3, -1))  # no run has another as long after it
    began = time.process_time()
    code.fenced_spans(many)
    assert time.process_time() - began < 2


def test_calls_in_a_long_line_take_linear_time():
    """each call copied the rest of its line, or looked through it for an end that isn't there."""
    for line, found in (("x(1) " * 200_000 + "y", False), (") " + "f(" * 500_000, False), ("x(1) " * 5 + "g(2)\x1f \u2003=> z", True), ("f(a)\u2003", True), ("f(a", False)):
        began = time.process_time()
        assert code.calls(line) == found
        assert time.process_time() - began < 4


def _batches(texts):
    return iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], names=["doc_id", "raw"])])


def test_character_kernel_is_bounded_and_the_same():
    texts = [*MIXED, "é€x🙂ü".encode(), b"\xf0\x9f", b"\x98\x80a", *[b"abc def " * 20_000] * 8]
    chars = V.CharVocabulary(tuple(sorted("abcé🙂 ")))
    for newline in (False, True):
        made = list(encode.encoded_batches(_batches(texts), encode.many_characters(chars), newline))
        assert len(made) > 1  # one batch of any size before
        table = pa.Table.from_batches(made)
        for k, ids, lengths in zip(*(table[c].to_pylist() for c in ("doc_id", "ids", "lengths"))):
            assert (ids, lengths) == ((None, None) if texts[k] is None else encode.encode_characters(chars, texts[k], newline))


def test_byte_kernel_is_bounded_and_the_same():
    texts = [*MIXED, *[b"abc def " * 20_000] * 8]
    for newline in (False, True):
        made = list(encode.encoded_batches(_batches(texts), encode.many_bytes, newline))
        assert len(made) > 1
        table = pa.Table.from_batches(made)
        for k, ids, lengths in zip(*(table[c].to_pylist() for c in ("doc_id", "ids", "lengths"))):
            assert (ids, lengths) == ((None, None) if texts[k] is None else encode.encode_bytes(texts[k], newline))


def test_byte_ids_are_counted_where_they_are_made(spark, odd):
    """lists of all ids went to the JVM to be counted, and a long document's were held at once."""
    asked = []
    run = lambda values: asked.append(sum(map(len, values))) or encode.many_bytes(values)
    texts = [*MIXED, b"abc def " * 400_000, None, b"", *[b"ab" * 90_000] * 8, b"x" * scan.BATCH_BYTES]
    for newline in (False, True):
        rows = pa.Table.from_batches(list(encode.counted_batches(_batches(texts), run, newline))).to_pylist()
        wanted = [(None, None) if t is None else (len(t) + 2 + newline, len(t) + newline) for t in texts]
        assert [(r["n_ids"], r["n_bytes"]) for r in rows] == wanted and [r["doc_id"] for r in rows] == list(range(len(texts)))
        for r in rows[: len(MIXED)]:
            if texts[r["doc_id"]] is not None:
                ids, lengths = encode.encode_bytes(texts[r["doc_id"]], newline)
                assert (r["n_ids"], r["n_bytes"]) == (len(ids), sum(lengths))
    assert max(asked) <= scan.BATCH_BYTES
    assert "aggregate(" not in _plan(plans.QUERIES["byte_token_counts"](spark, odd))
    _same(spark, odd, "byte_token_counts")


def test_character_ids_are_counted_where_they_are_made(spark, odd, monkeypatch):
    """character_tokens shares its step; slices cut no character."""
    texts = [*MIXED, "aé€🙂b".encode() * 9, b"\x80" * 30 + b"\xe2\x82A\xf0\x9f" * 9, "🙂".encode() * 12, b"\xf0" * 9 + b"\xc3"]
    chars = V.CharVocabulary(tuple(sorted("abcé🙂 ")))
    for most in (scan.BATCH_BYTES, 4, 5, 7):
        monkeypatch.setattr(encode, "BATCH_BYTES", most)
        for newline in (False, True):
            rows = pa.Table.from_batches(list(encode.counted_batches(_batches(texts), encode.many_characters(chars), newline))).to_pylist()
            made = [(None, None) if t is None else encode.encode_characters(chars, t, newline) for t in texts]
            assert [(r["n_ids"], r["n_bytes"]) for r in rows] == [(None, None) if ids is None else (len(ids), sum(lengths)) for ids, lengths in made]
    assert "aggregate(" not in _plan(plans.QUERIES["character_tokens"](spark, odd))
    _same(spark, odd, "character_tokens")


def test_clitics_are_counted_where_they_are_made(spark, mixed, odd):
    made = units.tokenize(mixed, surfaces=True).where(F.col("group_id").isNotNull() & (F.col("kind") != 1))
    first = made.groupBy("doc_id", "group_id").agg(F.min("unit_idx").alias("h"))
    rows = made.join(first, ["doc_id", "group_id"]).where("unit_idx > h").groupBy(F.lower(F.decode("surface", "UTF-8")).alias("clitic")).count()
    wanted = sorted(map(tuple, rows.collect()))
    assert wanted and sorted(map(tuple, units.joined_clitics(mixed).collect())) == wanted
    assert not any(n in _plan(plans.QUERIES["clitic_tokens"](spark, odd)) for n in ("Generate", "Join"))
    _same(spark, odd, "clitic_tokens")


def test_group_sizes_are_counted_where_they_are_made(spark, mixed, odd):
    rows = units.tokenize(mixed).where("group_id IS NOT NULL").groupBy("doc_id", "group_id").agg(F.count("*").alias("n_units")).groupBy("doc_id", "n_units").count()
    assert sorted(map(tuple, units.group_sizes(mixed).collect())) == sorted(map(tuple, rows.collect()))
    assert not any(n in _plan(plans.QUERIES["clitic_groups"](spark, odd)) for n in ("Generate", "Aggregate"))
    _same(spark, odd, "clitic_groups")


def test_segments_are_counted_where_they_are_made(spark, mixed, odd):
    rows = units.segment_ids(units.tokenize(mixed, surfaces=True)).groupBy("doc_id", "seg_id").count()
    assert sorted(map(tuple, units.segment_sizes(mixed).collect())) == sorted(map(tuple, rows.collect()))
    assert not any(n in _plan(plans.QUERIES["sentence_segments"](spark, odd)) for n in ("Generate", "Window"))
    _same(spark, odd, "sentence_segments")


def test_widths_are_counted_where_they_are_made(spark, mixed, odd):
    config = units.Config(max_fallback_chars=8)
    rows = units.tokenize(mixed, config, surfaces=True).where((F.col("kind") == 3) & (F.col("status") == units.UNKNOWN))
    rows = rows.groupBy(F.length(F.decode("surface", "UTF-8")).alias("width")).count()
    assert sorted(map(tuple, units.unknown_widths(mixed, config).collect())) == sorted(map(tuple, rows.collect()))
    assert "Generate" not in _plan(plans.QUERIES["fallback_chunks"](spark, odd))
    _same(spark, odd, "fallback_chunks")


def test_scans_are_compared_without_a_join(spark, odd):
    assert "Join" not in _plan(plans.QUERIES["scan_parity"](spark, odd))
    _same(spark, odd, "scan_parity")
    rows = spark.createDataFrame([(bytearray(b"ab c"), [2, 1, 1]), (bytearray(b"ab c"), [2, 2]), (bytearray(b"ab"), [1, 1]), (None, None)], "raw binary, sizes array<int>")
    assert [sum(c) for c in zip(*scan.differing(rows).collect())] == [4, 10, 2]


def test_scan_makes_no_match_for_each_token(monkeypatch):
    """a match object for each token took most of the time of a scan."""
    raw = ("Ev-mi 3.14'te, de! a->b (x_y) ?. ‘é’ \r\n\n 中文 x='1' " * 50).encode() + b"\xff\x00 .?."
    text = raw.decode("utf-8", "surrogateescape")
    wanted = [(len(text[: m.end()].encode("utf-8", "surrogateescape")), lexical.GROUP_KINDS[m.lastindex]) for m in lexical.grammar().finditer(text)]
    matched, real = [], lexical.grammar()

    class Counted:
        def __getattr__(self, name):
            return lambda *a: matched.append(name) or getattr(real, name)(*a)

    monkeypatch.setattr(lexical, "grammar", Counted)
    scan.token_kind.cache_clear()
    assert list(zip(*scan.scan_bytes(raw))) == wanted and scan.scan_ends(raw).tolist() == [end for end, _ in wanted]
    assert "finditer" not in matched and len(matched) < 40


def test_pieces_without_signs_are_not_tried(monkeypatch):
    tried = []
    monkeypatch.setattr(code, "_ARTIFACTS", (("any", lambda piece: tried.append(piece)),))
    code.named_artifacts(b"plain (words) wow. ww.x; a_b x=1 www.a.b c@d 7 e:f `id=5`")
    assert tried == [b"a_b", b"x=1", b"www.a.b", b"c@d", b"7", b"e:f", b"id=5"]


def test_artifacts_of_a_kind_are_all_of_that_kind(spark, tmp_path):
    """all kinds were tried on each piece of every text, and what is a URL too was left out of other kinds."""
    texts = ["see www.a_b=1, www.site=2 and (www.c@d.org) id=3", "www.long.name.org/x=1 a.b=c== x=1", "no sign in here 42", "", None, "=", "_=x `key=1` url==2 (path=/a)"]
    rows = [(k, t, "en", "web", None) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("inline_assignments", "email_tokens", "programming_numbers"):
        _same(spark, str(tmp_path), name)


def test_only_the_tests_of_a_kind_are_made(monkeypatch):
    tried = []
    monkeypatch.setattr(code, "_ARTIFACTS", tuple((n, lambda piece, n=n: tried.append((n, piece))) for n in ("url", "email", "assignment")))
    assert not list(code.artifacts_of("assignment", b"12 a@b.c www.a.b x_y")) and not tried
    assert not list(code.artifacts_of("assignment", b"a_b=1 plain")) and tried == [("assignment", b"a_b=1")]


def test_rows_of_a_long_document_are_handed_on(monkeypatch):
    monkeypatch.setattr(code, "MOST_ROWS", 10)
    texts = [b"", None, b"a_b=1 x " * 25, b"id=2"]
    made = list(code.row_batches(_batches(texts), lambda d: code.artifacts_of("assignment", d), ["start", "end", "kind"], [pa.int64(), pa.int64(), pa.string()]))
    assert [b.num_rows for b in made] == [10, 10, 6]
    assert pa.Table.from_batches(made)["doc_id"].to_pylist() == [2] * 25 + [3]


def test_runs_of_ids_are_bounded():
    ids = pa.array([[3 + k % 256 for k in range(100_000)]] * 20 + [None, []], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(22)), ids], names=["doc_id", "ids"])
    runs = list(scan.batches_by_size(iter([batch]), 1))
    assert len(runs) > 2 and pa.Table.from_batches(runs).equals(pa.Table.from_batches([batch]))
    vocabulary = V.SurfaceVocabulary((b"x", b"yz"))
    assert vocabulary.decode(encode.np.array([1, 3 + 97, 260, 2], "int32")) == b"ayz"
    for wrong in ([-1], [261]):
        with pytest.raises(ValueError):
            vocabulary.decode(wrong)


def test_known_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(programs, "MOST_KNOWN", 10)
    raw, known = b" ".join(b"w%dx" % k for k in range(100)), {}
    encode.encode_surface(V.SurfaceVocabulary((b"w",)), raw, units.units_of(raw), known=known)
    assert len(known) == 10 and programs.bounded({k: k for k in range(11)}) == {}


def test_pieces_are_handed_on_before_they_are_many(monkeypatch):
    texts = [b"w%dx 1.%d y" % (k, k) for k in range(60)]
    batches = lambda: iter([pa.RecordBatch.from_arrays([pa.array([t], pa.binary())], names=["raw"]) for t in texts])
    total = lambda made: pa.Table.from_batches(made).group_by("piece").aggregate([("weight", "sum")]).sort_by("piece").to_pylist()
    whole = list(V.weigh(batches()))
    monkeypatch.setattr(programs, "MOST_KNOWN", 10)
    monkeypatch.setattr(programs, "MOST_SURFACES", 20)
    parts = list(V.weigh(batches()))
    assert len(whole) == 1 and len(parts) > 3 and max(b.num_rows for b in parts) < 60 and total(parts) == total(whole)


def test_only_loud_lines_are_watched(monkeypatch):
    """one sign made a scan watch every token of its document, and signs in the midst of a line or in longer runs were taken for others."""
    seen, real = [], hints.HintTracker.observe
    monkeypatch.setattr(hints.HintTracker, "observe", lambda self, kind, data: seen.append(data) or real(self, kind, data))
    text = "Words&&& of### a| \"line\" [and] <more> ||| !&\n" * 50
    table = programs.Programs(units.Config())
    assert table.tokens(text.encode()) == lexical.token_grammar().findall(text) and not seen
    assert table.tokens((text + "so x = 1\n" + text).encode()) and len(seen) < 10
    assert table.tokens((text + "let x = f(1);\n" + text).encode()) is None and len(seen) < 20


@given(st.lists(st.sampled_from(list("aI9b é'-.,;:!?\n\r\t@#\"`=(<_/>)&|[]{}$\x85 ") + ["\n#", "\n&", "\n\"", "http", "3f", "0x1", "2T12", "let ", "lt;", "&&", "||", "]]", "::", "->", "ab.cd("]), max_size=14).map("".join))
@settings(max_examples=500, deadline=None)
def test_hints_of_loud_lines_are_those_of_the_scan(text):
    wanted = scan.scan_with_hints(text.encode())[1]
    assert programs.hints(text) in ((wanted, (True, True, "`" in text)) if wanted[0] else (wanted,))


def test_plain_words_are_weighed_as_they_are(monkeypatch):
    """each distinct word was put into the table of surfaces to be weighed."""
    put, real = [], programs.Programs.look_up
    monkeypatch.setattr(programs.Programs, "look_up", lambda self, tokens: put.extend(tokens) or real(self, tokens))
    batch = pa.RecordBatch.from_arrays([pa.array(["çok güzel 1.5, çok a".encode() + b" \xff"], pa.binary())], names=["raw"])
    found = {k: dict(zip(b[0].to_pylist(), b[1].to_pylist())) for k, b in ((k, list(V.weigh(iter([batch]), kinds=k))[0]) for k in (None, frozenset((lexical.NUMBER,))))}
    assert sorted(set(put)) == sorted([" ", "1.5", ",", "a", "\udcff"])
    assert found[None] == {"çok".encode(): 10, "güzel".encode(): 5, b" ": 25, b"1.5": 1, b"1": 4, b".": 4, b"5": 4, b",": 5, b"a": 5, b"\xff": 5}
    assert found[frozenset((lexical.NUMBER,))] == {b"1.5": 1, b"1": 4, b".": 4, b"5": 4}


def test_longest_matches_try_lengths_that_there_are():
    """every length up to the longest was tried at each place."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        pieces = tuple({bytes(rng.choice(list(b"ab\xff"), rng.integers(1, 7)).tolist()) for _ in range(rng.integers(0, 9))})
        vocabulary, data = V.SurfaceVocabulary(pieces), bytes(rng.choice(list(b"ab\xffc"), 40).tolist())
        at, wanted = 0, []
        while at < len(data):
            best = max((p for p in pieces if data.startswith(p, at)), key=len, default=None)
            wanted.append((V.SURFACE_BYTES + data[at], 1) if best is None else (vocabulary.ids[best], len(best)))
            at += wanted[-1][1]
        assert list(zip(*vocabulary.greedy(data))) == wanted
    tried = []

    class Counted(dict):
        def get(self, *key):
            tried.append(key)
            return super().get(*key)

    vocabulary = V.SurfaceVocabulary((b"xy" * 40, b"xy"))
    object.__setattr__(vocabulary, "ids", Counted(vocabulary.ids))
    assert vocabulary.greedy(b"z" * 50 + b"xy")[0] == [V.SURFACE_BYTES + 122] * 50 + [V.SURFACE_FIRST + 1] and len(tried) < 60
