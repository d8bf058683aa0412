"""Operators as Spark tables: against kernels, against SQL, on streams."""

from __future__ import annotations

import collections
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from loomspan import api, plans, sources, streaming
from loomspan.functions import lexical as L
from loomspan.operators import encode, lattice, scan, units
from loomspan.operators import vocab as V
from loomspan.sources import codecs
from loomspan.plans.sample import bundle, weight

SMALL = "/root/testdata/sf0.001"
TEXTS = ["Oyun evlerin oyunlu, kitaplar geldi mi? 26.07.2026", "a `code x` b\r\nfoo_bar += 42\n", "", "🙂 çok  güzel\tde", "qwx" * 40, None]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, None if t is None else bytearray(t.encode())) for k, t in enumerate(TEXTS)]
    rows += [(90, bytearray(range(256))), (91, bytearray(b"abc\xffdef \x00"))]
    return spark.createDataFrame(rows, "doc_id long, raw binary")


def raws(docs):
    return {r["doc_id"]: bytes(r["raw"]) for r in docs.collect() if r["raw"] is not None}


def test_lex_table_is_the_kernel(docs):
    found = collections.defaultdict(list)
    for r in scan.lex(docs).orderBy("doc_id", "lex_idx").collect():
        found[r["doc_id"]].append((r["start"], r["end"], r["kind"]))
    assert dict(found) == {d: s for d, s in ((d, scan.scan_spans(x)) for d, x in raws(docs).items()) if s}
    assert scan.coverage_violations(scan.lex(docs), docs.where("raw IS NOT NULL")).count() == 0


def test_native_scan_is_the_kernel(spark):
    texts = [t for t in TEXTS if t] + ["«x» ¿y? a.b—c … ‘d’ 3'üncü e‑f 1٫5 ²Ⅷ \u0085  ‍☃‍☃ a==b ===c ?. <<= x́", "İstanbul’daydı 2XX _a-b-", "".join(c for c in map(chr, [*range(1, 0x250), *range(0x2000, 0x2100)]) if unicodedata.category(c) != "Cn")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in scan.lex_native(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("s")).collect():
        assert [tuple(x) for x in r["s"]] == scan.scan_spans(texts[r["doc_id"]].encode()), texts[r["doc_id"]]
    only = docs.select("doc_id", scan.words_native(F.col("text")).alias("w"), scan.signs_native(F.col("text")).alias("s"))
    only = only.withColumn("n", F.transform("w", scan.is_number))
    for r in only.collect():
        raw = texts[r["doc_id"]].encode()
        spans = [(raw[b:e].decode(), k) for b, e, k in scan.scan_spans(raw)]
        assert list(zip(r["w"], r["n"])) == [(t, k == L.NUMBER) for t, k in spans if k in (L.WORD, L.NUMBER)]
        assert r["s"] == [c for t, k in spans if k in (L.PUNCTUATION, L.SYMBOL) for c in t]


def test_units_do_not_depend_on_partitions(docs):
    made = [sorted(map(tuple, units.tokenize(docs.repartition(n)).select("doc_id", "unit_idx", "start", "end", "status", "group_id").collect()), key=repr) for n in (1, 2, 8)]
    assert made[0] == made[1] == made[2]
    assert units.violations(units.tokenize(docs), docs.where("raw IS NOT NULL")).count() == 0


def test_segments_by_windows(docs):
    found = units.tokenize(docs, surfaces=True)
    by = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in units.segment_ids(found, 3).orderBy("unit_idx").collect():
        by[r["doc_id"]][r["seg_id"], r["seg_part"]].append(r["unit_idx"])
    for doc, raw in raws(docs).items():
        wanted = units.segments(raw, units.units_of(raw), 3)
        assert [v for _, v in sorted(by[doc].items())] == wanted


def test_pieces(docs):
    joined = units.pieces(units.tokenize(docs)).join(docs, "doc_id").orderBy("doc_id", "unit_idx", "piece_idx")
    back = collections.defaultdict(bytes)
    for r in joined.collect():
        back[r["doc_id"]] += bytes(r["raw"][r["start"] : r["end"]])
    assert dict(back) == {d: x for d, x in raws(docs).items() if x}


def test_surface_tokenizer(docs):
    made = api.SurfaceTokenizer.train(docs, 300)
    assert 259 < len(made.vocabulary) <= 300
    again = {r["doc_id"]: bytes(r["raw"]) for r in made.decode_ids(made.encode_ids(docs)).collect() if r["raw"] is not None}
    assert again == raws(docs) and made.roundtrip(docs.where("raw IS NOT NULL"))
    for r in made.inspect(docs.where("doc_id < 4")).collect():
        raw = raws(docs)[r["doc_id"]]
        assert r["hex"] == raw[r["start"] : r["end"]].hex()
        if r["kind"] in ("byte", "learned"):
            unit = units.units_of(raw)[r["unit_idx"]]
            assert unit.start <= r["start"] < unit.end
    assert made.summary(docs).where("doc_id = 90").first()["n_bytes"] == 256


def test_weights_are_brute_force(docs):
    wanted = collections.Counter()
    for raw in raws(docs).values():
        for u in units.units_of(raw):
            edges = [u.start, *u.cuts, u.end]
            wanted[raw[u.start : u.end]] += 1
            for b, e in zip(edges, edges[1:]):
                wanted[raw[b:e]] += 4
    found = {bytes(r["piece"]): r["weight"] for r in V.piece_weights(units.tokenize(docs, surfaces=True)).collect()}
    assert found == {p: w for p, w in wanted.items() if len(p) <= 96}
    assert found == {bytes(r["piece"]): r["weight"] for r in V.observed_weights(docs).collect()}


def test_encodings(docs):
    chars = V.CharVocabulary(tuple(sorted("abcçeğ ")))
    by = {r["doc_id"]: (r["ids"], r["lengths"]) for r in encode.training_encoding(docs, chars, newline=True).collect()}
    assert by[5] == (None, None)
    for doc, raw in raws(docs).items():
        assert by[doc] == encode.encode_units(chars, raw, units.units_of(raw), True) and sum(by[doc][1]) == len(raw) + 1
    offsets = encode.document_offsets(docs.where("raw IS NOT NULL").select("doc_id", F.octet_length("raw").alias("n_ids")), parts=3).orderBy("doc_id").collect()
    at = 0
    for r in offsets:
        assert r["offset"] == at
        at += r["n_ids"]


def test_lattice_tokenizer(docs):
    from loomspan.operators.disambiguate import Disambiguator
    from loomspan.operators.morphology import Morphology

    made = api.LatticeTokenizer(provider=Morphology(bundle()), disambiguator=Disambiguator(weight))
    few = docs.where("doc_id < 4 OR doc_id = 91")
    blobs = {r["doc_id"]: bytes(r["blob"]) for r in made.lattices(few).collect()}
    sides = {r["doc_id"]: bytes(r["blob"]) for r in made.sidecars(few).collect()}
    several = 0
    for doc, raw in raws(few).items():
        again, _, choices = codecs.read_lattice(blobs[doc])
        assert again == raw and codecs.read_sidecar(raw, sides[doc])[1] is not None
        assert lattice.draw(codecs.read_sidecar(raw, sides[doc])[1], "uniform", 5) == lattice.draw(choices, "uniform", 5)
        several += sum(len(c) > 1 for c in choices)
    assert several  # "oyun" is a word and a word with a suffix
    print_one = made.train(few, 50, 10, 10)
    assert print_one == made.fingerprint()
    back = {r["doc_id"]: bytes(r["raw"]) for r in made.generation_decode(made.generation_ids(few)).collect()}
    assert back == raws(few)
    inputs = made.input_encoding(few).where("doc_id = 0").first()
    assert inputs["segment_offsets"][-1] == len(inputs["ids"]) and len(inputs["pool_spans"]) == len(inputs["pooled_segments"])
    sampled = made.sample(few, "weighted", 3, 0.7).collect()
    assert all(codecs.read_document(bytes(r["blob"]))[0] == raws(few)[r["doc_id"]] for r in sampled)


def test_unreadable_blobs(spark):
    blobs = spark.createDataFrame([(1, bytearray(b"nothing")), (2, None)], "doc_id long, blob binary")
    rows = api.Tokenizer().decode(blobs, strict=False).orderBy("doc_id").collect()
    assert rows[0]["error"] == "wrong magic" and rows[1]["error"] is None


def test_splitmix_column(spark):
    rows = spark.range(1, 200).select("id", *[lattice.splitmix_column(s, F.col("id")).alias(f"s{s}") for s in (0, 7, (1 << 64) - 3)]).collect()
    for r in rows:
        for s in (0, 7, (1 << 64) - 3):
            assert r[f"s{s}"] & ((1 << 64) - 1) == lattice.splitmix(s, r["id"])


def test_streams(spark, tmp_path):
    table = spark.read.parquet(f"{SMALL}/events.parquet").select("ts", F.col("event_type").alias("piece"), F.lit(2).alias("weight"))
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streaming.windowed_counts(stream, late="3650 days").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "a")).start()
    query.processAllAvailable()
    query.stop()
    batch = streaming.windowed_counts(table)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))
    query = streaming.running_weights(stream).writeStream.format("memory").queryName("weights").outputMode("update").option("checkpointLocation", str(tmp_path / "b")).start()
    query.processAllAvailable()
    query.stop()
    last = {r["piece"]: r["w"] for r in spark.table("weights").groupBy("piece").agg(F.max("weight").alias("w")).collect()}
    assert last == {r["piece"]: 2 * r["count"] for r in table.groupBy("piece").count().collect()}
    pieces = streaming.token_stream(spark.createDataFrame([("a b",)], "text string")).collect()
    assert [(r["piece"], r["kind"]) for r in pieces] == [("a", 3), (" ", 1), ("b", 3)]


def test_sources(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.bin").write_bytes(b"a\xff\n")
    assert bytes(sources.binary_documents(spark, str(tmp_path / "f")).first()["raw"]) == b"a\xff\n"
    (tmp_path / "j.json").write_text('{"doc_id": 1, "text": "é"}\n')
    assert bytes(sources.json_documents(spark, str(tmp_path / "j.json")).first()["raw"]) == "é".encode()
    docs = sources.parquet_documents(spark, f"{SMALL}/documents.parquet")
    assert docs.columns == ["doc_id", "raw"]
    sources.save_units(units.tokenize(docs.limit(3)), str(tmp_path / "u"))
    assert sources.units_json(spark.read.parquet(str(tmp_path / "u"))).count() == 3


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def _rows(names, rows):
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_queries(spark, oracle, name):
    found = plans.QUERIES[name](spark, SMALL)
    rows = found.collect()
    if name in plans.ORACLES:
        cursor = oracle.execute(plans.ORACLES[name])
        names = [d[0] for d in cursor.description]
        wanted = cursor.fetchall()
        assert sorted(names) == sorted(found.columns)
        assert _rows(found.columns, rows) == _rows(names, wanted)
    else:
        assert rows


def test_lookups_and_accounts(spark, docs):
    vocabulary = V.SurfaceVocabulary((b"x", b"yz"))
    found = V.with_ids(spark.createDataFrame([(b"x",), (b"yz",), (b"a",), (b"zz",), (None,)], "piece binary"), vocabulary).collect()
    assert {None if r["piece"] is None else bytes(r["piece"]): r["id"] for r in found} == {b"x": 259, b"yz": 260, b"a": 3 + 97, b"zz": None, None: None}
    made = encode.surface_encoding(docs, vocabulary, newline=True)
    assert encode.unaccounted(made, docs, True).count() == 0 and encode.unaccounted(made, docs).count() == docs.where("raw IS NOT NULL").count()


def test_lossless_documents(docs):
    found = {r["doc_id"]: r["blob"] for r in api.Tokenizer().lossless(docs).collect()}
    for doc, raw in raws(docs).items():
        assert codecs.read_document(bytes(found[doc])) == (raw, [(u.start, u.end, u.cuts) for u in units.units_of(raw)])
