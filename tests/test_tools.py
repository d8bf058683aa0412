"""Stored forms of lexicons and analyses, and the command-line checks."""

from __future__ import annotations

import json

import numpy as np
import pytest

from loomspan import tools
from loomspan.operators import disambiguate as D
from loomspan.operators import morphology as M
from loomspan.operators import units
from loomspan.operators import vocab as V
from loomspan.plans.sample import bundle, weight
from loomspan.sources import codecs


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    made = tmp_path_factory.mktemp("bundle")
    for name in M.TABLES:
        (made / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in getattr(bundle(), name)))
    return str(made)


def told(capsys):
    return json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_bundle_files(folder, tmp_path, capsys):
    assert tools.main(["validate-bundle", folder]) == 0 and told(capsys)["stems"] == len(bundle().stems)
    packed = str(tmp_path / "b.bin")
    assert tools.main(["compile-bundle", folder, packed]) == 0 and tools.main(["validate-binary", packed]) == 0
    blob = open(packed, "rb").read()
    assert codecs.read_bundle(blob) == M.Bundle.read(folder)
    for bad in (blob[:-1], blob + b"x", codecs.seal(codecs.BUNDLE, b"no"), codecs.seal(codecs.CHARS, b"")):
        with pytest.raises(codecs.CodecError):
            codecs.read_bundle(bad)
    assert codecs.assets(bundle())["morphology_sha256"] == codecs.bundle_fingerprint(bundle())
    with pytest.raises(SystemExit):
        tools.main(["compile-bundle", folder])


def test_probes():
    bits = lambda k: int(np.float32(weight(k)).view(np.uint32))
    assert tools.probe(weight, [{"key": "a", "bits": bits("a")}, {"key": "b", "bits": bits("b") ^ 1}]) == ["b"]


def test_comparisons(spark, folder, tmp_path, capsys):
    morphology = M.Morphology(bundle())
    rows = [{"surface": s, "analyses": [a.canonical for a in morphology(s)]} for s in ("evlerin", "oyun", "kitablar")]
    assert tools.main(["compare-analyses", folder, lines(tmp_path / "a", rows)], spark) == 0
    rows[0]["analyses"].append("more")
    assert tools.main(["compare-analyses", folder, lines(tmp_path / "b", rows)], spark) == 1 and told(capsys) == {"computed_only": 0, "expected_only": 1}
    made = [{"item": "ev_Noun", "morphemes": ["Noun", "A3pl", "Gen"], "surfaces": ["evlerin"]}]
    assert tools.main(["compare-generation", folder, lines(tmp_path / "c", made)], spark) == 0
    tokens = ["Oyun", "evlerin", "oyunlu"]
    sets = [tools.quality.analyses(t, morphology) for t in tokens]
    chosen = [f[k].canonical for f, k in zip(sets, D.Disambiguator(weight)(sets))]
    oracle = lines(tmp_path / "d", [{"tokens": tokens, "choices": chosen}])
    assert tools.compared_choices(spark, morphology, weight, oracle).count() == 0
    oracle = lines(tmp_path / "e", [{"tokens": tokens, "choices": [chosen[0] + "x", *chosen[1:]]}])
    assert tools.compared_choices(spark, morphology, weight, oracle).count() == 2


def test_compiled_analyses(spark, tmp_path):
    morphology = M.Morphology(bundle())
    surfaces = spark.createDataFrame([("evlerin",), ("oyun",), ("xyz",), ("oyun",)], "surface string")
    path = str(tmp_path / "t")
    M.store_analyses(surfaces, morphology, path)
    assert M.differences(M.stored_analyses(spark, path, morphology), M.surface_analyses(surfaces, morphology)).count() == 0
    other = M.Morphology(M.replace(bundle(), stems=bundle().stems[1:]))
    with pytest.raises(M.BundleError):
        M.stored_analyses(spark, path, other)
    wrong = M.surface_analyses(surfaces, other).withColumn("lexicon", tools.F.lit(morphology.digest()))
    wrong.write.parquet(str(tmp_path / "w"))
    with pytest.raises(M.BundleError):
        M.stored_analyses(spark, str(tmp_path / "w"), morphology)


def test_root_vocabulary(spark):
    docs = spark.createDataFrame([(1, bytearray("evler evli oyun qq".encode())), (2, bytearray("evlerin".encode()))], "doc_id long, raw binary")
    made = V.train_roots(units.tokenize(docs, provider=M.Morphology(bundle()), analyses=True), 2)
    assert made.entries[:8] == (*V.ROOT_CONTROLS, "<num:0>") and made.entries[1007:] == ("<m:A3pl>", "<m:Gen>", "<m:Noun>", "<m:Unknown>", "<m:With>", "<r:ev_Noun>", "<r:UNK_Unk_Unk>")
    assert codecs.read_roots(codecs.write_roots(made)) == made
    for bad in (made.entries[1:], (*made.entries, "<m:Gen>")):
        with pytest.raises(ValueError):
            V.RootVocabulary(bad)


def test_preserved_documents(spark):
    docs = spark.createDataFrame([(1, bytearray(b"as it is")), (2, None)], "doc_id long, raw binary")
    found = {r["doc_id"]: r for r in units.preserved(docs).collect()}
    assert found[1]["start"] == [] and bytes(found[1]["raw"]) == b"as it is" and found[2]["start"] is None
    assert dict(units.preserved(docs.drop("raw").withColumn("raw", tools.F.lit(b"x"))).dtypes)["cuts"] == "array<array<bigint>>"
