"""Command-line checks of lexicons, models and what they give.

    python -m loomspan.tools validate-bundle FOLDER
    python -m loomspan.tools compile-bundle FOLDER FILE
    python -m loomspan.tools validate-binary FILE
    python -m loomspan.tools validate-model FILE
    python -m loomspan.tools probe-model FILE PROBES
    python -m loomspan.tools compare-analyses FOLDER ORACLE
    python -m loomspan.tools compare-generation FOLDER ORACLE
    python -m loomspan.tools compare-choices FOLDER MODEL ORACLE

Probes and oracles are JSON lines: ``key`` and ``bits`` (of the 32-bit float);
``surface`` and ``analyses`` (keys); ``item``, ``morphemes`` and ``surfaces``;
``tokens`` and ``choices`` (keys). A comparison counts rows that one side only
has and ends with 1 if there are any.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import disambiguate as D
from loomspan.operators import morphology as M
from loomspan.operators import quality
from loomspan.session import build, shipped
from loomspan.sources import codecs


def summary(bundle: M.Bundle) -> dict:
    return {"problems": bundle.problems()[:20], **{name: len(getattr(bundle, name)) for name in M.TABLES}, "digest": codecs.bundle_fingerprint(bundle) if not bundle.problems() else None}


def compile_bundle(folder: str, file: str) -> dict:
    """Write the packed form beside its place first, so that no half of it is ever there."""
    blob = codecs.write_bundle(M.Bundle.read(folder))
    beside = Path(file + ".part")
    beside.write_bytes(blob)
    os.replace(beside, file)
    return {"bytes": len(blob)}


def probe(model: D.PerceptronModel, probes: list[dict]) -> list[str]:
    """Keys whose weight has other bits than expected."""
    return [p["key"] for p in probes if int(np.float32(model(p["key"])).view(np.uint32)) != p["bits"]]


def _mapped(frame: DataFrame, make, names: list[str]) -> DataFrame:
    """A row of texts for each tuple that a row gives."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for given in zip(*(c.to_pylist() for c in batch.columns)) for r in make(*given)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))], names=names)

    return shipped(frame).mapInArrow(kernel, ", ".join(f"{n} string" for n in names))


def compared_analyses(spark: SparkSession, morphology: M.Morphology, oracle: str) -> DataFrame:
    given = spark.read.schema("surface string, analyses array<string>").json(oracle)
    made = _mapped(given.select("surface"), lambda s: [(s, a.canonical) for a in morphology(s)], ["surface", "analysis"])
    return M.differences(made, given.select("surface", F.explode("analyses").alias("analysis")))


def compared_generation(spark: SparkSession, morphology: M.Morphology, oracle: str) -> DataFrame:
    given = spark.read.schema("item string, morphemes array<string>, surfaces array<string>").json(oracle)
    parts = F.array_join("morphemes", " ").alias("parts")
    surface = lambda a: "".join(m.surface for m in a.morphemes)
    made = _mapped(given.select("item", parts), lambda i, p: [(i, p, s) for s in sorted({surface(a) for a in morphology.generate(i, p.split())})], ["item", "parts", "surface"])
    return M.differences(made, given.select("item", parts, F.explode("surfaces").alias("surface")))


def compared_choices(spark: SparkSession, morphology: M.Morphology, model, oracle: str) -> DataFrame:
    """Each token's chosen analysis, by its place in its sentence."""
    given = spark.read.schema("tokens array<string>, choices array<string>").json(oracle)
    sentence = F.to_json("tokens").alias("sentence")

    def make(text: str) -> list[tuple]:
        sets = [quality.analyses(t, morphology) for t in json.loads(text)]
        picked = D.Disambiguator(model)(sets)
        return [(text, str(k), found[which].canonical) for k, (found, which) in enumerate(zip(sets, picked))]

    expected = given.select(sentence, F.posexplode("choices").alias("place", "choice")).select("sentence", F.col("place").cast("string").alias("place"), "choice")
    return M.differences(_mapped(given.select(sentence), make, ["sentence", "place", "choice"]), expected)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomspan.tools")
    parser.add_argument("command", choices=sorted(_FILES))
    parser.add_argument("files", nargs="+")
    given = parser.parse_args(arguments)
    if len(given.files) != _FILES[given.command]:
        parser.error(f"{given.command} takes {_FILES[given.command]} files or folders")
    one, *more = given.files
    if given.command == "validate-bundle":
        told = summary(M.Bundle.read(one))
        bad = bool(told["problems"])
    elif given.command == "compile-bundle":
        told, bad = compile_bundle(one, more[0]), False
    elif given.command == "validate-binary":
        told, bad = summary(codecs.read_bundle(Path(one).read_bytes())), False
    elif given.command == "validate-model":
        told, bad = {"weights": len(D.PerceptronModel.parse(Path(one).read_bytes()).weights)}, False
    elif given.command == "probe-model":
        wrong = probe(D.PerceptronModel.parse(Path(one).read_bytes()), [json.loads(x) for x in Path(more[0]).read_text().splitlines() if x.strip()])
        told, bad = {"wrong": len(wrong), "first": wrong[:10]}, bool(wrong)
    else:
        spark = spark or build("loomspan-tools")
        morphology = M.Morphology(M.Bundle.read(one))
        if given.command == "compare-choices":
            rows = compared_choices(spark, morphology, D.PerceptronModel.parse(Path(more[0]).read_bytes()), more[1])
        else:
            rows = (compared_analyses if given.command == "compare-analyses" else compared_generation)(spark, morphology, more[0])
        counts = {r["side"]: r["count"] for r in rows.groupBy("side").count().collect()}
        told, bad = {"computed_only": counts.get("computed", 0), "expected_only": counts.get("expected", 0)}, bool(counts)
    print(json.dumps(told, ensure_ascii=False))
    return int(bad)


_FILES = {"validate-bundle": 1, "compile-bundle": 2, "validate-binary": 1, "validate-model": 1, "probe-model": 2, "compare-analyses": 2, "compare-generation": 2, "compare-choices": 3}

if __name__ == "__main__":
    sys.exit(main())
