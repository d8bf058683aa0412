"""Table-level front: a tokeniser with its settings, lexicon and vocabularies.

Every method takes and gives DataFrames keyed by ``doc_id``; tables of
documents have ``raw`` bytes (see ``loomspan.sources``).
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.operators import encode, lattice, quality, scan, units
from loomspan.operators import vocab as V
from loomspan.operators.disambiguate import Disambiguator, word_of
from loomspan.sources import codecs
from loomspan.session import shipped


@dataclass
class Tokenizer:
    """Units of documents under fixed settings."""

    config: units.Config = field(default_factory=units.Config)
    provider: units.Provider | None = None
    disambiguator: Disambiguator | None = None

    def _units(self, raw: bytes) -> list[units.Unit]:
        return units.units_of(raw, self.config, self.provider, self.disambiguator)

    def tokenize(self, docs: DataFrame) -> DataFrame:
        """A row for each unit with its bytes; where there is a lexicon also the analysis that its context chose."""
        return units.tokenize(docs, self.config, self.provider, self._choose(), surfaces=True, analyses=self.provider is not None)

    def _choose(self):
        return self.disambiguator if self.config.contextual and self.provider is not None else None

    def blobs(self, docs: DataFrame) -> DataFrame:
        """``doc_id``, ``blob``: tokenised documents in binary form."""
        return codecs.column_writer(docs, lambda raw: codecs.write_tokenized(raw, self._units(raw)))

    def lossless(self, docs: DataFrame) -> DataFrame:
        """``doc_id``, ``blob``: spans and cuts alone, with the text."""
        return codecs.column_writer(docs, lambda raw: codecs.write_document(raw, [(u.start, u.end, u.cuts) for u in self._units(raw)]))

    def decode(self, blobs: DataFrame, strict: bool = True) -> DataFrame:
        return codecs.column_reader(blobs, lambda blob: codecs.read_tokenized(blob)[0], strict)

    def roundtrip(self, docs: DataFrame) -> bool:
        """Whether all documents come back from their binary form."""
        back = self.decode(self.blobs(docs)).withColumnRenamed("raw", "back")
        return bool(docs.select("doc_id", "raw").join(back, "doc_id").agg(F.coalesce(F.bool_and(F.col("raw") == F.col("back")), F.lit(True))).first()[0])


@dataclass
class SurfaceTokenizer(Tokenizer):
    """Ids of a surface vocabulary."""

    vocabulary: V.SurfaceVocabulary = field(default_factory=lambda: V.SurfaceVocabulary(()))

    @classmethod
    def train(cls, docs: DataFrame, size: int, **settings) -> "SurfaceTokenizer":
        made = cls(**settings)
        made.vocabulary = V.train_surface(V.observed_weights(docs, made.config, made.provider, choose=made._choose()), size)
        return made

    def encode_ids(self, docs: DataFrame) -> DataFrame:
        """``doc_id``, ``ids`` without the marks for a document's ends."""
        made = encode.surface_encoding(docs, self.vocabulary, self.config, provider=self.provider, choose=self._choose())
        return made.select("doc_id", encode.content_ids(F.col("ids")).alias("ids"))

    def decode_ids(self, encoded: DataFrame) -> DataFrame:
        return encode.surface_decoding(encoded, self.vocabulary)

    def inspect(self, docs: DataFrame) -> DataFrame:
        """A row for each token: id, its kind, where it is, its bytes and the unit that it begins in."""
        made = encode.surface_encoding(docs, self.vocabulary, self.config, provider=self.provider, choose=self._choose())
        rows = made.select("doc_id", F.posexplode(F.arrays_zip("ids", "lengths")).alias("token_idx", "t")).select("doc_id", "token_idx", "t.*")
        order = Window.partitionBy("doc_id").orderBy("token_idx")
        end = F.sum(F.col("lengths").cast("long")).over(order)
        kind = F.when(F.col("ids") == V.PAD, "pad").when(F.col("ids") == V.BOS, "bos").when(F.col("ids") == V.EOS, "eos")
        kind = kind.when(F.col("ids") < V.SURFACE_FIRST, "byte").otherwise("learned")
        rows = rows.select("doc_id", "token_idx", F.col("ids").alias("id"), kind.alias("kind"), (end - F.col("lengths")).alias("start"), end.alias("end"))
        found = units.tokenize(docs, self.config, self.provider, self._choose()).select("doc_id", "unit_idx", F.col("start").alias("_s"))
        marked = rows.select("doc_id", "token_idx", "id", "kind", "start", "end", F.lit(None).cast("int").alias("_unit"), F.lit(1).alias("_o"))
        begun = found.select("doc_id", F.lit(None).cast("int").alias("token_idx"), F.lit(None).cast("int").alias("id"), F.lit(None).cast("string").alias("kind"), F.col("_s").alias("start"), F.lit(None).cast("long").alias("end"), F.col("unit_idx").alias("_unit"), F.lit(0).alias("_o"))
        # an as-of join: the last unit that begins at or before the token, carried along in order
        along = Window.partitionBy("doc_id").orderBy("start", "_o", "token_idx")
        joined = marked.unionByName(begun).withColumn("unit_idx", F.last("_unit", ignorenulls=True).over(along)).where("token_idx IS NOT NULL")
        special = F.col("kind").isin("pad", "bos", "eos")
        joined = joined.withColumn("unit_idx", F.when(~special, F.col("unit_idx"))).drop("_unit", "_o")
        data = F.substring("raw", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
        return joined.join(docs.select("doc_id", "raw"), "doc_id").withColumn("hex", F.lower(F.hex(data))).drop("raw")

    def summary(self, docs: DataFrame) -> DataFrame:
        """Sizes and numbers of tokens and units of each document."""
        tokens = encode.surface_encoding(docs, self.vocabulary, self.config, provider=self.provider, choose=self._choose())
        tokens = tokens.select("doc_id", F.size("ids").alias("n_tokens"), F.size(encode.content_ids(F.col("ids"))).alias("n_content"))
        made = units.unit_arrays(docs, self.config, self.provider, self._choose())
        count = lambda value: F.size(F.filter("status", lambda s: s == value))
        made = made.select("doc_id", F.size("status").alias("n_units"), count(units.MORPHOLOGICAL).alias("n_morphological"), count(units.CODED).alias("n_code"), count(units.UNKNOWN).alias("n_unknown"))
        sizes = docs.select("doc_id", F.octet_length("raw").alias("n_bytes"))
        return sizes.join(tokens, "doc_id").join(made, "doc_id").withColumn("vocabulary_size", F.lit(len(self.vocabulary)))


@dataclass
class LatticeTokenizer(Tokenizer):
    """Lattices of candidates, samples of them, and model inputs and outputs."""

    chars: V.CharVocabulary = field(default_factory=lambda: V.CharVocabulary(()))
    generation: V.GenerationVocabulary | None = None

    def lattice_of(self, raw: bytes) -> tuple[list[units.Unit], list[list[lattice.Choice]]]:
        """Units with all classes of their analyses, shadow analyses included."""
        shadow = lambda s: quality.shadow_analyses(s, self.provider)
        lexical, hints = scan.scan_with_hints(raw)
        requested = units.MODES[self.config.mode]
        spans = []
        if not requested:
            spans = units.code.code_spans(raw, *hints) if self.config.detect_unmarked_code else units.code.fenced_spans(raw)
        found = units.split_units(raw, lexical, spans, requested)
        rows: list[list[tuple]] = [[((), u.status, 0.0)] for u in found]
        chosen = [0] * len(found)
        for segment in units.segments(raw, found, self.config.max_sentence_tokens):
            sets = [shadow(raw[found[k].start : found[k].end].decode()) or [quality.unknown(raw[found[k].start : found[k].end].decode())] for k in segment]
            words = [[word_of(a) for a in s] for s in sets]
            contextual = self.disambiguator if self.config.contextual else None
            picked = contextual.causal(words) if contextual else [0] * len(sets)
            scores = contextual.causal_scores(words, picked) if contextual else [[np.float32(0)] * len(s) for s in sets]
            for k, options, best, row in zip(segment, sets, picked, scores):
                made = []
                for analysis, score in zip(options, row):
                    one = units.replace(found[k], cuts=[])
                    units.apply_analysis(raw, one, analysis)
                    made.append((tuple(one.cuts), one.status, float(score)))
                units.apply_analysis(raw, found[k], options[best])
                rows[k], chosen[k] = made, best
        kept, choices = [], []
        for unit, row, best in zip(found, rows, chosen):
            pieces = units.chunk(raw, [unit], self.config.max_fallback_chars)
            kept += pieces
            whole = lattice.collapse(row, best)
            choices += [whole] if len(pieces) == 1 else [[lattice.Choice((), p.status, 1, np.float32(0), True)] for p in pieces]
        units.group_clitics(raw, kept)
        return kept, choices

    def lattices(self, docs: DataFrame) -> DataFrame:
        """``doc_id``, ``blob``: lattices with their text."""
        return codecs.column_writer(docs, lambda raw: codecs.write_lattice(raw, *self.lattice_of(raw)))

    def sidecars(self, docs: DataFrame) -> DataFrame:
        """``doc_id``, ``blob``: lattices without it."""
        return codecs.column_writer(docs, lambda raw: codecs.write_sidecar(raw, *self.lattice_of(raw)))

    def _sampled(self, raw: bytes, policy: str, seed: int, temperature: float) -> list[units.Unit]:
        found, choices = self.lattice_of(raw)
        for unit, options, pick in zip(found, choices, lattice.draw(choices, policy, seed, temperature)):
            unit.cuts, unit.status = list(options[pick].cuts), options[pick].status
        return found

    def sample(self, docs: DataFrame, policy: str = "best", seed: int = 0, temperature: float = 1.0) -> DataFrame:
        """``doc_id``, ``blob``: documents with one class of each unit drawn."""
        plain = lambda raw: [(u.start, u.end, u.cuts) for u in self._sampled(raw, policy, seed, temperature)]
        return codecs.column_writer(docs, lambda raw: codecs.write_document(raw, plain(raw)))

    def input_encoding(self, docs: DataFrame, policy: str = "best", seed: int = 0, temperature: float = 1.0) -> DataFrame:
        """Pooled character inputs of models."""
        kind = docs.schema["doc_id"].dataType.simpleString()
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        types = [pa.list_(t) for t in (pa.int32(), pa.int32(), pa.int32(), span, pa.string(), pa.int32())]

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [encode.encode_input(self.chars, v.as_py(), self._sampled(v.as_py(), policy, seed, temperature)) if v.is_valid else None for v in batch.column(1)]
                names = ["ids", "segment_offsets", "pooled_segments", "pool_spans", "pool_modes", "pool_group_ids"]
                value = lambda m, n: None if m is None else [{"start": s, "end": e} for s, e in m[n]] if n == "pool_spans" else m[n]
                columns = [pa.array([value(m, n) for m in made], t) for n, t in zip(names, types)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

        schema = "ids array<int>, segment_offsets array<int>, pooled_segments array<int>, pool_spans array<struct<start:bigint,end:bigint>>, pool_modes array<string>, pool_group_ids array<int>"
        return shipped(docs).select("doc_id", "raw").mapInArrow(kernel, f"doc_id {kind}, {schema}")

    def train(self, docs: DataFrame, chars: int, roots: int, pieces: int) -> str:
        """Train both vocabularies by counting; gives the fingerprint of settings and vocabularies."""

        @F.pandas_udf("string")
        def valid(raw: pd.Series) -> pd.Series:
            return raw.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

        self.chars = V.train_chars(docs.select(valid("raw").alias("text")), chars)

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [r for v in batch.column(0) if v.is_valid for r in V.family_tokens(v.as_py(), self._units(v.as_py()))]
                columns = list(zip(*rows)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.binary()))], names=["family", "token", "surface"])

        counted = shipped(docs).select("raw").mapInArrow(kernel, "family int, token string, surface binary").groupBy("family", "token", "surface").agg(F.count("*").alias("n"))
        top = lambda f, key, most: [(r["token"], bytes(r["surface"])) for r in counted.where(F.col("family") == f).orderBy(F.col("n").desc(), key).limit(most).collect()]
        found = counted.where(F.col("family") == V.G_MORPHEME).limit(V.MOST_ENTRIES + 1).collect()
        if len(found) > V.MOST_ENTRIES:
            raise ValueError("more morphemes than a vocabulary has entries")
        morphemes = [(r["token"], bytes(r["surface"])) for r in found]
        self.generation = V.assemble_generation(list(self.chars.chars), morphemes, top(V.G_ROOT, "token", roots), [s for _, s in top(V.G_PIECE, "surface", pieces)])
        return self.fingerprint()

    def fingerprint(self) -> str:
        return codecs.fingerprint(self.config, self.chars, self.generation)

    def generation_ids(self, docs: DataFrame) -> DataFrame:
        """``doc_id``, ``ids`` of the generation vocabulary."""
        made = encode._encoded(docs, lambda: lambda raw: (encode.encode_generation(self.generation, raw, self._units(raw)), []))
        return made.select("doc_id", "ids")

    def generation_decode(self, encoded: DataFrame) -> DataFrame:
        kind = encoded.schema["doc_id"].dataType.simpleString()

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [encode.decode_generation(self.generation, v.as_py()) if v.is_valid else None for v in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "raw"])

        return shipped(encoded).select("doc_id", "ids").mapInArrow(kernel, f"doc_id {kind}, raw binary")
