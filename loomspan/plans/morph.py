"""Queries on morphology and context, over a small lexicon with known answers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from loomspan.operators import disambiguate as D
from loomspan.operators import morphology as M
from loomspan.operators import units
from loomspan.plans import sample
from loomspan.plans.registry import register
from loomspan.session import shipped


def stored(names: str, kinds: str, rows: tuple[tuple, ...]) -> str:
    """Rows that were worked out by hand, as SQL."""
    value = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    columns = names.split()
    cast = ", ".join(f"CAST(r.{n} AS {k}) AS {n}" for n, k in zip(columns, kinds.split()))
    values = ", ".join("(" + ", ".join(map(value, row)) + ")" for row in rows)
    return f"SELECT {cast} FROM (VALUES {values}) AS r({', '.join(columns)})"


def _reading(canonical):
    """``item:part=surface+part=surface`` of an analysis's key."""
    item = F.split(canonical, "\x01")
    return F.concat(item[0], F.lit(":"), F.regexp_replace(F.rtrim(item[1], F.lit("\x02")), "\x02", "+"))


def _analysed(spark, surfaces):
    table = spark.createDataFrame([(s,) for s in surfaces], "surface string")
    found = M.surface_analyses(table, M.Morphology(sample.bundle()))
    rows = found.select("surface", F.posexplode_outer(F.arrays_zip("ids", "cuts")).alias("nth", "a"))
    return rows.select("surface", F.col("nth").alias("nth"), _reading(F.col("a.ids")).alias("reading"), F.array_join(F.col("a.cuts").cast("array<string>"), ",").alias("cuts"))


_KNOWN = (
    ("evlerin", 0, "ev_Noun:Noun=ev+A3pl=ler+Gen=in", "2,5"),
    ("EVLER", 0, "ev_Noun:Noun=ev+A3pl=ler", "2"),
    ("evlerde", 0, "ev_Noun:Noun=ev+A3pl=ler+Loc=de", "2,5"),
    ("evli", 0, "ev_Noun:Noun=ev+With=li", "2"),
    ("kitabım", 0, "kitap_Noun:Noun=kitab+P1sg=ım", "5"),
    ("kitap", 0, "kitap_Noun:Noun=kitap", ""),
    ("kitapta", 0, "kitap_Noun:Noun=kitap+Loc=ta", "5"),
    ("kitab", None, None, None),
    ("kitablar", None, None, None),
    ("ankarada", 0, "ankara_Noun_Prop:Noun=ankara+Loc=da", "6"),
    ("oyunum", 0, "oyun_Noun:Noun=oyun+P1sg=um", "4"),
    ("xyz", None, None, None),
)


@register(stored("surface nth reading cuts", "VARCHAR INTEGER VARCHAR VARCHAR", _KNOWN))
def morph_analyses(spark, folder):
    """Stems, suffixes by harmony, softening and devoicing, conditions, alignment with the surface."""
    return _analysed(spark, [r[0] for r in _KNOWN])


_MADE_UP = (
    ("Ankara'da", 0, "ankara_Noun_Prop:Noun=ankara+Loc=da", "6,7"),
    ("Adana'da", 0, "Adana'da_Noun_Prop:Noun=adana+Loc=da", "5,6"),
    ("13'te", 0, "13_Num_Card:Num=13+Loc=te", "2,3"),
    ("III'te", 0, "III_Num_RomanNumeral:Num=III+Loc=te", "3,4"),
    ("3'üncü", 0, "3_Num_Card:Num=3+Ord=üncü", "1,2"),
    ("3'üncüde", 0, "3_Num_Card:Num=3+Ord=üncü+Loc=de", "1,2,8"),
    ("Zzz'da", None, None, None),
)


@register(stored("surface nth reading cuts", "VARCHAR INTEGER VARCHAR VARCHAR", _MADE_UP))
def morph_made_up(spark, folder):
    """What no lexicon has: names, numbers, Roman numerals, ordinals after an apostrophe."""
    return _analysed(spark, [r[0] for r in _MADE_UP])


_GENERATED = (
    ("ev_Noun", "Noun A3pl Gen", "evlerin"),
    ("ev_Noun", "Noun A3pl Loc", "evlerde"),
    ("kitap_Noun", "Noun P1sg", "kitabım"),
    ("kitap_Noun", "Noun P1sg", "kitapım"),  # this lexicon doesn't ask the other stem for a consonant
    ("oyun_Noun", "Noun With", "oyunlu"),
    ("ankara_Noun_Prop", "Noun Loc", "ankarada"),
    ("üç_Num", "Num Loc", "üçte"),
)


@register(stored("item parts surface", "VARCHAR VARCHAR VARCHAR", _GENERATED))
def morph_generation(spark, folder):
    """Surfaces of an item with given morphemes."""
    morphology = M.Morphology(sample.bundle())

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, p, "".join(m.surface for m in a.morphemes)) for i, p in zip(*(c.to_pylist() for c in batch.columns)) for a in morphology.generate(i, p.split())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 3, names=["item", "parts", "surface"])

    asked = spark.createDataFrame(sorted({r[:2] for r in _GENERATED}), "item string, parts string")
    return shipped(asked).mapInArrow(kernel, "item string, parts string, surface string").distinct()


def _path_sql() -> str:
    """Both choices by their definitions in SQL, from the scores of all trigrams."""
    made, chooser = sample.words(), D.Disambiguator(sample.weight)
    lines = [[D.BEGIN], [D.BEGIN], *made, [D.END]]
    rows = []
    for place in range(len(lines) - 2):
        for a, one in enumerate(lines[place]):
            for b, two in enumerate(lines[place + 1]):
                rows += [(place, a, b, c, float(chooser.score(one, two, w))) for c, w in enumerate(lines[place + 2])]
    scores = "(VALUES " + ", ".join(f"({p}, {a}, {b}, {c}, CAST({s!r} AS FLOAT))" for p, a, b, c, s in rows) + ") AS s(place, a, b, c, score)"
    sizes = [len(f) for f in made]
    walks = " ".join(f"JOIN (SELECT * FROM {scores}) s{k} ON s{k}.place = {k} AND s{k}.a = s{k - 1}.b AND s{k}.b = s{k - 1}.c" for k in range(1, len(sizes) + 1))
    picks = ", ".join(f"s{k}.c" for k in range(len(sizes)))
    total = " + ".join(f"CAST(s{k}.score AS DOUBLE)" for k in range(len(sizes) + 1))
    best = f"SELECT [{picks}] AS picked FROM (SELECT * FROM {scores}) s0 {walks} WHERE s0.place = 0 ORDER BY {total} DESC LIMIT 1"
    causal = f"""WITH RECURSIVE w(place, a, b) AS (SELECT 0, 0, 0 UNION ALL SELECT place + 1, b, pick FROM (
        SELECT w.place, w.b, (SELECT c FROM {scores} WHERE s.place = w.place AND s.a = w.a AND s.b = w.b ORDER BY score DESC, c LIMIT 1) AS pick FROM w WHERE w.place < {len(sizes)}))
        SELECT place - 1 AS token, b AS causal FROM w WHERE place > 0"""
    return f"SELECT CAST(k.token AS INTEGER) AS token, CAST(k.causal AS INTEGER) AS causal, CAST(p.picked[k.token + 1] AS INTEGER) AS best FROM ({causal}) k, ({best}) p"


@register(_path_sql())
def context_choices(spark, folder):
    """Candidates chosen one after another, and along the best path; SQL tries all paths."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, chooser = sample.words(), D.Disambiguator(sample.weight)
        for batch in batches:
            for _ in range(batch.num_rows):
                causal, (best, _) = chooser.causal(made), chooser.best_path(made)
                columns = [list(range(len(made))), causal, best]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns], names=["token", "causal", "best"])

    return shipped(spark.range(1)).mapInArrow(kernel, "token int, causal int, best int")


_SENTENCE = "Oyun evlerin oyunlu kitaplar geldi mi? 3'üncü."
_UNITS = (
    ("evlerin", 2, "2,5", "ev"), ("oyunlu", 2, "4", "oyun"), ("kitaplar", 2, "5", "kitap"), ("geldi", 3, "", "geldi"), ("mi", 3, "", "mi"),
    ("3'üncü", 2, "1,2", "3"),
)


@register(stored("surface status cuts lemma", "VARCHAR INTEGER VARCHAR VARCHAR", _UNITS))
def units_in_context(spark, folder):
    """Units of a sentence with the analyses that its context chose; the ambiguous first word aside."""
    docs = spark.createDataFrame([(1, bytearray(_SENTENCE.encode()))], "doc_id long, raw binary")
    made = units.tokenize(docs, provider=M.Morphology(sample.bundle()), choose=D.Disambiguator(sample.weight), surfaces=True, analyses=True)
    shifted = F.transform("cuts", lambda c: (c - F.col("start")).cast("string"))
    rows = made.select(F.decode("surface", "UTF-8").alias("surface"), "status", F.array_join(shifted, ",").alias("cuts"), F.col("analysis.lemma").alias("lemma"))
    return rows.where("lemma IS NOT NULL AND surface <> 'Oyun'")


_STEMS = ("ev", "kitap", "ankara", "oy", "oyun", "kitab", "üçüncü", "üç")


@register(
    "SELECT w.word, s.stem FROM (VALUES ('evlerin'), ('kitabım'), ('oyunlu'), ('üçüncüde'), ('deniz')) AS w(word) JOIN (VALUES "
    + ", ".join(f"('{s}')" for s in _STEMS)
    + ") AS s(stem) ON starts_with(w.word, s.stem)"
)
def stem_lookup(spark, folder):
    """The lexicon's stems that words begin with."""
    morphology = M.Morphology(sample.bundle())

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, w[:n]) for w in batch.column(0).to_pylist() for n in range(1, min(len(w), morphology.longest) + 1) if w[:n] in morphology.stems]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 2, names=["word", "stem"])

    words = spark.createDataFrame([(w,) for w in ("evlerin", "kitabım", "oyunlu", "üçüncüde", "deniz")], "word string")
    return shipped(words).mapInArrow(kernel, "word string, stem string")
