"""A small lexicon and a made-up model, for queries on morphology and context."""

from __future__ import annotations

import numpy as np

from loomspan.functions import turkish as T
from loomspan.operators import disambiguate as D
from loomspan.operators import morphology as M


def _edge(number, owner, to, morpheme, template, condition=None):
    tokens = [{"type": k, "letter": x, "append": False} for k, x in M.parse_template(template)]
    for token, (kind, _) in zip(tokens, M.parse_template(template)):
        token["append"] = kind.endswith("WOVEL") and "+" + kind[0] in template
    return {
        "id": f"e{number}", "source_order": number, "owner_state": owner, "to_state": to, "morpheme_id": morpheme, "template_tokens": tokens,
        "surface_template": template, "condition": condition, "condition_count": M.condition_count(condition),
    }


def bundle() -> M.Bundle:
    """A hand-written lexicon of a few nouns and numbers with their suffixes."""
    morpheme = lambda i, **k: {"id": i, "name": i, "pos": None, "derivational": False, "informal": False, "mapped_id": None} | k
    item = lambda i, lemma, pos="Noun", second="None", **k: {"id": i, "lemma": lemma, "root": lemma, "pronunciation": lemma, "primary_pos": pos, "secondary_pos": second, "attributes": [], "reference_id": None, "index": 0} | k
    words = [("ev_Noun", "ev", "noun"), ("kitap_Noun", "kitap", "noun"), ("ankara_Noun_Prop", "ankara", "nounProper_S"), ("oy_Noun", "oy", "noun"), ("oyun_Noun", "oyun", "noun")]
    stems = [{"surface": s, "source_order": k, "dictionary_id": i, "target_state": t, "phonetic_bits": M.attributes(s)} for k, (i, s, t) in enumerate(words)]
    stems.append({"surface": "kitab", "source_order": 9, "dictionary_id": "kitap_Noun", "target_state": "noun", "phonetic_bits": M.attributes("kitab") & ~M.BIT["LastLetterVoiced"] | M.BIT["ExpectsVowel"] | M.BIT["CannotTerminate"]})
    stems.append({"surface": "üçüncü", "source_order": 11, "dictionary_id": "üçüncü_Num", "target_state": "number", "phonetic_bits": M.attributes("üçüncü")})
    stems.append({"surface": "üç", "source_order": 10, "dictionary_id": "üç_Num", "target_state": "number", "phonetic_bits": M.attributes("üç")})
    state = lambda k, m, terminal=True, derivative=False: {"key": k, "morpheme_id": m, "terminal": terminal, "derivative": derivative, "pos_root": False}
    expects = {"kind": "NOT", "child": {"kind": "HasPhoneticAttribute", "attribute": "ExpectsVowel"}}
    return M.Bundle(
        morphemes=tuple([morpheme("Noun", pos="Noun"), morpheme("Num", pos="Num"), morpheme("A3pl"), morpheme("P1sg"), morpheme("Gen"), morpheme("Nom"), morpheme("With", derivational=True), morpheme("Loc")]),
        dictionary=tuple([item(i, s, "Noun", "Prop" if "Prop" in i else "None") for i, s, _ in words] + [item("üç_Num", "üç", "Num", "Card"), item("üçüncü_Num", "üçüncü", "Num", "Ord")]),
        stems=tuple(stems),
        states=tuple([state("noun", "Noun"), state("nounProper_S", "Noun"), state("number", "Num"), state("plural", "A3pl"), state("mine", "P1sg"), state("of", "Gen"), state("bare", "Nom"), state("with", "With", derivative=True), state("at", "Loc")]),
        edges=tuple([
            _edge(1, "noun", "plural", "A3pl", "lAr", expects), _edge(2, "noun", "mine", "P1sg", "Im"), _edge(3, "noun", "of", "Gen", "+nIn"), _edge(4, "plural", "of", "Gen", "+nIn"),
            _edge(5, "noun", "with", "With", "lI", expects), _edge(6, "noun", "at", "Loc", ">dA", expects), _edge(7, "nounProper_S", "at", "Loc", ">dA"), _edge(8, "number", "at", "Loc", ">dA"),
            _edge(9, "plural", "at", "Loc", ">dA", {"kind": "AND", "children": [{"kind": "HasTail"}, {"kind": "CurrentMorphemeIs", "morpheme": "A3pl"}]}),
        ]),
    )


def words() -> list[list[D.Word]]:
    """Made-up candidates of five tokens."""
    rng = np.random.default_rng(0)
    word = lambda k: D.Word(f"l{k % 5}", tuple(f"g{g}" for g in rng.integers(0, 3, rng.integers(1, 4))), f"c{k}", int(rng.integers(-(2**31), 2**31)))
    return [[word(10 * t + k) for k in range(n)] for t, n in enumerate((2, 1, 3, 2, 3))]


def weight(key: str) -> np.float32:
    """A made-up model: a number between -0.5 and 0.5 for each feature."""
    return np.float32((T.java_hash(key) % 997) / 997 - 0.5)
