"""Analysis, generation and disambiguation with a small hand-written lexicon."""

from __future__ import annotations

import itertools
import pickle
import struct

import numpy as np
import pytest

from loomspan.functions import turkish as T
from loomspan.operators import disambiguate as D
from loomspan.operators import morphology as M
from loomspan import api
from loomspan.operators import encode, units
from loomspan.operators.quality import Analysis, Morpheme
from loomspan.plans.sample import bundle, weight, words


@pytest.fixture(scope="module")
def morphology():
    return M.Morphology(bundle())


def parts(found):
    return [[(m.id, m.surface) for m in a.morphemes] for a in found]


def test_templates_and_conditions():
    assert M.realise(M.parse_template("lAr"), M.attributes("ev")) == "ler" and M.realise(M.parse_template("+nIn"), M.attributes("ankara")) == "nın"
    assert M.realise(M.parse_template(">dA"), M.attributes("kitap")) == "ta" and M.realise(M.parse_template("Im"), M.attributes("oyun")) == "um"
    tokens = [{"type": "APPEND", "letter": "y", "append": False}, {"type": "DEVOICE_FIRST", "letter": "d", "append": False}, {"type": "I_WOVEL", "letter": "", "append": False}]
    assert M.template_text(tokens) == "+y>dI" and M.parse_template("+y>dI") == (("APPEND", "y"), ("DEVOICE_FIRST", "d"), ("I_WOVEL", ""))
    leaf = {"kind": "HasTail"}
    assert M.condition_count({"kind": "NOT", "child": {"kind": "AND", "children": [leaf, leaf]}}) == 1
    assert M.condition_count({"kind": "AND", "children": [leaf, {"kind": "OR", "children": [leaf, leaf]}]}) == 3
    with pytest.raises(M.BundleError):
        M.compile_condition({"kind": "Other"}, {})


def test_phonetics():
    bits = lambda w: {n for n in M.PHONETIC if M.attributes(w) & M.BIT[n]}
    assert {"LastVowelFrontal", "LastVowelUnrounded"} <= bits("ev") and {"LastVowelBack", "LastLetterVoicelessStop"} <= bits("kitap")
    assert M.attributes("", 5) == 5 and "HasNoVowel" in bits("ğ")


def test_analyses(morphology):
    assert parts(morphology("evlerin")) == [[("Noun", "ev"), ("A3pl", "ler"), ("Gen", "in")]] and morphology("evlerin")[0].cuts == (2, 5)
    assert parts(morphology("kitabım")) == [[("Noun", "kitab"), ("P1sg", "ım")]] and morphology("kitab") == [] and morphology("kitablar") == []
    assert sorted(parts(morphology("oyun"))) == [[("Noun", "oy"), ("Gen", "un")], [("Noun", "oyun")]]
    assert parts(morphology("EVLER")) == [[("Noun", "ev"), ("A3pl", "ler")]] and morphology("EVLER")[0].cuts == (2,)
    assert morphology("evlerde") and morphology("xyz") == []
    assert pickle.loads(pickle.dumps(morphology))("evli") == morphology("evli")


def test_made_up_words(morphology):
    found = morphology("Ankara'da")
    assert found and found[0].cuts == (6, 7) and parts(found)[0] == [("Noun", "ankara"), ("Loc", "da")]
    proper = morphology("Adana'da")
    assert [a.secondary_pos for a in proper] == ["Prop"] and proper[0].lemma == "Adana'da" and proper[0].cuts == (5, 6)
    assert [(a.secondary_pos, a.cuts) for a in morphology("13'te")] == [("Card", (2, 3))] and morphology("III'te")[0].secondary_pos == "RomanNumeral"
    assert T.number_word("110") == "on" and T.number_word("1000") == "bin" and T.number_word("7", True) == "yedinci" and T.number_word("00") == "yüz"
    assert T.split_number("20'nci") == ("20", "nci") and T.split_number("18erli") == ("18", "erli")


def test_generation_inverts_analysis(morphology):
    for item, names in (("ev_Noun", ["Noun", "A3pl", "Gen"]), ("kitap_Noun", ["Noun", "P1sg"]), ("oyun_Noun", ["Noun", "With"])):
        made = morphology.generate(item, names)
        assert made
        for one in made:
            surface = "".join(m.surface for m in one.morphemes)
            assert one in [M.replace(a, cuts=()) for a in morphology(surface)]
    with pytest.raises(M.BundleError):
        morphology.generate("none", [])


def test_bad_bundles():
    good = bundle()
    for name, field, value in (("stems", "dictionary_id", "x"), ("edges", "to_state", "x"), ("edges", "surface_template", "x"), ("edges", "condition_count", 9), ("states", "morpheme_id", "x")):
        rows = list(getattr(good, name))
        rows[0] = rows[0] | {field: value}
        with pytest.raises(M.BundleError):
            M.Morphology(M.replace(good, **{name: tuple(rows)}))


def test_alignment():
    assert M.same_letters("uŕka", "u?ka") and M.same_letters("m1", "m?") and M.same_letters("uáña", "uana") and not M.same_letters("ev", "av")


def test_causal_choice_does_not_see_what_follows():
    made, chooser = words(), D.Disambiguator(weight)
    picked = chooser.causal(made)
    for n in range(1, len(made)):
        assert chooser.causal(made[:n]) == picked[:n]
    rows = chooser.causal_scores(made, picked)
    assert rows[1] == [0] and all(int(np.argmax(r)) == k for r, k in zip(rows, picked))
    assert len(chooser.conditional_scores(made, picked)) == len(made)


def test_best_path_is_brute_force():
    made, chooser = words(), D.Disambiguator(weight)

    def total(choice):
        line = [D.BEGIN, D.BEGIN, *(f[k] for f, k in zip(made, choice)), D.END]
        return sum(chooser.score(*line[k : k + 3]) for k in range(len(line) - 2))

    best = max(itertools.product(*[range(len(f)) for f in made]), key=total)
    picked, score = chooser.best_path(made)
    assert tuple(picked) == best and score == pytest.approx(total(best), abs=1e-4)


def test_stored_model():
    keys = ["4:ev+Noun", "10:ev", "22:1"]
    size = len(keys)
    for seed in itertools.count(1):
        slots = [T.mphf_hash(k, seed) % size for k in keys]
        if len(set(slots)) == size:
            break
    data = [0] * (2 * size)
    for k, slot in enumerate(slots):
        data[2 * slot], data[2 * slot + 1] = T.java_hash(keys[k]) & 0x07FFFFFF, struct.unpack(">i", struct.pack(">f", 0.5 + k))[0]
    blob = struct.pack(">Ii", D.PerceptronModel.MAGIC, 2 * size) + b"".join(struct.pack(">i", d) for d in data)
    blob += struct.pack(">iii", 1, size, 1) + bytes((seed,)) + struct.pack(">i", 0)
    model = D.PerceptronModel.parse(blob)
    assert [model(k) for k in keys] == [0.5, 1.5, 2.5] and model("other") == 0
    for bad in (blob[:-1], blob + b"x", b"\x00" + blob[1:]):
        with pytest.raises(ValueError):
            D.PerceptronModel.parse(bad)


def test_groups_of_an_informal_derivation():
    made = Analysis("git_Verb", "git", "Verb", "None", (Morpheme("Verb", "gid"), Morpheme("Fut_Informal", "ice", informal=True, mapped_id="Fut"), Morpheme("A1sg", "m")))
    assert D.word_of(made).groups == ("VerbFutA1sg",)
    derived = Analysis("x", "x", "Noun", "Prop", (Morpheme("Noun", "x"), Morpheme("With", "li", True)))
    assert D.word_of(derived).groups == ("ProperNounNoun", "Noun")


def test_units_with_a_lexicon(morphology):
    raw = "Oyun evlerin oyunlu kitaplar geldi mi?".encode()
    found = units.units_of(raw, provider=morphology, choose=D.Disambiguator(weight))
    by = {raw[u.start : u.end].decode(): u for u in found}
    assert by["evlerin"].status == units.MORPHOLOGICAL and [c - by["evlerin"].start for c in by["evlerin"].cuts] == [2, 5]
    assert by["geldi"].status == units.UNKNOWN and by["geldi"].group == by["mi"].group


def test_numeric_derivations(morphology):
    """The ordinal or distributive suffix after an apostrophe is a morpheme of its own."""
    for token, name, surface in (("3'üncü", "Ord", "üncü"), ("3’ÜNCÜDE", "Ord", "üncü"), ("III'üncü", "Ord", "üncü")):
        found = morphology(token)
        assert found and all((m.id, m.surface) == (name, surface) for m in (a.morphemes[1] for a in found)) and len(found[0].cuts) >= 2
    number = Analysis("18_Num_Card", "18", "Num", "Card", (Morpheme("Num", "18"), Morpheme("With", "li", True)))
    assert [m.surface for m in M.with_numeric_derivation("18'erli", number).morphemes] == ["18", "er", "li"]
    assert [m.id for m in M.with_numeric_derivation("20’ŞER", M.replace(number, morphemes=(Morpheme("Num", "20"),))).morphemes] == ["Num", "Dist"]
    for token in ("18erli", "18'li", "19'erli", "18'erlik"):
        assert M.with_numeric_derivation(token, number) == number


def test_units_by_context_and_by_surface_agree(spark, morphology):
    """The table of units has the analyses that the kernel chose."""
    raw = "Oyun evlerin oyunlu kitaplar geldi mi? 3'üncü oyun."
    docs = spark.createDataFrame([(1, bytearray(raw.encode())), (2, None)], "doc_id long, raw binary")
    made = api.SurfaceTokenizer.train(docs, 300, provider=morphology, disambiguator=D.Disambiguator(weight))
    for contextual in (True, False):
        made.config = units.Config(contextual=contextual)
        wanted = units.units_of(raw.encode(), made.config, morphology, D.Disambiguator(weight))
        found = made.tokenize(docs).orderBy("unit_idx").collect()
        assert [(r["start"], r["end"], r["status"], r["cuts"]) for r in found] == [(u.start, u.end, u.status, u.cuts) for u in wanted]
        assert [r["analysis"] and r["analysis"]["canonical"] for r in found] == [u.analysis and u.analysis.canonical for u in wanted]
        assert b"".join(bytes(r["surface"]) for r in found) == raw.encode()
        ids = made.encode_ids(docs).where("doc_id = 1").first()["ids"]
        assert ids == encode.encode_surface(made.vocabulary, raw.encode(), wanted)[0][1:-1]
