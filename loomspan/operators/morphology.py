"""Morphological analysis: a search over a graph of states and suffix templates.

A ``Bundle`` is five tables of records (morphemes, dictionary, stems, states,
edges). ``Morphology`` compiles it once and is then a provider of analyses for
the tokenisation operators: give it the *distinct* surfaces of a corpus, or let
a task's own memory of surfaces do so, and join back.
"""

from __future__ import annotations

import hashlib
import json
import pathlib
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import turkish as T
from loomspan.operators.quality import Analysis, Morpheme
from loomspan.session import shipped

PHONETIC = (
    "LastLetterVowel", "LastLetterConsonant", "LastVowelFrontal", "LastVowelBack", "LastVowelRounded", "LastVowelUnrounded",
    "LastLetterVoiceless", "LastLetterVoiced", "LastLetterVoicelessStop", "FirstLetterVowel", "FirstLetterConsonant", "HasNoVowel",
    "ExpectsVowel", "ExpectsConsonant", "ModifiedPronoun", "UnModifiedPronoun", "LastLetterDropped", "CannotTerminate",
)
BIT = {name: 1 << k for k, name in enumerate(PHONETIC)}
_VOWELS = "aeıioöuüâîû"
_DEVOICED = str.maketrans("bcdgğ", "pçtkk")
MOST_PATHS, MOST_NODES, MOST_RESULTS = 250_000, 2_000_000, 100_000
TABLES = ("morphemes", "dictionary", "stems", "states", "edges")
FIELDS = {
    "morphemes": {"id", "name", "pos", "derivational", "informal", "mapped_id"},
    "dictionary": {"id", "lemma", "root", "pronunciation", "primary_pos", "secondary_pos", "attributes", "reference_id", "index"},
    "stems": {"surface", "source_order", "dictionary_id", "target_state", "phonetic_bits"},
    "states": {"key", "morpheme_id", "terminal", "derivative", "pos_root"},
    "edges": {"id", "source_order", "owner_state", "to_state", "morpheme_id", "template_tokens", "condition"},
}


class BundleError(ValueError):
    """A bundle whose records don't fit each other."""


class LimitError(RuntimeError):
    """A search that went beyond its bounds."""


def attributes(surface: str, before: int = 0) -> int:
    """Phonetic bits after a surface, given those before it."""
    if not surface:
        return before
    low = T.turkish_lower(surface)
    last_vowel = next((c for c in reversed(low) if c in _VOWELS), None)
    if last_vowel is None:
        bits = before | BIT["LastLetterConsonant"] | BIT["FirstLetterConsonant"] | BIT["HasNoVowel"]
        bits &= ~(BIT["LastLetterVowel"] | BIT["ExpectsConsonant"])
    else:
        bits = BIT["LastLetterVowel" if low[-1] in _VOWELS else "LastLetterConsonant"]
        bits |= BIT["LastVowelFrontal" if last_vowel in T.FRONT else "LastVowelBack"]
        bits |= BIT["LastVowelRounded" if last_vowel in T.ROUND else "LastVowelUnrounded"]
        bits |= BIT["FirstLetterVowel" if low[0] in _VOWELS else "FirstLetterConsonant"]
    if low[-1] in T.VOICELESS:
        bits |= BIT["LastLetterVoiceless"]
        if low[-1] in "çkpt":
            bits |= BIT["LastLetterVoicelessStop"]
    else:
        bits |= BIT["LastLetterVoiced"]
    return bits


def realise(template: tuple[tuple[str, str], ...], before: int) -> str:
    """The surface of a suffix template after something with these phonetic bits."""
    out = ""
    for place, (kind, letter) in enumerate(template):
        now = attributes(out, before)
        if kind in ("A_WOVEL", "I_WOVEL"):
            if place == 0 and before & BIT["LastLetterVowel"]:
                continue
            front, back = now & BIT["LastVowelFrontal"], now & BIT["LastVowelBack"]
            if kind == "A_WOVEL":
                if not (front or back):
                    raise BundleError("no vowel to harmonise with")
                out += "a" if back else "e"
                continue
            rounded, plain = now & BIT["LastVowelRounded"], now & BIT["LastVowelUnrounded"]
            found = "i" if front and plain else "ı" if back and plain else "u" if back and rounded else "ü" if front and rounded else None
            if found is None:
                raise BundleError("no vowel to harmonise with")
            out += found
        elif kind == "DEVOICE_FIRST":
            out += letter.translate(_DEVOICED) if now & BIT["LastLetterVoiceless"] else letter
        elif kind == "APPEND":
            if now & BIT["LastLetterVowel"]:
                out += letter
        else:
            out += letter
    return out


_SIGNS = {"APPEND": "+", "DEVOICE_FIRST": ">", "LAST_VOICED": "~", "LAST_NOT_VOICED": "!", "LETTER": ""}


def template_text(tokens: Iterable[dict]) -> str:
    """A template as it is written: vowels as capitals, signs before letters."""
    out = []
    for token in tokens:
        kind, letter, append = token["type"], token["letter"], token["append"]
        if kind in ("A_WOVEL", "I_WOVEL"):
            if letter:
                raise BundleError("a harmonising vowel has no letter")
            out.append("+" * append + kind[0])
        elif kind in _SIGNS:
            if append or len(letter) != 1:
                raise BundleError("a template letter is one character and isn't appended")
            out.append(_SIGNS[kind] + letter)
        else:
            raise BundleError(f"unknown template token {kind}")
    return "".join(out)


def parse_template(text: str) -> tuple[tuple[str, str], ...]:
    """(kind, letter) of a written template."""
    signs = {v: k for k, v in _SIGNS.items() if v}
    out, at = [], 0
    while at < len(text):
        sign = signs.get(text[at])
        if sign and text[at + 1 : at + 2] in ("A", "I") and sign == "APPEND":
            out.append((text[at + 1] + "_WOVEL", ""))
            at += 2
        elif sign:
            out.append((sign, text[at + 1]))
            at += 2
        else:
            out.append((text[at] + "_WOVEL", "") if text[at] in "AI" else ("LETTER", text[at]))
            at += 1
    return tuple(out)


def condition_count(condition: dict | None) -> int:
    """Size of a condition: children of combinations add up, a negation is one."""
    if condition is None:
        return 0
    if condition["kind"] in ("AND", "OR"):
        return sum(map(condition_count, condition["children"]))
    return 1


@dataclass(frozen=True, slots=True)
class Node:
    parent: Node | None
    state: str
    morpheme: str
    surface: str
    derivative: bool
    depth: int

    def back(self) -> Iterable[Node]:
        node = self
        while node is not None:
            yield node
            node = node.parent

    def suffixes(self) -> Iterable[Node]:
        """From here back to, but without, the root."""
        return (n for n in self.back() if n.parent is not None)


@dataclass(frozen=True, slots=True)
class Path:
    node: Node
    item: str
    stem: str
    at: int
    bits: int
    derived: bool = False
    voiced: bool = False


def _group(start: Node | None, found: Callable[[Node], bool]) -> bool:
    """Whether a node of the group that ends here will do; its derivation counts, the root doesn't."""
    for node in start.suffixes() if start else ():
        if found(node):
            return True
        if node.derivative:
            return False
    return False


def _before_group(node: Node) -> Node | None:
    return next((n.parent for n in node.suffixes() if n.derivative), None)


def _last_derivation(node: Node) -> str | None:
    return next((n.state for n in node.suffixes() if n.derivative), None)


def _silent(node: Node) -> bool:
    for n in node.suffixes():
        if n.derivative:
            return True
        if n.surface:
            return False
    return True


Test = Callable[[Path, bool], bool]


def compile_condition(c: dict, items: dict[str, dict]) -> Test:
    """A condition tree as a function of a path and of whether text is left."""
    kind = c["kind"]
    if kind in ("AND", "OR"):
        if len(c["children"]) < 2:
            raise BundleError("a combination has two children at least")
        parts = [compile_condition(x, items) for x in c["children"]]
        every = all if kind == "AND" else any
        return lambda p, t: every([f(p, t) for f in parts])
    if kind == "NOT":
        inner = compile_condition(c["child"], items)
        return lambda p, t: not inner(p, t)
    before = lambda p: p.node.parent
    one = next((c[k] for k in ("attribute", "item", "pos", "morpheme", "state", "surface") if k in c), None)
    many = next((c[k] for k in ("attributes", "items", "morphemes", "states", "surfaces") if k in c), ())
    few = frozenset(x for x in many if x is not None)
    bit = BIT.get(one, 0) if kind == "HasPhoneticAttribute" else 0
    tests: dict[str, Test] = {
        "HasRootAttribute": lambda p, t: one in items[p.item]["attributes"],
        "HasAnyRootAttribute": lambda p, t: not few.isdisjoint(items[p.item]["attributes"]),
        "HasPhoneticAttribute": lambda p, t: bool(p.bits & bit),
        "DictionaryItemIs": lambda p, t: p.item == one,
        "RootPrimaryPosIs": lambda p, t: items[p.item]["primary_pos"] == one,
        "SecondaryPosIs": lambda p, t: items[p.item]["secondary_pos"] == one,
        "DictionaryItemIsAny": lambda p, t: p.item in few,
        "DictionaryItemIsNone": lambda p, t: p.item not in few,
        "HasAnySuffixSurface": lambda p, t: p.voiced,
        "HasTail": lambda p, t: t,
        "HasNoTail": lambda p, t: not t,
        "HasTailSequence": lambda p, t: [n.morpheme for n, _ in zip(p.node.back(), many)] == list(reversed(many)),
        "ContainsMorphemeSequence": lambda p, t: _contains([n.morpheme for n in p.node.back()][::-1], list(many)),
        "CurrentMorphemeIs": lambda p, t: p.node.morpheme == one,
        "PreviousMorphemeIs": lambda p, t: before(p) is not None and before(p).morpheme == one,
        "PreviousStateIs": lambda p, t: before(p) is not None and before(p).state == one,
        "PreviousStateIsNot": lambda p, t: before(p) is None or before(p).state != one,
        "RootSurfaceIs": lambda p, t: p.stem == one,
        "RootSurfaceIsAny": lambda p, t: p.stem in few,
        "CurrentStateIs": lambda p, t: p.node.state == one,
        "CurrentStateIsNot": lambda p, t: p.node.state != one,
        "LastDerivationIs": lambda p, t: _last_derivation(p.node) == one,
        "HasDerivation": lambda p, t: p.derived,
        "LastDerivationIsAny": lambda p, t: _last_derivation(p.node) in few,
        "CurrentGroupContainsAny": lambda p, t: _group(p.node, lambda n: n.state in few),
        "PreviousGroupContains": lambda p, t: _group(_before_group(p.node), lambda n: n.state in few),
        "PreviousGroupContainsMorpheme": lambda p, t: _group(_before_group(p.node), lambda n: n.morpheme in few),
        "NoSurfaceAfterDerivation": lambda p, t: _silent(p.node),
        "ContainsMorpheme": lambda p, t: any(n.morpheme in few for n in p.node.back()),
        "PreviousMorphemeIsAny": lambda p, t: before(p) is not None and before(p).morpheme in few,
        "CurrentMorphemeIsAny": lambda p, t: p.node.morpheme in few,
        "PreviousStateIsAny": lambda p, t: before(p) is not None and before(p).state in few,
    }
    if kind not in tests:
        raise BundleError(f"unknown condition {kind}")
    if kind == "HasPhoneticAttribute" and not bit:
        raise BundleError(f"unknown phonetic attribute {one}")
    return tests[kind]


def _contains(values: list, part: list) -> bool:
    return bool(part) and any(values[k : k + len(part)] == part for k in range(len(values) - len(part) + 1))


@dataclass(frozen=True)
class Bundle:
    """The five tables as lists of records."""

    morphemes: tuple[dict, ...]
    dictionary: tuple[dict, ...]
    stems: tuple[dict, ...]
    states: tuple[dict, ...]
    edges: tuple[dict, ...]

    @staticmethod
    def read(folder: str) -> Bundle:
        """From a folder of JSON lines, a file for each table."""
        made = {}
        for name in TABLES:
            lines = pathlib.Path(folder, f"{name}.jsonl").read_text(encoding="utf-8").splitlines()
            made[name] = tuple(json.loads(line) for line in lines if line.strip())
        return Bundle(**made)

    def problems(self) -> list[str]:
        """Everything that is wrong with it: missing fields, repeated keys, references to nothing."""
        out = []
        for name, fields in FIELDS.items():
            out += [f"{name}: {sorted(fields - set(r))} missing" for r in getattr(self, name) if not fields <= set(r)]
        if out:
            return out
        keys = {"morphemes": "id", "dictionary": "id", "states": "key", "edges": "id"}
        known = {name: [r[key] for r in getattr(self, name)] for name, key in keys.items()}
        out += [f"{name}: repeated keys" for name, values in known.items() if len(set(values)) != len(values)]
        morphemes, items, states = (set(known[n]) for n in ("morphemes", "dictionary", "states"))
        links = [("morphemes", "mapped_id", morphemes), ("dictionary", "reference_id", items), ("stems", "dictionary_id", items), ("stems", "target_state", states)]
        links += [("states", "morpheme_id", morphemes), ("edges", "owner_state", states), ("edges", "to_state", states), ("edges", "morpheme_id", morphemes)]
        for name, field, among in links:
            out += [f"{name}: {field} {r[field]} isn't known" for r in getattr(self, name) if r[field] is not None and r[field] not in among]
        target = {s["key"]: s["morpheme_id"] for s in self.states}
        for edge in self.edges:
            if target.get(edge["to_state"]) != edge["morpheme_id"]:
                out.append(f"edges: {edge['id']} has another morpheme than its target")
            if "surface_template" in edge and template_text(edge["template_tokens"]) != edge["surface_template"]:
                out.append(f"edges: {edge['id']} has another template than its tokens")
            if "condition_count" in edge and condition_count(edge["condition"]) != edge["condition_count"]:
                out.append(f"edges: {edge['id']} has another number of conditions")
        return out


def bundle_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """A bundle as DataFrames; conditions stay JSON text, as they nest without bound."""
    out = {}
    for name in TABLES:
        rows = spark.read.text(f"{folder}/{name}.jsonl").where("trim(value) <> ''")
        keys = sorted(FIELDS[name])
        out[name] = rows.selectExpr(*[f"get_json_object(value, '$.{k}') AS `{k}`" for k in keys])
    return out


class Morphology:
    """A compiled bundle. Calling it analyses a surface, remembering what it has seen."""

    def __init__(self, bundle: Bundle, check: bool = True, remember: int = 200_000):
        wrong = bundle.problems() if check else []
        if wrong:
            raise BundleError("; ".join(wrong[:5]))
        self.bundle, self.remember = bundle, remember
        self.items = {d["id"]: d for d in bundle.dictionary}
        self.morphemes = {m["id"]: m for m in bundle.morphemes}
        self.states = {s["key"]: s for s in bundle.states}
        self.stems: dict[str, list[dict]] = {}
        for stem in sorted(bundle.stems, key=lambda s: s["source_order"]):
            self.stems.setdefault(stem["surface"], []).append(stem)
        self.longest = max(map(len, self.stems), default=0)
        self.edges: dict[str, list[tuple]] = {}
        for edge in sorted(bundle.edges, key=lambda e: e["source_order"]):
            template = tuple((t["type"], t["letter"]) for t in edge["template_tokens"])
            test = compile_condition(edge["condition"], self.items) if edge["condition"] else None
            self.edges.setdefault(edge["owner_state"], []).append((edge["to_state"], edge["morpheme_id"], template, test))
        self.known: dict[str, list[Analysis]] = {}
        self._by_sound: dict[tuple, tuple[str, str]] | None = None

    def digest(self) -> str:
        """One number for all tables of the lexicon."""
        tables = {name: list(getattr(self.bundle, name)) for name in TABLES}
        return hashlib.sha256(json.dumps(tables, sort_keys=True).encode()).hexdigest()

    def __getstate__(self):
        return {"bundle": self.bundle, "remember": self.remember}

    def __setstate__(self, state):
        self.__init__(state["bundle"], False, state["remember"])

    def __call__(self, surface: str) -> list[Analysis]:
        found = self.known.get(surface)
        if found is None:
            if len(self.known) >= self.remember:
                self.known.clear()
            found = self.known[surface] = self.analyse_token(surface)
        return found

    def _start(self, stem: dict, at: int) -> Path:
        state = self.states[stem["target_state"]]
        node = Node(None, state["key"], state["morpheme_id"], stem["surface"], state["derivative"], 1)
        return Path(node, stem["dictionary_id"], stem["surface"], at, stem["phonetic_bits"])

    def _ends(self, path: Path) -> bool:
        return self.states[path.node.state]["terminal"] and not path.bits & BIT["CannotTerminate"]

    def _step(self, path: Path, target: str, morpheme: str, surface: str, template: tuple, bits: int, size: int) -> Path:
        if surface:
            bits &= ~BIT["CannotTerminate"]
            if template[-1][0] == "LAST_VOICED":
                bits |= BIT["ExpectsConsonant"]
            elif template[-1][0] == "LAST_NOT_VOICED":
                bits |= BIT["ExpectsVowel"] | BIT["CannotTerminate"]
        derivative = self.states[target]["derivative"]
        node = Node(path.node, target, morpheme, surface, derivative, path.node.depth + 1)
        return Path(node, path.item, path.stem, path.at + size, bits, path.derived or derivative, path.voiced or bool(surface))

    def analyse(self, text: str) -> list[Analysis]:
        """Of a normalised surface without an apostrophe, in the order in which paths end."""
        current = [self._start(s, n) for n in range(1, min(len(text), self.longest) + 1) for s in self.stems.get(text[:n], ())]
        done: list[Path] = []
        nodes = len(current)
        while current:
            following = []
            for path in current:
                tail = text[path.at :]
                if not tail and self._ends(path):
                    done.append(path)
                    continue
                for target, morpheme, template, test in self.edges.get(path.node.state, ()):
                    if template and not tail:
                        continue
                    surface = realise(template, path.bits)
                    if not tail.startswith(surface) or (test and not test(path, bool(tail))):
                        continue
                    bits = path.bits if not surface or tail == surface else attributes(surface, path.bits)
                    following.append(self._step(path, target, morpheme, surface, template, bits, len(surface)))
            nodes += len(following)
            if len(following) > MOST_PATHS or nodes > MOST_NODES or len(done) > MOST_RESULTS:
                raise LimitError(f"the search for {text!r} went beyond its bounds")
            current = following
        return [self._analysis(p) for p in done]

    def _analysis(self, path: Path) -> Analysis:
        item = self.items[path.item]
        if "Dummy" in item["attributes"]:
            item = self.items[item["reference_id"]]
        parts = []
        for node in list(path.node.back())[::-1]:
            if node.morpheme in ("Nom", "Pnon"):
                continue
            m = self.morphemes[node.morpheme]
            parts.append(Morpheme(m["id"], node.surface, m["derivational"], m["informal"], m["pos"], m["mapped_id"]))
        return Analysis(item["id"], item["lemma"], item["primary_pos"], item["secondary_pos"], tuple(parts))

    def generate(self, item: str, morphemes: list[str]) -> list[Analysis]:
        """Surfaces of a dictionary item with these morphemes in order; silent ones may come between."""
        if item not in self.items or any(m not in self.morphemes for m in morphemes):
            raise BundleError("unknown dictionary item or morpheme")
        current = []
        for stems in self.stems.values():
            for stem in stems:
                if stem["dictionary_id"] == item:
                    path = self._start(stem, 0)
                    current.append((path, int(bool(morphemes) and morphemes[0] == path.node.morpheme)))
        done, nodes = [], len(current)
        while current:
            following = []
            for path, used in current:
                if used == len(morphemes) and self._ends(path):
                    done.append(path)
                    continue
                for target, morpheme, template, test in self.edges.get(path.node.state, ()):
                    wanted = used < len(morphemes) and morphemes[used] == morpheme
                    if (template and not wanted) or (test and not test(path, True)):
                        continue
                    surface = realise(template, path.bits)
                    bits = attributes(surface, path.bits)
                    following.append((self._step(path, target, morpheme, surface, template, bits, 0), used + wanted))
            nodes += len(following)
            if len(following) > MOST_PATHS or nodes > MOST_NODES or len(done) > MOST_RESULTS:
                raise LimitError("the generation went beyond its bounds")
            current = following
        return [self._analysis(p) for p in done]

    def _static(self, text: str) -> list[Analysis]:
        stem, mark, ending = T.split_apostrophe(text)
        if not mark:
            return self.analyse(text)
        if not stem or not ending:
            return []
        return [a for a in self.analyse(stem + ending) if a.primary_pos == "Noun" and (a.stem == stem or any(m.id == "P3sg" for m in a.morphemes))]

    def analyse_token(self, token: str) -> list[Analysis]:
        """Analyses of a surface as it stands in a text, with their cuts in it.

        What the lexicon doesn't know is analysed as a web address, Roman numeral,
        dotted abbreviation, number or proper noun, with the suffixes that a
        lexicon word of the same sound takes.
        """
        low = T.fold_circumflex(T.turkish_lower(token))
        plain = T.fold_apostrophes(low.replace(".", "") or low)
        found = self._static(plain) or self._made_up(T.fold_apostrophes(token))
        out = []
        for analysis in found:
            analysis = with_numeric_derivation(token, analysis)
            cuts = align(token, analysis)
            if cuts is not None:
                out.append(replace(analysis, cuts=cuts))
        return out

    def _made_up(self, token: str) -> list[Analysis]:
        stem, mark, ending = T.split_apostrophe(token)
        if T.is_web_address(token) and (made := self._web(token, stem, mark, ending)):
            return made
        if T.from_roman(stem.removesuffix(".")) is not None and (made := self._roman(stem, ending)):
            return made
        if T.dotted_abbreviation(token) and ending and (made := self._abbreviation(token, stem, ending)):
            return made
        low = T.turkish_lower(token)
        if any(c in "0123456789" for c in low) and (made := self._number(low)):
            return made
        return self._proper(low) if mark else []

    def _borrowed(self, sound: str, state: str, ending: str) -> list[Analysis]:
        """Analyses of a lexicon noun with the same phonetic bits and this ending; of several, the first."""
        if self._by_sound is None:
            self._by_sound = {}
            for stems in self.stems.values():
                for stem in stems:
                    item = self.items[stem["dictionary_id"]]
                    if item["primary_pos"] == "Noun" and "Dummy" not in item["attributes"]:
                        self._by_sound.setdefault((stem["phonetic_bits"], stem["target_state"]), (stem["surface"], item["id"]))
        found = self._by_sound.get((attributes(sound), state))
        return [a for a in self.analyse(found[0] + ending) if a.dictionary_id == found[1] and a.stem == found[0]] if found else []

    def _rooted(self, found: list[Analysis], ident: str, lemma: str, primary: str, secondary: str, root: str) -> list[Analysis]:
        made = (Analysis(ident, lemma, primary, secondary, (replace(a.morphemes[0], surface=root), *a.morphemes[1:])) for a in found)
        return list(dict.fromkeys(made))

    def _web(self, token: str, stem: str, mark: str, ending: str) -> list[Analysis]:
        fold = lambda t: T.fold_circumflex(T.turkish_lower(t))
        lemma, root = (stem, fold(stem).replace(".", "")) if mark else (fold(token), fold(token))
        sound = "".join(filter(T.is_turkish_letter, root))
        if not any(c in _VOWELS for c in sound):
            return []
        return self._rooted(self._borrowed(sound, "nounProper_S", fold(ending)), f"{lemma}_Noun_Url", lemma, "Noun", "Url", root)

    def _numeral_source(self, word: str, ending: str) -> list[Analysis]:
        if word == "dört" and ending[:1] and ending[0] in _VOWELS:
            word = "dörd"
        return [a for a in self.analyse(word + ending) if a.primary_pos == "Num"] if word else []

    def _roman(self, stem: str, ending: str) -> list[Analysis]:
        word = T.number_word(str(T.from_roman(stem.removesuffix("."))), stem.endswith("."))
        found = self._numeral_source(word, T.fold_circumflex(T.turkish_lower(ending)))
        return self._rooted(found, f"{stem}_Num_RomanNumeral", stem, "Num", "RomanNumeral", stem)

    def _abbreviation(self, token: str, stem: str, ending: str) -> list[Analysis]:
        root = T.fold_circumflex(T.turkish_lower(stem)).replace(".", "")
        sound = root if any(c in _VOWELS for c in root) else T.spelled(root)
        if not any(c in _VOWELS for c in sound):
            return []
        lemma = T.turkish_capital(token)
        found = self._borrowed(sound, "nounAbbrv_S", T.fold_circumflex(T.turkish_lower(ending)))
        return self._rooted(found, f"{lemma}_Noun_Abbrv", lemma, "Noun", "Abbrv", root)

    def _number(self, low: str) -> list[Analysis]:
        stem, ending = T.split_number(low)
        kinds = T.numeral_classes(stem)
        found = self._numeral_source(T.number_word(stem.rstrip("."), stem.endswith(".")), ending) if kinds else []
        out = [a for k in kinds for a in self._rooted(found, f"{stem}_Num_{T.CLASS_SHORT[k]}", stem, "Num", T.CLASS_SHORT[k], stem)]
        return list(dict.fromkeys(out))

    def _proper(self, low: str) -> list[Analysis]:
        stem, _, ending = T.split_apostrophe(low)
        if not stem or not ending:
            return []
        stem, ending = T.component(stem).replace(".", ""), T.component(ending)
        if not any(c in _VOWELS for c in stem):
            return []
        lemma = T.turkish_capital(low)
        made = self._rooted(self._borrowed(stem, "nounProper_S", ending), f"{lemma}_Noun_Prop", lemma, "Noun", "Prop", stem)
        return list(dict.fromkeys([*made, *(a for a in self.analyse(stem + ending) if a.stem == stem)]))


_ORDINAL = re.compile("[ıiuü]?nc[ıiuü]")
_ORDINALS = frozenset(v + "nc" + w for v, w in zip("ıiuü", "ıiuü")) | frozenset("nc" + w for w in "ıiuü")
_DISTRIBUTIVE = re.compile("ş?[ae]r")


def with_numeric_derivation(token: str, analysis: Analysis) -> Analysis:
    """A number's analysis with the ordinal or distributive suffix after its apostrophe, where it lacks that one."""
    stem, mark, suffix = T.split_apostrophe(token)
    if analysis.primary_pos != "Num" or not mark or analysis.stem != stem:
        return analysis
    low = _lowered(suffix)
    found = _ORDINAL.match(low) if low else None
    if found and found[0] in _ORDINALS:
        part = Morpheme("Ord", found[0], derivational=True, pos="Adj")
    elif low and (found := _DISTRIBUTIVE.match(low)):
        part = Morpheme("Dist", found[0], derivational=True, pos="Num")
    else:
        return analysis
    rest = analysis.morphemes[1:]
    if any(m.id == part.id for m in analysis.morphemes) or _lowered("".join(m.surface for m in rest)) != low[len(part.surface) :]:
        return analysis
    return replace(analysis, morphemes=(analysis.morphemes[0], part, *rest))


def _lowered(text: str) -> str | None:
    """Lower case, each character one; null where one becomes several."""
    out = [{"I": "ı", "İ": "i"}.get(c) or c.lower() for c in text]
    return "".join(out) if all(len(c) == 1 for c in out) else None


def _plain(text: str) -> str | None:
    out = []
    for char in text:
        low = {"I": "ı", "İ": "i"}.get(char) or char.lower()
        if len(low) != 1:
            return None
        out.append(T.fold_circumflex(low))
    return "".join(out)


def same_letters(actual: str, expected: str) -> bool:
    """Equal, or equal after folding marks that Turkish lacks, or other signs to question marks."""
    if actual == expected:
        return True
    folded = T.fold_foreign(actual)
    return folded == expected or "".join(c if T.is_turkish_letter(c) or c in ".-" else "?" for c in folded) == expected


def align(token: str, analysis: Analysis) -> tuple[int, ...] | None:
    """Byte offsets in a token at which its morphemes meet; null if the letters don't fit.

    Apostrophes belong to no morpheme and are cut off on both sides; dots of
    abbreviations belong to none either.
    """
    dots = analysis.secondary_pos == "RegAbbrv" or T.dotted_abbreviation(token)
    letters, ends, cuts, at = [], [], set(), 0
    for char in token:
        begin, at = at, at + len(char.encode())
        if char in "'‘’ʼ＇":
            cuts.update((begin, at))
        elif not (dots and char == "."):
            letters.append(char)
            ends.append(at)
    actual, wanted = _plain("".join(letters)), [_plain(m.surface) for m in analysis.morphemes]
    if actual is None or None in wanted or not same_letters(actual, "".join(wanted)):
        return None
    place = 0
    for part in wanted:
        place += len(part)
        if part and place < len(letters):
            cuts.add(ends[place - 1])
    return tuple(sorted(c for c in cuts if 0 < c < at))


def surface_analyses(surfaces: DataFrame, morphology: Morphology) -> DataFrame:
    """``surface``, ``n``, ``cuts``, ``ids`` of the analyses of distinct surfaces."""

    def kernel(batches):
        for batch in batches:
            found = [morphology(s) if s is not None else [] for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(f) for f in found], pa.int32()),
                    pa.array([[list(a.cuts) for a in f] for f in found], pa.list_(pa.list_(pa.int32()))),
                    pa.array([[a.canonical for a in f] for f in found], pa.list_(pa.string())),
                ],
                names=["surface", "n", "cuts", "ids"],
            )

    return shipped(surfaces).select("surface").distinct().mapInArrow(kernel, "surface string, n int, cuts array<array<int>>, ids array<string>")


def store_analyses(surfaces: DataFrame, morphology: Morphology, path: str) -> None:
    """Compile the analyses of distinct surfaces to a table, with the lexicon's digest in each row."""
    made = surface_analyses(surfaces, morphology).withColumn("lexicon", F.lit(morphology.digest()))
    made.write.mode("errorifexists").parquet(path)


def stored_analyses(spark: SparkSession, path: str, morphology: Morphology, recompute: bool = True) -> DataFrame:
    """A compiled table, after making sure that it is this lexicon's.

    Raises where its digest is another one, or where, with ``recompute``, analysing
    its surfaces again gives other rows.
    """
    table = spark.read.parquet(path)
    foreign = table.where(~F.col("lexicon").eqNullSafe(F.lit(morphology.digest()))).head(1)
    if foreign:
        raise BundleError("the table was compiled from another lexicon")
    table = table.drop("lexicon")
    if recompute and differences(surface_analyses(table, morphology), table).head(1):
        raise BundleError("the table has other analyses than the lexicon gives")
    return table


def differences(computed: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows that only one of two tables with the same columns has, as often as it has more of them; ``side`` tells which."""
    other = expected.select(computed.columns)
    return computed.exceptAll(other).withColumn("side", F.lit("computed")).unionByName(other.exceptAll(computed).withColumn("side", F.lit("expected")))
