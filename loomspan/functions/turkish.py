"""Turkish letters: case, folding, vowel harmony; Roman and other numerals.

Each function has a plain form for kernels; those of use on columns have a
form of Catalyst expressions with ``_column`` in its name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_FOREIGN = str.maketrans("àáãäåèéêëìíïñòóôõùú", "aaaaaeeeeiiinoooouu")
_CIRCUMFLEX = str.maketrans("âîûÂÎÛ", "aiuAİU")
APOSTROPHES = "'\u2032´`’‘"
VOWELS = "aeıioöuüâîû"
FRONT = "eiöüî"
ROUND = "oöuüû"
VOICELESS = "çfhkpsşt"


def turkish_lower(text: str) -> str:
    return text.replace("I", "ı").replace("İ", "i").lower()


def turkish_capital(text: str) -> str:
    low = turkish_lower(text)
    return ({"i": "İ", "ı": "I"}.get(low[:1]) or low[:1].upper()) + low[1:]


def fold_circumflex(text: str) -> str:
    return text.translate(_CIRCUMFLEX)


def fold_foreign(text: str) -> str:
    """Letters with marks that Turkish lacks, plain; everything else as it is."""
    return text.translate(_FOREIGN)


def fold_apostrophes(text: str) -> str:
    return re.sub(f"[{APOSTROPHES}]", "'", text)


def turkish_lower_column(text: Column) -> Column:
    return F.lower(F.translate(text, "Iİ", "ıi"))


def fold_circumflex_column(text: Column) -> Column:
    return F.translate(text, "âîûÂÎÛ", "aiuAİU")


def harmony(word: str) -> dict[str, bool]:
    """Phonetic features that decide a suffix: of the last vowel and the last letter."""
    low = turkish_lower(word)
    last = next((c for c in reversed(low) if c in VOWELS), "")
    end = low[-1:]
    return {
        "front": last in FRONT and bool(last),
        "back": bool(last) and last not in FRONT,
        "rounded": last in ROUND and bool(last),
        "unrounded": bool(last) and last not in ROUND,
        "ends_vowel": bool(end) and end in VOWELS,
        "ends_consonant": bool(end) and end not in VOWELS,
        "voiceless": bool(end) and end in VOICELESS,
        "one_vowel": sum(c in VOWELS for c in low) == 1,
    }


def a_vowel(word: str) -> str:
    """The open vowel that harmonises."""
    return "e" if harmony(word)["front"] else "a"


def i_vowel(word: str) -> str:
    """The close vowel that harmonises."""
    found = harmony(word)
    return ("ü" if found["rounded"] else "i") if found["front"] else ("u" if found["rounded"] else "ı")


def last_vowel_column(text: Column) -> Column:
    return F.regexp_extract(turkish_lower_column(text), f"([{VOWELS}])[^{VOWELS}]*$", 1)


_ROMAN = re.compile(r"M{0,4}(?:CM|CD|D?C{0,4})(?:XC|XL|L?X{0,4})(?:IX|IV|V?I{0,4})\Z")
_VALUES = (("M", 1000), ("CM", 900), ("D", 500), ("CD", 400), ("C", 100), ("XC", 90), ("L", 50), ("XL", 40), ("X", 10), ("IX", 9), ("V", 5), ("IV", 4), ("I", 1))


def to_roman(value: int) -> str:
    out = []
    for sign, size in _VALUES:
        count, value = divmod(value, size)
        out.append(sign * count)
    return "".join(out)


def from_roman(text: str) -> int | None:
    """Value of a canonical Roman numeral; null for anything else."""
    value, last = 0, 0
    sizes = dict(v for v in _VALUES if len(v[0]) == 1)
    for sign in reversed(text):
        size = sizes.get(sign)
        if size is None:
            return None
        value += -size if size < last else size
        last = max(last, size)
    return value if text and to_roman(value) == text else None


_INT = r"[+-]?[0-9]+"
_NUMERAL = (
    ("cardinal", _INT),
    ("ordinal", _INT + r"\."),
    ("range", _INT + r"-[0-9]+"),
    ("ratio", _INT + r"/[0-9]+"),
    ("real", _INT + r"[.,][0-9]+"),
    ("distribution", r"[0-9]+[^0-9]+"),
    ("percentage", r"[+-]?%[+-]?[0-9]+(?:[.,][0-9]+)?"),
    ("clock", r"\+?0*(?:[1-9]|[12][0-9])[:.][0-5][0-9]"),
    ("date", r"\+?0*[1-3]?[0-9]\.\+?0*1?[0-9]\.[0-9]{4}|\+?0*[1-3]?[0-9]/\+?0*1?[0-9]/[0-9]{4}"),
)


def numeral_classes(text: str) -> list[str]:
    """Every class that a numeral falls under, in a fixed order."""
    return [name for name, pattern in _NUMERAL if re.fullmatch(pattern, text)]


def numeral_classes_column(text: Column) -> Column:
    named = [F.when(text.rlike(f"^(?:{pattern})$"), F.lit(name)) for name, pattern in _NUMERAL]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def java_hash(text: str) -> int:
    """Java's ``String.hashCode``, over UTF-16 units, as a signed 32-bit number."""
    data = text.encode("utf-16-le", "surrogatepass")
    value = 0
    for k in range(0, len(data), 2):
        value = (31 * value + data[k] + 256 * data[k + 1]) & 0xFFFFFFFF
    return value - (1 << 32) if value >> 31 else value


def rehash(value: int) -> int:
    """Spreads a hash by the golden ratio, as an unsigned number."""
    made = (value * 0x9E3779B9) & 0xFFFFFFFF
    signed = made - (1 << 32) if made >> 31 else made
    return (signed ^ (signed >> 16)) & 0x7FFFFFFF


def mphf_hash(text: str, seed: int = 0) -> int:
    """Multiplicative hash of UTF-16 units, the levels of a perfect hash apart by their seed."""
    data = text.encode("utf-16-le", "surrogatepass")
    value = seed or 0x811C9DC5
    for k in range(0, len(data), 2):
        value = ((value ^ (data[k] + 256 * data[k + 1])) * 16777619) & 0xFFFFFFFF
    return value & 0x7FFFFFFF


def dotted_abbreviation(text: str) -> bool:
    """Letters that each end in a dot, two at least, perhaps with an apostrophe suffix."""
    head = re.split(f"[{APOSTROPHES}]", text, maxsplit=1)[0]
    return bool(re.fullmatch(r"(?:[^\W\d_]\.){2,}", head))


def is_turkish_letter(char: str) -> bool:
    return char in _ALPHABET


CLASS_SHORT = dict(zip((n for n, _ in _NUMERAL), ("Card", "Ord", "Range", "Ratio", "Real", "Dist", "Percent", "Clock", "Date")))
_ONES = "sıfır bir iki üç dört beş altı yedi sekiz dokuz".split()
_TENS = ["", *"on yirmi otuz kırk elli altmış yetmiş seksen doksan".split()]
_LARGE = ("yüz", "bin", "bin", "bin", "milyon", "milyon", "milyon", "milyar", "milyar", "milyar")
_ORDINALS = dict(
    zip(
        [*_ONES, *_TENS[1:], "yüz", "bin", "milyon", "milyar"],
        "sıfırıncı birinci ikinci üçüncü dördüncü beşinci altıncı yedinci sekizinci dokuzuncu onuncu yirminci otuzuncu kırkıncı ellinci "
        "altmışıncı yetmişinci sekseninci doksanıncı yüzüncü bininci milyonuncu milyarıncı".split(),
    )
)


def number_word(digits: str, ordinal: bool = False) -> str:
    """The word that a number is read with last; empty if there is none."""
    zeros, seen, found = 0, False, None
    for char in reversed(digits):
        if not ("0" <= char <= "9"):
            found = "sıfır" if zeros >= 2 else None
            break
        seen = True
        if char == "0":
            zeros += 1
            continue
        value = int(char)
        found = (_ONES[value], _TENS[value], *_LARGE)[zeros] if zeros < 12 else ""
        break
    if found is None:
        found = "" if not seen else "sıfır" if zeros < 2 else _LARGE[zeros - 2] if zeros < 12 else ""
    return _ORDINALS.get(found, found) if ordinal else found


def split_apostrophe(text: str) -> tuple[str, str, str]:
    """Before, the mark, after; both latter empty without one."""
    found = re.search(f"[{APOSTROPHES}]", text)
    return (text[: found.start()], found[0], text[found.end() :]) if found else (text, "", "")


def split_number(text: str) -> tuple[str, str]:
    """A number and the suffix after it, with or without an apostrophe."""
    stem, mark, ending = split_apostrophe(text)
    if mark:
        return stem, ending
    cut = len(text)
    while cut and not (text[cut - 1] == "." or "0" <= text[cut - 1] <= "9"):
        cut -= 1
    return text[:cut], text[cut:]


def is_web_address(text: str) -> bool:
    low = split_apostrophe(text)[0].lower()
    if low.startswith(("http://", "https://", "www.")):
        return len(low) > 4 and "." in low
    return any(end in low.split("/")[0] for end in (".com", ".org", ".edu", ".gov", ".net", ".info"))


_SPELLED = dict(zip("aeıioöuü", "aeıioöuü")) | {c: c + "e" for c in "bcçdfghjklmnprsştvyz"} | {"ğ": "yumuşakge", "w": "dabılyu", "q": "kü", "x": "iks"}


def spelled(text: str) -> str:
    """Letters by their names, one after another."""
    return "".join("ka" if c == "k" and i == len(text) - 1 else _SPELLED.get(c, "") for i, c in enumerate(text))


def component(text: str) -> str:
    """A part of a name in Turkish letters, other signs as question marks."""
    low = fold_foreign(fold_circumflex(turkish_lower(text)))
    return "".join(c if c in _ALPHABET or c in ".-" else "?" for c in low)


_ALPHABET = frozenset("abcçdefgğhıijklmnoöprsştuüvyzqwx")
