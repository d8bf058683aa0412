"""Code regions in mixed text: fences, inline artifacts and unmarked blocks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import islice

import pyarrow as pa
from loomspan.operators.scan import batches_by_size
from loomspan.session import shipped
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STRONG, MODERATE, PAIR, REACH = 7, 3, 8, 2

Span = tuple[int, int]

#: Pieces between white space that have a sign without which they are no artifact.
_PLAIN = rb"[^\x00-\x20\x7f`@=0-9_:w]*+"
_PIECE = re.compile(rb"(?<![^\x00-\x20\x7f`])" + _PLAIN + rb"(?:w(?!ww\.)" + _PLAIN + rb")*+[@=0-9_:w][^\x00-\x20\x7f`]*+")
_URL = re.compile(rb"(?:https?://|ftp://|www\.)")
_ASSIGNMENT = re.compile(rb"([A-Za-z_][A-Za-z0-9_.\-]*)=[^=]", re.S)
_ASSIGNED = frozenset(b"id key url path host port status error level time date".split())
_TIMESTAMP = re.compile(rb"[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}[0-9.,+\-:Zz]*\Z")
_LITERAL = re.compile(
    rb"[+-]?(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+"
    rb"|[0-9_]+(?:\.[0-9_]+)?(?:[eE][+-]?[0-9_]+(?:[fFiIuU][0-9]+)?|[fFiIuU][0-9]+))\Z"
)
_PREFIXED = re.compile(rb"[+-]?0[xXbBoO]")


def is_url(piece: bytes) -> bool:
    return len(piece) > 8 and bool(_URL.match(piece))


def is_email(piece: bytes) -> bool:
    try:
        local, at, domain = piece.decode().partition("@")
    except UnicodeDecodeError:
        return False
    if not (local and at and domain) or "." not in domain or domain[0] == "." or domain[-1] == ".":
        return False
    return all(c.isalnum() or c in "._+-" for c in local) and all(c.isalnum() or c in ".-" for c in domain)


def is_assignment(piece: bytes) -> bool:
    found = _ASSIGNMENT.match(piece)
    return bool(found) and (found[1] in _ASSIGNED or any(c in b"_.-" for c in found[1]))


def is_timestamp(piece: bytes) -> bool:
    return bool(_TIMESTAMP.match(piece))


def is_literal(piece: bytes) -> bool:
    """A number as programs write it; a bare decimal isn't one."""
    return bool(_LITERAL.match(piece))


_ARTIFACTS = (("url", is_url), ("email", is_email), ("assignment", is_assignment), ("timestamp", is_timestamp), ("number", is_literal))


#: What a text without any artifact of a kind lacks; numbers and timestamps may begin with any digit.
_SIGNS = {"url": (b"://", b"www."), "email": (b"@",), "assignment": (b"=",)}


def _named(raw: bytes, tests: tuple) -> Iterator[tuple[int, int, str]]:
    for match in _PIECE.finditer(raw):
        piece = match[0]
        left = len(piece) - len(piece.lstrip(b"([{<\"'"))
        core = piece[left:].rstrip(b".,;!?)]}>\"'")
        kind = next((name for name, test in tests if test(core)), None) if core else None
        if kind:
            begin = match.start() + left
            yield begin, begin + len(core), kind


def named_artifacts(raw: bytes) -> list[tuple[int, int, str]]:
    """Spans of inline artifacts with their kind, of several the first."""
    return list(_named(raw, _ARTIFACTS))


def artifacts_of(kind: str, raw: bytes) -> Iterator[tuple[int, int, str]]:
    """Spans of all artifacts of a kind, also of those that are of an earlier kind too."""
    if any(sign in raw for sign in _SIGNS.get(kind, (b"",))):
        yield from _named(raw, tuple(t for t in _ARTIFACTS if t[0] == kind))


def artifact_spans(raw: bytes) -> list[Span]:
    return [(begin, end) for begin, end, _ in named_artifacts(raw)]


#: Rows of one batch that leaves a kernel.
MOST_ROWS = 50_000


def _rows(raw: DataFrame, make: Callable[[bytes], Iterable[tuple]], schema: str, types: list[pa.DataType]) -> DataFrame:
    """A row for each tuple that a document's bytes give."""
    key = raw.schema["doc_id"].dataType.simpleString()
    names = [f.split()[0] for f in schema.split(", ")]
    kernel = lambda batches: row_batches(batches, make, names, types)
    return shipped(raw).select("doc_id", "raw").mapInArrow(kernel, f"doc_id {key}, {schema}")


def row_batches(batches: Iterator[pa.RecordBatch], make: Callable[[bytes], Iterable[tuple]], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded number of rows, also where one document gives more."""
    for batch in batches_by_size(batches, 1):
        rows = ((k, *row) for k, value in enumerate(batch.column(1).to_pylist()) if value is not None for row in make(value))
        while some := list(islice(rows, MOST_ROWS)):
            columns = list(zip(*some))
            of = pa.array(list(columns[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), *(pa.array(list(c), t) for c, t in zip(columns[1:], types))], names=["doc_id", *names])


def artifacts(raw: DataFrame, kind: str | None = None) -> DataFrame:
    """``doc_id``, ``start``, ``end``, ``kind``, ``surface`` of inline artifacts, or of all that are of one kind, whatever else they are."""
    found = named_artifacts if kind is None else partial(artifacts_of, kind)
    make = lambda data: ((b, e, name, data[b:e]) for b, e, name in found(data))
    return _rows(raw, make, "start long, end long, kind string, surface binary", [pa.int64(), pa.int64(), pa.string(), pa.binary()])


def judged_lines(raw: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``end``, ``score``, ``hard``, ``weak``, ``blank`` of each line."""
    make = lambda data: [(x.start, x.end, x.score, bool(x.hard), bool(x.weak), x.blank) for x in code_lines(data)]
    return _rows(raw, make, "start long, end long, score int, hard boolean, weak boolean, blank boolean", [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_()])


def regions(raw: DataFrame, fences: bool = True, blocks: bool = True) -> DataFrame:
    """``doc_id``, ``start``, ``end`` of fenced code, unmarked blocks, or both merged."""
    make = lambda data: merged((fenced_spans(data) if fences else []) + (block_spans(data) if blocks else []))
    return _rows(raw, make, "start long, end long", [pa.int64(), pa.int64()])


def identifier_parts(raw: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``end``, ``surface`` of the parts of identifiers, one a row of ``raw``."""

    def make(data: bytes) -> list[tuple]:
        edges = [0, *identifier_cuts(data.decode()), len(data)]
        return [(b, e, data[b:e]) for b, e in zip(edges, edges[1:])]

    return _rows(raw, make, "start long, end long, surface binary", [pa.int64(), pa.int64(), pa.binary()])


def fenced_spans(raw: bytes) -> list[Span]:
    """Between backticks: runs of three and more are fences, else single ones count."""
    found, at = [], 0
    runs = [(m.start(), m.end()) for m in re.finditer(rb"`+", raw)]
    which, hopeless = 0, len(raw) + 1  # no later run is that long
    while which < len(runs):
        begin, end = runs[which]
        begin = max(begin, at)
        run = end - begin
        if run <= 0:
            which += 1
            continue
        size = run if run >= 3 else 1
        inner = begin + size
        close = None
        if size < hopeless:
            close = next((max(runs[k][0], inner) for k in range(which, len(runs)) if runs[k][1] - max(runs[k][0], inner) >= size), None)
        elif end - inner >= size:
            close = inner
        if close is None:
            hopeless = min(hopeless, size)
            at = end
            which += 1
            continue
        at = close + size
        found.append((begin, at))
        while which < len(runs) and runs[which][1] <= at:
            which += 1
    return found


def merged(spans: list[Span]) -> list[Span]:
    """Sorted; overlapping and touching ones made one."""
    out: list[Span] = []
    for begin, end in sorted(spans):
        if begin >= end:
            continue
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def merge_spans(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """``merged`` for a table of ``key``, ``start``, ``end``: islands by a running maximum."""
    order = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    islands = spans.where("start < end").withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(order))
    return islands.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


_KEYWORD_BYTES = tuple(
    [w + b" " for w in b"pub async unsafe extern fn struct enum trait impl mod use let const static type def class import from function var package namespace interface export if for while match loop return raise with yield await SELECT INSERT UPDATE DELETE CREATE ALTER WITH".split()]
    + [b"pub(", b"else", b"break", b"continue", b"pass", b"try", b"except", b"finally", b"using namespace"]
    + b"#! #[ // /* #include <? <!DOCTYPE <html </".split()
)
_HARD_STARTS = ("#!", "#[", "//", "/*", "#include", "using namespace", "<?", "<!DOCTYPE", "<html", "</")
_CANDIDATE = re.compile(rb"[=;{}()\[\]<>:_#/$]")
_PAIR = re.compile(rb"(?=(?:=>|::|->|\+=|-=|\*=|/=|%=|==|!=|<=|>=|&&|\|\||\?\?|\?\.|:=|<<|>>|\.\.))")
_ASSIGNS = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.\[\]\-]*[ \t\n\r\f]*(?:[+\-*/%]=|=)(?!=)(?=.)", re.S)
_ASSIGNS_LOOSE = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.\[\]\-]*", re.S)
_SECTION = re.compile(r"\[\[[A-Za-z0-9_.:\-]+\]\]\Z|\[[A-Za-z0-9_.:\-]+\]\Z")
_END = r"(?![^\W_]|_)"
_DECLARES = re.compile(
    r"(?:fn|struct|enum|trait|impl|mod|use|let|const|static|type|macro_rules|def|class|import|from|function|var|package|namespace|interface|export"
    r"|return|break|continue|pass|raise|yield|await)" + _END
)
_CONTROLS = re.compile(r"(?:if|for|while|match|loop|else|try|except|finally|with)" + _END)
_STATES = re.compile(r"(?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|WITH)" + _END)
_MODIFIER = re.compile(r"\s*(?:pub |pub\([^)]*\)|async |unsafe |extern \"[^\"]*\"|extern )")
_TURKISH = frozenset("çğıöşüÇĞİÖŞÜ")


def opens_with_keyword(text: str) -> bool:
    at = 0
    while found := _MODIFIER.match(text, at):
        at = found.end()
    text = text[at:].lstrip()
    if _DECLARES.match(text) or _STATES.match(text):
        return True
    return bool(_CONTROLS.match(text)) and any(c in text for c in "{:;(")


def assigns(text: str) -> bool:
    if not text or not (text[0].isascii() and (text[0].isalpha() or text[0] in "_$")):
        return False
    at = _ASSIGNS_LOOSE.match(text).end()
    rest = text[at:].lstrip(" \t\n\r\f")
    # a name may end in the minus of an operator, as names hold minus signs
    for sign in ("+=", "-=", "*=", "/=", "%=", "="):
        if rest.startswith(sign):
            return len(rest) > len(sign) and rest[len(sign)] != "="
    return False


def assigns_literal(text: str) -> bool:
    if not assigns(text):
        return False
    right = text[text.index("=") + 1 :].lstrip()
    return right[:1] in tuple("\"'[{+-0123456789") and right != "" or bool(re.match(r"(?:true|false)" + _END, right))


def _json_key(text: str) -> bool:
    return bool(re.match(r'"(?:[^"\\]|\\.)*"\s*:', text, re.S))


def _entity_tag(text: str) -> bool:
    close = text.find("&gt;")
    if close < 0 or not text.startswith("&lt;"):
        return False
    rest = text[close + 4 :].lstrip()
    return not rest or rest.startswith("&lt;") or "&lt;/" in rest


def _tag(text: str) -> bool:
    return bool(re.match(r"</?[A-Za-z]", text)) and ">" in text


def _selector(text: str) -> bool:
    return "{" in text and bool(re.search("[A-Za-z]", text))


_AFTER_CALL = re.compile(r"\s*+(?:\Z|[{;?]|->|=>)")
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")


def calls(text: str) -> bool:
    """A call whose closing bracket ends the line or opens what code would."""
    at = 0
    while found := _NAME.search(text, at):
        begin, name = found.start(), found[0]
        before = text[begin - 1] if begin else ""
        if before and (not before.isascii() or before.isalnum() or before in "_$"):
            at = begin + 1
            continue
        at = found.end()
        member = before in (".", ":") and before != ""
        if not (name[0].islower() or name[0] in "_$" or "_" in name or re.search("[a-z][A-Z]", name) or member or name in ("Some", "None", "Ok", "Err")):
            continue
        opening = re.compile(r"[ \t\n\r\f]*!?\(").match(text, at)
        if not opening:
            at = re.compile(r"[ \t\n\r\f]*!?").match(text, at).end()
            continue
        at = opening.end() - 1
        close = text.find(")", opening.end())
        if close < 0:
            return False  # nor does a later one end
        if _AFTER_CALL.match(text, close + 1):
            return True
        at = close + 1
    return False


def prose(text: str) -> tuple[int, int, bool]:
    """Words, other signs, and whether there is a Turkish letter."""
    words = signs = 0
    inside = turkish = False
    for char in text:
        if char.isalpha():
            words += not inside
            inside = True
            turkish = turkish or char in _TURKISH
        else:
            inside = False
            signs += not (char.isalnum() or char.isspace())
    return words, signs, turkish


@dataclass(frozen=True)
class Line:
    start: int
    end: int
    text: bytes
    score: int
    hard: bool
    weak: bool

    @property
    def blank(self) -> bool:
        return not self.text.strip(b" \t\n\r\f")


def judge_line(data: bytes) -> tuple[int, bool, bool]:
    """(score, certainly code, may continue code) of a line."""
    bare = data.strip(b" \t\n\r\f")
    if not bare:
        return 0, False, True
    if bare.startswith(b"```") or (bare.startswith(b"`") and bare.endswith(b"`")):
        return 0, False, False
    if not bare.startswith(_KEYWORD_BYTES) and not _CANDIDATE.search(bare):
        return 0, False, bare.startswith((b"* ", b"*/", b"# "))
    try:
        text = bare.decode()
    except UnicodeDecodeError:
        return 0, False, False
    assignment = assigns(text)
    head = text[0]
    if head == '"':
        structured = _json_key(text)
    elif head == "{":
        structured = ":" in text and '"' in text
    elif head == "[":
        structured = bool(_SECTION.match(text))
    elif head == "<":
        structured = _tag(text)
    elif head == "&":
        structured = _entity_tag(text)
    elif head in ".#@":
        structured = _selector(text)
    else:
        structured = assignment and assigns_literal(text)
    hard = text.startswith(_HARD_STARTS) or opens_with_keyword(text) or structured
    round_pair = "(" in text and ")" in text
    score = 4 * hard + 2 * min(2, len(_PAIR.findall(bare))) + 4 * assignment
    score += 6 * (round_pair and calls(text)) + 2 * (";" in text) + ("{" in text or "}" in text) + round_pair
    score += ("[" in text and "]" in text) + ("_" in text) + bool(re.search("[a-z][A-Z]", text))
    if not hard and score >= MODERATE:
        words, signs, turkish = prose(text)
        score -= 10 if words >= 12 else 6 if words >= 9 else 0
        if words >= 4 and turkish:
            score -= 6 if words >= 8 else 3
        elif words >= 6 and signs <= 2:
            score -= 3
        if text.endswith((".", "!", "?")):
            score -= 2
    weak = (
        not bare.strip(b"{}[](),;")
        or text.startswith(("//", "/*", "*/", "* ", "# "))
        or (data[:1] in (b" ", b"\t", b"\n", b"\r", b"\f") and bool(re.search(rb"[=;{}()\[\]<>:]", bare)))
        or text.endswith(("{", "(", "[", ",", ";", "=>"))
        or structured
    )
    return score, hard, weak


def is_prose_line(line: Line) -> bool:
    bare = line.text.strip(b" \t\n\r\f")
    if not bare or bare.startswith(_KEYWORD_BYTES) or bare.startswith((b"* ", b"# ", b"&lt;", b"<")):
        return False
    try:
        text = bare.decode()
    except UnicodeDecodeError:
        return False
    if text.endswith((";", "{", "}", ",", "=>")) or any(s in text for s in (" = ", "::", "->")):
        return False
    words, signs, turkish = prose(text)
    return (turkish and words >= 2) or words >= 8 or (words >= 1 and signs <= 8 and text.endswith((".", "!", "?")))


def code_lines(raw: bytes) -> list[Line]:
    out, at, known = [], 0, {}
    for piece in raw.split(b"\n"):
        end = min(len(raw), at + len(piece) + 1)
        if at == end:
            break
        text = piece.rstrip(b"\r")
        if text not in known:
            known[text] = judge_line(text)
        out.append(Line(at, end, text, *known[text]))
        at = end
    return out


def block_spans(raw: bytes) -> list[Span]:
    """Unmarked blocks: strong lines, moderate pairs, dense documents; then their continuations."""
    lines = code_lines(raw)
    first = next((x for x in lines if not x.blank), None)
    if first is None:
        return []
    if first.text.lstrip(b" \t\n\r\f").startswith(b"#!"):
        return [(0, len(raw))]
    chosen = [x.hard or x.score >= STRONG for x in lines]
    for k in range(len(lines) - 1):
        here, there = lines[k].score, lines[k + 1].score
        if min(here, there) >= MODERATE and here + there >= PAIR:
            chosen[k] = chosen[k + 1] = True
    anchors = [k for k, x in enumerate(lines) if x.hard or x.score >= MODERATE]
    solid = sum(not x.blank for x in lines)
    follows = [x.weak and not is_prose_line(x) for x in lines]
    if len(anchors) >= 3 and len(anchors) * 100 >= solid * 35:
        for k in range(anchors[0], anchors[-1] + 1):
            chosen[k] = chosen[k] or follows[k] or not is_prose_line(lines[k])
    for k in range(len(lines)):
        if not chosen[k]:
            continue
        for step in (-1, 1):
            for distance in range(1, REACH + 1):
                other = k + step * distance
                if not 0 <= other < len(lines) or not follows[other]:
                    break
                chosen[other] = True
    return merged([(x.start, x.end) for x, c in zip(lines, chosen) if c])


def code_spans(raw: bytes, unmarked: bool, artifact: bool, backtick: bool) -> list[Span]:
    """All code regions, given the scan's hints."""
    found = fenced_spans(raw) if backtick else []
    if unmarked:
        found += block_spans(raw)
    if artifact or unmarked:
        found += artifact_spans(raw)
    return merged(found)


def identifier_cuts(text: str) -> list[int]:
    """Byte offsets inside an identifier at which its parts meet."""
    cuts: set[int] = set()
    at, size = 0, len(text.encode())
    numeric = lambda c: c.isnumeric() and not c.isalpha() or c.isdigit()
    for k, char in enumerate(text):
        end = at + len(char.encode())
        if char in "_-":
            cuts.update((at, end))
        elif k:
            before, after = text[k - 1], text[k + 1 : k + 2]
            camel = before.islower() and char.isupper()
            acronym = before.isupper() and char.isupper() and after.islower()
            digits = numeric(before) != numeric(char) and before.isalnum() and char.isalnum()
            if camel or acronym or digits:
                cuts.add(at)
        at = end
    return sorted(c for c in cuts if 0 < c < size)


def url_column(piece: Column) -> Column:
    return piece.rlike(r"^(?:https?://|ftp://|www\.)") & (F.octet_length(piece) > 8)


def trimmed_pieces(text: Column) -> Column:
    """White-space separated pieces without brackets and marks around them."""
    pieces = F.regexp_extract_all(text, F.lit(r"[^\x00-\x20\x7f`]+"), F.lit(0))
    return F.transform(pieces, lambda p: F.regexp_replace(F.regexp_replace(p, r"^[(\[{<\"']+", ""), r"[.,;!?)\]}>\"']+$", ""))
