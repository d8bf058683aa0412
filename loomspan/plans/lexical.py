"""Queries on the lexical scan, code signs, letters and numerals."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import lexical as L
from loomspan.functions import turkish as T
from loomspan.operators import code, quality, scan
from loomspan.plans.registry import SQL_NUMBER, SQL_TOKEN, SQL_WORD, register
from loomspan.session import spread, table


def _tokens(spark, folder, *keep):
    """Every token of every document with its kind, inside the JVM."""
    docs = spread(table(spark, folder, "documents"))
    listed = docs.select(*keep, F.explode(scan.tokens_native(F.col("text"))).alias("token"))
    return listed.withColumn("kind", scan.native_kind(F.col("token")))


def _words(spark, folder, numbers=False):
    """Every word, or every number, of every document."""
    docs = spread(table(spark, folder, "documents"))
    listed = docs.select(F.explode(scan.words_native(F.col("text"))).alias("token"))
    return listed.where(scan.is_number(F.col("token")) if numbers else ~scan.is_number(F.col("token")))


_TOKENS = f"SELECT doc_id, lang, unnest(regexp_extract_all(text, '{SQL_TOKEN}')) AS token FROM documents"


@register(
    f"""SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, CAST(length(text) AS BIGINT) AS n_characters,
        CAST(len(list_filter(regexp_extract_all(text, '{SQL_TOKEN}'), lambda t: regexp_matches(t, '^[\\p{{L}}\\p{{M}}_]'))) AS BIGINT) AS n_words,
        CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM documents"""
)
def doc_summary(spark, folder):
    docs = spread(table(spark, folder, "documents"))
    words = F.filter(scan.words_native(F.col("text")), lambda t: ~scan.is_number(t))
    return docs.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.length("text").cast("long").alias("n_characters"),
        F.size(words).cast("long").alias("n_words"),
        (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long").alias("n_lines"),
    )


@register(
    f"""SELECT lang, CASE WHEN regexp_matches(token, '^\\p{{N}}') THEN 'number' WHEN regexp_matches(token, '^[\\p{{L}}\\p{{M}}_]') THEN 'word'
        WHEN regexp_matches(token, '^[\\r\\n]') THEN 'line_break' ELSE 'whitespace' END AS kind,
        count(*) AS n_tokens, CAST(sum(octet_length(encode(token))) AS BIGINT) AS n_bytes FROM ({_TOKENS}) GROUP BY 1, 2"""
)
def scan_kind_bytes(spark, folder):
    rows = _tokens(spark, folder, "lang").where(F.col("kind").isin(L.WORD, L.NUMBER, L.WHITESPACE, L.LINE_BREAK))
    name = F.create_map(*[F.lit(x) for pair in L.KIND_NAMES.items() for x in pair])[F.col("kind")]
    return rows.groupBy("lang", name.alias("kind")).agg(F.count("*").alias("n_tokens"), F.sum(F.octet_length("token").cast("long")).alias("n_bytes"))


@register(f"SELECT token AS word, count(*) AS n FROM ({_TOKENS}) WHERE regexp_matches(token, '^[\\p{{L}}\\p{{M}}_]') GROUP BY 1")
def scan_word_counts(spark, folder):
    return _words(spark, folder).groupBy(F.col("token").alias("word")).agg(F.count("*").alias("n"))


@register(f"SELECT token AS number, count(*) AS n FROM ({_TOKENS}) WHERE regexp_matches(token, '^\\p{{N}}') GROUP BY 1")
def scan_number_counts(spark, folder):
    return _words(spark, folder, True).groupBy(F.col("token").alias("number")).agg(F.count("*").alias("n"))


@register(f"SELECT CAST(length(token) AS INTEGER) AS width, count(*) AS n FROM ({_TOKENS}) WHERE regexp_matches(token, '^[ \\t\\x0b\\f\\x{{a0}}]') GROUP BY 1")
def whitespace_runs(spark, folder):
    return _tokens(spark, folder).where(F.col("kind") == L.WHITESPACE).groupBy(F.length("token").alias("width")).agg(F.count("*").alias("n"))


@register(
    f"""SELECT sign, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(text, '{SQL_TOKEN}', '', 'g'), '')) AS sign FROM documents)
        WHERE sign <> '' GROUP BY 1"""
)
def scalar_signs(spark, folder):
    """Punctuation and symbols as single characters, as units have them."""
    docs = spread(table(spark, folder, "documents"))
    return docs.select(F.explode(scan.signs_native(F.col("text"))).alias("sign")).groupBy("sign").agg(F.count("*").alias("n"))


@register("SELECT count(*) AS n_docs, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes, CAST(0 AS BIGINT) AS n_different FROM documents")
def scan_parity(spark, folder):
    """Documents in which the kernel and the native scan disagree on any span, of so many with so many bytes in spans."""
    docs = spread(table(spark, folder, "documents"))
    native = docs.select(scan.raw_of(docs).alias("raw"), F.transform(scan.tokens_native(F.col("text")), F.octet_length).alias("sizes"))
    made = scan.differing(native)
    return made.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.sum("n_bytes").alias("n_bytes"), F.coalesce(F.sum("n_different"), F.lit(0)).alias("n_different"))


@register("SELECT count(*) AS n_docs, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes, CAST(0 AS BIGINT) AS n_wrong FROM documents")
def coverage_violations(spark, folder):
    """Documents whose spans have gaps or overlaps, of so many with so many bytes in spans."""
    made = scan.document_coverage(scan.as_raw(spread(table(spark, folder, "documents"))))
    return made.agg(F.count("*").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"), F.count_if("wrong").alias("n_wrong"))


@register(
    """SELECT byte, count(*) AS n FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte FROM documents) GROUP BY 1"""
)
def byte_histogram(spark, folder):
    docs = spread(table(spark, folder, "documents"))
    pairs = F.regexp_extract_all(F.hex(F.encode("text", "UTF-8")), F.lit(".."), F.lit(0))
    return docs.select(F.explode(pairs).alias("byte")).groupBy("byte").agg(F.count("*").alias("n"))


@register("SELECT doc_id, CAST(octet_length(encode(text)) + 2 AS BIGINT) AS n_ids, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents")
def byte_token_counts(spark, folder):
    from loomspan.operators import encode

    return encode.byte_counts(scan.as_raw(spread(table(spark, folder, "documents"))))


@register(
    """SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN regexp_full_match(line, '[ \\t\\r\\f\\n]*') THEN 1 ELSE 0 END) AS BIGINT) AS n_blank, CAST(max(octet_length(encode(line)) + CAST(NOT last AS INTEGER)) AS BIGINT) AS longest
       FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) = len(l) AS last FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE NOT (last AND line = '') GROUP BY doc_id"""
)
def code_line_stats(spark, folder):
    """Lines as the code judge sees them, each with its line feed."""
    found = code.judged_lines(scan.as_raw(spread(table(spark, folder, "documents"))))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("blank").alias("n_blank"), F.max(F.col("end") - F.col("start")).alias("longest"))


#: Texts with what the driver's tables lack, beside them in both engines; ids are negative.
_EXTRA = (
    (-1, "see id=5 and user_name=kim, (error=404) level==3 x=1"),
    (-2, "mask 0xFF_FF, 0b1010 or 0o17; 1e-5 12.5e3f64 42u8 but 42 and 3.14"),
    (-3, "at 2024-05-06T07:08:09Z, not 2024-05-06 07:08; <2024-05-06t07:08:09.5+03:00>"),
    (-4, "write to a.b+c@d-e.org. or @x, a@b, a@.c.d; www.example.org/x (https://a.b/c?d=e)"),
    (-5, "kâğıt hâlâ sûret rûzgâr ÎMÂN"),
)
_EXTRA_SQL = "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in _EXTRA) + ") AS extra(doc_id, text)"


def _with_extra(spark, folder):
    """Documents and the texts beside them, as bytes."""
    docs = spread(table(spark, folder, "documents")).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scan.as_raw(docs.unionByName(spark.createDataFrame(list(_EXTRA), "doc_id long, text string")))


_PIECES = r"SELECT page_id, regexp_replace(regexp_replace(p, '^[(\[{<\"'']+', ''), '[.,;!?)\]}>\"'']+$', '') AS piece FROM (SELECT page_id, unnest(regexp_extract_all(html, '[^\x00-\x20\x7f`]+')) AS p FROM pages)"
_TEXT_PIECES = _PIECES.replace("page_id", "doc_id").replace("html", "text").replace("FROM pages", f"FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {_EXTRA_SQL})")


def _artifacts(raw, kind, name):
    return code.artifacts(raw, kind).select("doc_id", F.decode("surface", "UTF-8").alias(name))


@register(f"SELECT piece AS url, count(*) AS n FROM ({_PIECES}) WHERE regexp_matches(piece, '^(?:https?://|ftp://|www\\.)') AND octet_length(encode(piece)) > 8 GROUP BY 1")
def url_tokens(spark, folder):
    pages = spread(table(spark, folder, "pages")).select(F.col("page_id").alias("doc_id"), F.encode("html", "UTF-8").alias("raw"))
    return _artifacts(pages, "url", "url").groupBy("url").agg(F.count("*").alias("n"))


_EMAIL = r"^[\p{L}\p{N}._+\-]+@[\p{L}\p{N}\-][\p{L}\p{N}.\-]*\.[\p{L}\p{N}.\-]*[\p{L}\p{N}\-]$"


@register(f"SELECT doc_id, piece AS email FROM ({_TEXT_PIECES}) WHERE regexp_matches(piece, '{_EMAIL}')")
def email_tokens(spark, folder):
    return _artifacts(_with_extra(spark, folder), "email", "email")


_ASSIGN = r"^(?:[A-Za-z_][A-Za-z0-9_.\-]*[_.\-][A-Za-z0-9_.\-]*|_|id|key|url|path|host|port|status|error|level|time|date)=[^=]"


@register(f"SELECT doc_id, piece AS assignment FROM ({_TEXT_PIECES}) WHERE regexp_matches(piece, '{_ASSIGN}')")
def inline_assignments(spark, folder):
    return _artifacts(_with_extra(spark, folder), "assignment", "assignment")


_STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}[0-9.,+\-:Zz]*$"


@register(
    f"""SELECT event_id AS doc_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp FROM events
        UNION ALL SELECT doc_id, piece FROM ({_TEXT_PIECES}) WHERE doc_id < 0 AND regexp_matches(piece, '{_STAMP}')"""
)
def iso_timestamps(spark, folder):
    """Times of events, written into sentences, and found as inline artifacts."""
    text = F.concat(F.lit("Logged ("), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(") on 3.4.2021."))
    events = table(spark, folder, "events").select(F.col("event_id").cast("long").alias("doc_id"), F.encode(text, "UTF-8").alias("raw"))
    extra = scan.as_raw(spark.createDataFrame(list(_EXTRA), "doc_id long, text string"))
    return _artifacts(events.unionByName(extra), "timestamp", "stamp")


_LITERAL = r"^[+\-]?(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|[0-9_]+(?:\.[0-9_]+)?(?:[eE][+\-]?[0-9_]+(?:[fFiIuU][0-9]+)?|[fFiIuU][0-9]+))$"


@register(f"SELECT doc_id, piece AS literal FROM ({_TEXT_PIECES}) WHERE regexp_matches(piece, '{_LITERAL}')")
def programming_numbers(spark, folder):
    return _artifacts(_with_extra(spark, folder), "number", "literal")


_CODE = (
    (1, "Some words first, as prose has them.\nlet total = price * count;\nreturn total;\nAnd that was all of it.\n"),
    (2, "Use `x += 1` here.\n```rust\nfn main() {}\n```\nDone."),
    (3, "#!/bin/sh\necho hi\n"),
    (4, "No code in this text at all, only a sentence that goes on."),
    (5, "if (a_b) { c(); }\n\nplain words\n"),
)
#: By hand, in bytes: the two lines of the block; both fences; a script as a whole; a line by its own signs, with the blank one after it.
_REGIONS = ((1, 37, 78), (2, 4, 12), (2, 19, 43), (3, 0, 18), (5, 0, 19))


@register("SELECT CAST(d AS BIGINT) AS doc_id, CAST(b AS BIGINT) AS start_at, CAST(e AS BIGINT) AS end_at FROM (VALUES " + ", ".join(map(str, _REGIONS)) + ") AS r(d, b, e)")
def code_regions(spark, folder):
    """Fences and unmarked blocks of texts whose regions are known."""
    raw = scan.as_raw(spark.createDataFrame(list(_CODE), "doc_id long, text string"))
    return code.regions(raw).select("doc_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


_SPAN_SQL = "SELECT l_orderkey AS doc_id, CAST(l_linenumber * 7 AS BIGINT) AS s, CAST(l_linenumber * 7 + l_quantity AS BIGINT) AS e FROM lineitem"


@register(
    f"""WITH spans AS ({_SPAN_SQL}), marked AS (SELECT doc_id, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        THEN 0 ELSE 1 END AS opens FROM spans WHERE s < e), islands AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked)
        SELECT doc_id, min(s) AS start_at, max(e) AS end_at FROM islands GROUP BY doc_id, island"""
)
def merge_spans(spark, folder):
    """Interval merge, on intervals made of order lines."""
    items = table(spark, folder, "lineitem")
    begin = (F.col("l_linenumber") * 7).cast("long")
    spans = items.select(F.col("l_orderkey").alias("doc_id"), begin.alias("start"), (begin + F.col("l_quantity")).cast("long").alias("end"))
    return code.merge_spans(spans).select("doc_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


_WORDS = f"SELECT DISTINCT token FROM ({_TOKENS}) WHERE regexp_matches(token, '^[\\p{{L}}\\p{{M}}_]')"


@register(
    f"""SELECT token AS word, replace(replace(token, 'I', 'ı'), 'İ', 'i') AS folded, lower(replace(replace(token, 'I', 'ı'), 'İ', 'i')) AS lowered FROM ({_WORDS})"""
)
def turkish_lower(spark, folder):
    words = _words(spark, folder).select(F.col("token").alias("word")).distinct()
    return words.select("word", F.translate("word", "Iİ", "ıi").alias("folded"), T.turkish_lower_column(F.col("word")).alias("lowered"))


@register(
    f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{SQL_WORD}')) AS word FROM (SELECT text FROM documents UNION ALL SELECT text FROM {_EXTRA_SQL}))
        SELECT word, translate(word, 'âîûÂÎÛ', 'aiuAİU') AS folded FROM w WHERE word <> translate(word, 'âîûÂÎÛ', 'aiuAİU')"""
)
def circumflex_fold(spark, folder):
    docs = spread(table(spark, folder, "documents")).select("text").unionByName(spark.createDataFrame([(t,) for _, t in _EXTRA], "text string"))
    tokens = docs.select(F.explode(scan.tokens_native(F.col("text"))).alias("word")).where(scan.native_kind(F.col("word")) == L.WORD).distinct()
    return tokens.withColumn("folded", T.fold_circumflex_column(F.col("word"))).where("word <> folded")


@register(
    f"""WITH w AS (SELECT lower(replace(replace(token, 'I', 'ı'), 'İ', 'i')) AS low FROM ({_WORDS})), v AS (SELECT regexp_extract(low, '([aeıioöuüâîû])[^aeıioöuüâîû]*$', 1) AS vowel FROM w)
        SELECT vowel, CASE WHEN vowel = '' THEN '' WHEN contains('eiöüî', vowel) THEN 'front' ELSE 'back' END AS place,
        CASE WHEN vowel = '' THEN '' WHEN contains('oöuüû', vowel) THEN 'rounded' ELSE 'unrounded' END AS shape, count(*) AS n FROM v GROUP BY 1, 2, 3"""
)
def vowel_harmony(spark, folder):
    words = _words(spark, folder).select("token").distinct()
    vowel = F.col("vowel")
    return (
        words.select(T.last_vowel_column(F.col("token")).alias("vowel"))
        .groupBy("vowel")
        .agg(F.count("*").alias("n"))
        .select(
            "vowel",
            F.when(vowel == "", "").when(vowel.isin(*T.FRONT), "front").otherwise("back").alias("place"),
            F.when(vowel == "", "").when(vowel.isin(*T.ROUND), "rounded").otherwise("unrounded").alias("shape"),
            "n",
        )
    )


_CLASSES = T._NUMERAL


@register(
    "SELECT class, count(*) AS n FROM (SELECT unnest(list_filter([" + ", ".join(f"CASE WHEN regexp_full_match(number, '{p}') THEN '{n}' END" for n, p in _CLASSES) + "], lambda c: c IS NOT NULL)) AS class FROM ("
    + f"SELECT token AS number FROM ({_TOKENS}) WHERE regexp_matches(token, '^\\p{{N}}') UNION ALL SELECT CAST(l_orderkey AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR) FROM lineitem"
    + " UNION ALL SELECT strftime(o_orderdate, '%d.%m.%Y') FROM orders)) GROUP BY 1"
)
def numeral_classes(spark, folder):
    """Classes of the numbers in documents, of made-up decimals and of dates."""
    numbers = _words(spark, folder, True).select(F.col("token").alias("number"))
    items = table(spark, folder, "lineitem").select(F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("number"))
    dates = table(spark, folder, "orders").select(F.date_format("o_orderdate", "dd.MM.yyyy").alias("number"))
    every = numbers.unionByName(items).unionByName(dates)
    return every.select(F.explode(T.numeral_classes_column(F.col("number"))).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@register(f"SELECT token AS numeral, count(*) AS n FROM ({_TOKENS}) WHERE regexp_full_match(token, 'M{{0,3}}(?:CM|CD|D?C{{0,3}})(?:XC|XL|L?X{{0,3}})(?:IX|IV|V?I{{0,3}})') AND token <> '' GROUP BY 1")
def roman_numerals(spark, folder):
    rows = _words(spark, folder).where(F.col("token").rlike("^M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})$"))
    return rows.groupBy(F.col("token").alias("numeral")).agg(F.count("*").alias("n"))


@register(
    f"""SELECT number, array_to_string(regexp_extract_all(lpad(number, CAST(ceil(length(number) / 3.0) * 3 AS INTEGER), ' '), '...'), '|') AS atoms
        FROM (SELECT DISTINCT token AS number FROM ({_TOKENS}) WHERE regexp_full_match(token, '[0-9]+'))"""
)
def digit_atoms(spark, folder):
    from loomspan.operators.encode import digit_atoms_column

    numbers = _words(spark, folder, True).where(F.col("token").rlike("^[0-9]+$")).select(F.col("token").alias("number")).distinct()
    padded = F.concat(F.lpad(F.element_at("a", 1), 3, " "), F.when(F.size("a") > 1, F.concat(F.lit("|"), F.array_join(F.slice("a", 2, 1_000_000), "|"))).otherwise(F.lit("")))
    return numbers.withColumn("a", digit_atoms_column(F.col("number"))).select("number", padded.alias("atoms"))


@register(f"SELECT word, part, CAST(count(*) AS BIGINT) AS n FROM (SELECT token AS word, unnest(regexp_extract_all(token, '[_]|[0-9]+|[^_0-9]+')) AS part FROM ({_WORDS}) WHERE regexp_matches(token, '[_0-9]') AND regexp_full_match(token, '[a-z0-9_]+')) GROUP BY 1, 2")
def identifier_pieces(spark, folder):
    """Parts of lower-case identifiers, where digits and underscores meet letters."""
    words = _words(spark, folder).select(F.col("token").alias("word")).distinct()
    words = words.where(F.col("word").rlike("[_0-9]") & F.col("word").rlike("^[a-z0-9_]+$"))
    parts = code.identifier_parts(words.select(F.col("word").alias("doc_id"), F.encode("word", "UTF-8").alias("raw")))
    return parts.groupBy(F.col("doc_id").alias("word"), F.decode("surface", "UTF-8").alias("part")).agg(F.count("*").alias("n"))


@register(
    f"""SELECT word, CAST(least(64, CAST(pow(2, length(word) - length(translate(word, 'cgiosu', ''))) AS BIGINT)) - 1 AS BIGINT) AS n_variants
        FROM (SELECT token AS word FROM ({_WORDS}) WHERE regexp_full_match(token, '[a-z]+')) WHERE regexp_matches(word, '[cgiosu]')"""
)
def deasciify_variants(spark, folder):
    """How many variants with Turkish letters of a plain word are tried; more than 63 aren't."""
    words = _words(spark, folder).where(F.col("token").rlike("^[a-z]*[cgiosu][a-z]*$")).select(F.col("token").alias("word")).distinct()
    return quality.shadow_variants(words).select("word", F.size("variants").cast("long").alias("n_variants"))


@register(f"SELECT count(*) AS n_words, count(DISTINCT token) AS n_distinct FROM ({_TOKENS}) WHERE regexp_matches(token, '^[\\p{{L}}\\p{{M}}_]')")
def distinct_surface_ratio(spark, folder):
    rows = _words(spark, folder).groupBy("token").agg(F.count("*").alias("n"))
    return rows.agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


del SQL_NUMBER, SQL_WORD
