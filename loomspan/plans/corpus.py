"""Queries on documents and conversations as wholes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.operators import encode, lattice, scan
from loomspan.operators import vocab as V
from loomspan.plans.registry import register
from loomspan.session import spread, table


@register("SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_docs(spark, folder):
    """Documents that are encoded once for all their copies. Texts meet by a 128-bit hash, not by themselves."""
    docs = spread(table(spark, folder, "documents")).select("doc_id", F.md5("text").alias("digest"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").select("first_id", "copies")


@register("SELECT doc_id, CAST(coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_at, n AS n_ids FROM (SELECT doc_id, CAST(octet_length(encode(text)) + 2 AS BIGINT) AS n FROM documents)")
def document_offsets(spark, folder):
    docs = spread(table(spark, folder, "documents")).select("doc_id", (F.octet_length("text") + 2).alias("n_ids"))
    return encode.document_offsets(docs).select("doc_id", F.col("offset").alias("start_at"), "n_ids")


@register("SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY 1 ORDER BY n DESC, encode(ch) LIMIT 64")
def char_vocab_topk(spark, folder):
    counts = V.char_counts(spread(table(spark, folder, "documents")))
    return counts.orderBy(F.col("n").desc(), F.encode("ch", "UTF-8")).limit(64)


@register(
    """WITH top AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY 1 ORDER BY n DESC, encode(ch) LIMIT 200)
       SELECT CAST(row_number() OVER (ORDER BY encode(ch)) + 262 AS BIGINT) AS id, ch, n FROM top"""
)
def char_vocab_ids(spark, folder):
    return V.ranked_chars(V.char_counts(spread(table(spark, folder, "documents"))), 200)


_CUBE = "SELECT lang, source, count(*) AS n_docs, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes FROM documents GROUP BY"


@register(f"SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, n_docs, n_bytes FROM ({_CUBE} CUBE (lang, source))")
def cube_lang_source(spark, folder):
    docs = spread(table(spark, folder, "documents")).select("lang", "source", F.octet_length("text").cast("long").alias("b"))
    made = docs.cube("lang", "source").agg(F.count("*").alias("n_docs"), F.sum("b").alias("n_bytes"))
    return made.select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "n_docs", "n_bytes")


@register("SELECT true AS exact, count(*) AS n_docs FROM documents")
def roundtrip_ok(spark, folder):
    """Characters outside a small vocabulary go through bytes and come back."""
    docs = spread(table(spark, folder, "documents"))
    raw = scan.as_raw(docs)
    vocabulary = V.SurfaceVocabulary((b"the", b" the", b"tion", b"en", b"er", b" ", b"de", b"ing"))
    back = encode.surface_decoding(encode.surface_encoding(raw, vocabulary), vocabulary).withColumnRenamed("raw", "back")
    return raw.join(back, "doc_id").agg(F.bool_and(F.col("raw") == F.col("back")).alias("exact"), F.count("*").alias("n_docs"))


_SHAPES = "SELECT l_orderkey AS doc_id, l_linenumber AS unit_idx, l_quantity AS q, l_discount AS d FROM lineitem"


@register(
    """SELECT l_orderkey AS doc_id, CAST(l_suppkey % 5 AS INTEGER) AS cut, count(*) AS analysis_count,
       round(max(l_discount * 10) + ln(sum(exp(l_discount * 10 - m))), 6) AS score
       FROM (SELECT *, max(l_discount * 10) OVER (PARTITION BY l_orderkey, l_suppkey % 5) AS m FROM lineitem) GROUP BY 1, 2"""
)
def lattice_collapse(spark, folder):
    """Candidates with equal cuts as one class; order lines stand in for candidates."""
    items = table(spark, folder, "lineitem")
    rows = items.select(
        F.col("l_orderkey").alias("doc_id"),
        F.lit(0).alias("unit_idx"),
        F.lit(2).alias("status"),
        F.array((F.col("l_suppkey") % 5).cast("int")).alias("cuts"),
        (F.col("l_discount") * 10).alias("score"),
        F.lit(False).alias("selected"),
    )
    return lattice.collapse_table(rows).select("doc_id", F.col("cuts")[0].alias("cut"), "analysis_count", F.round("score", 6).alias("score"))


_WRAP = "CAST(18446744073709551616 AS UHUGEINT)"
_TIMES = lambda value, factor: f"CAST((CAST({value} AS UHUGEINT) * CAST({factor} AS UHUGEINT)) % {_WRAP} AS UBIGINT)"


@register(
    f"""WITH a AS (SELECT event_id, CAST((CAST(event_id + 1 AS UHUGEINT) * CAST({lattice.GAMMA} AS UHUGEINT) + CAST(7 AS UHUGEINT)) % {_WRAP} AS UBIGINT) AS z FROM events),
        b AS (SELECT event_id, {_TIMES("xor(z, z >> 30)", 0xBF58476D1CE4E5B9)} AS z FROM a), c AS (SELECT event_id, {_TIMES("xor(z, z >> 27)", 0x94D049BB133111EB)} AS z FROM b),
        d AS (SELECT event_id, CAST(xor(z, z >> 31) AS HUGEINT) AS z FROM c)
        SELECT event_id, CAST(CASE WHEN z >= 9223372036854775808 THEN z - 18446744073709551616 ELSE z END AS BIGINT) AS number FROM d"""
)
def splitmix_sampling(spark, folder):
    """Sampling numbers of one seed by their step."""
    events = table(spark, folder, "events").select("event_id")
    return events.select("event_id", lattice.splitmix_column(7, F.col("event_id") + 1).alias("number"))


@register(
    """SELECT role, CAST(turn % 2 AS INTEGER) AS parity, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_characters,
       CAST(max(turn) AS BIGINT) AS last_turn FROM conversations GROUP BY 1, 2"""
)
def conversation_turns(spark, folder):
    turns = table(spark, folder, "conversations")
    return turns.groupBy("role", (F.col("turn") % 2).cast("int").alias("parity")).agg(
        F.count("*").alias("n_turns"), F.sum(F.length("text").cast("long")).alias("n_characters"), F.max("turn").alias("last_turn")
    )


@register(
    """SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS hour, event_type AS piece, count(*) AS n,
       CAST(sum(octet_length(encode(props))) AS BIGINT) AS n_bytes FROM events GROUP BY 1, 2"""
)
def token_stream_window(spark, folder):
    """Tumbling windows as the streaming counter has them, on the stored table."""
    events = table(spark, folder, "events")
    rows = events.groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("piece"))
    made = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("props").cast("long")).alias("n_bytes"))
    return made.select(F.unix_timestamp("w.start").alias("hour"), "piece", "n", "n_bytes")


@register(
    """SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(event_id) AS first_event FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session
       FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events)) GROUP BY 1, 2"""
)
def event_sessions(spark, folder):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, folder, "events").select("event_id", "user_id", "ts")
    near = F.col("ts") - F.lag("ts").over(order) <= F.expr("INTERVAL 30 MINUTE")
    marked = events.withColumn("opens", F.when(near, 0).otherwise(1)).withColumn("session", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


_STEMS = "(VALUES ('th'), ('the'), ('er'), ('ere'), ('an'), ('and'), ('in'), ('ing'), ('on'), ('re'), ('de'), ('en'), ('le'), ('la'))"


@register(
    f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS word FROM documents)
        SELECT s.stem, count(*) AS n_words, CAST(max(length(w.word)) AS INTEGER) AS longest FROM w JOIN {_STEMS} AS s(stem) ON starts_with(w.word, s.stem) GROUP BY 1"""
)
def stem_prefix_join(spark, folder):
    """Stems that words begin with: prefixes exploded to an equi-join, not a scan of all pairs."""
    words = spread(table(spark, folder, "documents")).select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    stems = spark.createDataFrame([(s.strip("()'"),) for s in _STEMS[8:-1].split(", ")], "stem string")
    longest = 3
    prefixes = words.select("word", F.explode(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(longest)))).alias("n")).select("word", F.expr("left(word, n)").alias("stem"))
    return prefixes.join(stems, "stem").groupBy("stem").agg(F.count("*").alias("n_words"), F.max(F.length("word")).alias("longest"))


del _SHAPES
