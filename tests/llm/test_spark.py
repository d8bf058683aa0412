"""Operators on small tables: brute force, and the defined cases."""

from __future__ import annotations

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomspan.llm import bpe, bwt, bytecnn, components, fertility, lengths, lines, minmax, packing, queries, rotated, vocabularies, warc
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, c0 int, keep boolean, _key long"
SMALL = "/root/testdata/sf0.001"


def rows(*texts, first=1):
    return [(first + k, t, "en", "s", None if t is None else len(t), "x", 7, False, 3) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, copies, repeated rows, clashing names."""
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdeéx"), rng.integers(2, 8))) for _ in range(400)]
    long = " ".join(rng.choice(words, 30_000))
    prose = " ".join(rng.choice(words, 160))
    made = rows("", " \n ", None, prose, prose, long, "!!!", "line\nline\nother\n\nline", "other", "日本語のテキスト", "x" * 50_000)
    made += [(None, prose, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    made += [made[3], made[3], made[7]]
    return spark.createDataFrame(made, SCHEMA)


@pytest.fixture(scope="module")
def strange(spark):
    """Ids as text, some null, some twice, and columns named like inner ones."""
    rng = np.random.default_rng(2)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    passage, prose = word(60), word(90)
    texts = [("p-1", prose), ("p-2", prose), (None, prose + " x"), ("p-1", f"{word(90)} {passage}"), ("p-3", f"{passage} {word(90)}"), (None, "one\ntwo"), ("q", "two\nthree"), ("q", "two\nthree"), ("q", None), (None, None)]
    made = [(i, t, "en", "s", k, f"keep{k}", True, 1.5, "a", 3) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(made, "doc_id string, text string, lang string, source string, n_chars long, _row string, _gone boolean, _id double, _least string, _n int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def words_of(text):
    return [w for w, _, _ in brute.words(text)]


def test_all_operators_take_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    made = [
        fertility.fertility_rules(empty), lengths.length_histogram(empty), rotated.nearest_neighbours(vectors), packing.best_fit_packing(empty),
        bpe.encode(empty), bpe.decode(bpe.encode(empty)), lines.line_bitmaps(empty), warc.reassembled_pages(pages), minmax.near_duplicates(empty),
        bwt.repeated_passages(empty), bytecnn.quality_scores(empty, labels),
    ]
    assert [m.count() for m in made] == [0] * len(made)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, empty, "")
        assert found.columns == empty.columns and found.count() == 0


def test_fertility_cases(spark, odd):
    found = fertility.fertility_rules(odd).collect()
    assert len(found) == odd.count()
    for row in found:
        if row["n_tokens"] == 0:
            assert row["byte_chars"] is None and row["keep"]
        if row["n_tokens"] < fertility.ENOUGH:
            assert row["keep"] and row["reasons"] == []
    assert {r["band_key"] for r in found if r["doc_id"] is None} == {"script:latin", "script:none"}


def test_fertility_rejects_what_lies_outside(spark, documents):
    rng = np.random.default_rng(1)
    junk = ["".join(rng.choice(list("%$#@&*^~|"), 1200)) + " zq" * 80, " " * 300]
    bad = spark.createDataFrame([(10_000_000 + k, j, "en", "s", len(j)) for k, j in enumerate(junk)], documents.schema)
    found = {r["doc_id"]: r for r in fertility.fertility_rules(documents.unionByName(bad)).collect()}
    assert not any(found[10_000_000 + k]["keep"] for k in range(2))
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").collect()
    assert all(found[r["doc_id"]]["keep"] for r in labels)


def test_fertility_bands_have_two_sides(spark):
    usual = (2.2, 0.05, 0.75, 2.2, 0.0, 0.75)
    made = [(k, "en", 10_000, *usual) for k in range(100)]
    for doc, chars, bare in ((100, -5, 0), (101, -5, 3), (102, 5, 0), (103, -9, 3), (104, 9, 0)):  # in deviations
        made.append((doc, "en", 10_000, 2.2 + 0.02 * chars, 0.05 + 0.01 * bare, *usual[2:]))
    names = ["doc_id", "band_key", "n_tokens", *fertility.MEASURES]
    found = {r["doc_id"]: r["reasons"] for r in fertility.judge(spark.createDataFrame(made, names)).collect()}
    assert {doc: why for doc, why in found.items() if why} == {d: ["byte_chars"] for d in (100, 103, 104)}


def test_fertility_rejects_half_of_the_junk(spark):
    found = fertility.fertility_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    counts = {(r["quality"], r["keep"]): r["count"] for r in found.join(labels, "doc_id").groupBy("quality", "keep").count().collect()}
    clean, junk = (counts.get((q, True), 0) + counts.get((q, False), 0) for q in (1, 0))
    assert counts.get((0, False), 0) >= 0.45 * junk and counts.get((1, False), 0) <= 0.01 * clean


def test_bands_and_verdicts_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fertility, "FEWEST", 12)
    rng = np.random.default_rng(1)
    made = []
    for k in range(400):
        key = ("en", "en", "de", "script:latin")[k % 4] if k % 40 else "rare"
        values = [None if k % 37 == 0 else float(rng.normal(m, s)) for m, s in ((3, 0.3), (0.05, 0.02), (0.8, 0.05), (3, 0.4), (0.01, 0.01), (0.8, 0.05))]
        made.append((k, key, 0 if k % 37 == 0 else int(rng.integers(10, 900)), *values))
    names = ["doc_id", "band_key", "n_tokens", *fertility.MEASURES]
    schema = "doc_id long, band_key string, n_tokens long, " + ", ".join(f"{m} double" for m in fertility.MEASURES)
    found = {r["doc_id"]: r for r in fertility.judge(spark.createDataFrame(made, schema)).collect()}
    for row, reasons in zip(made, brute.verdicts([dict(zip(names, r)) for r in made])):
        assert (found[row[0]]["reasons"], found[row[0]]["keep"]) == (reasons, not reasons)
    assert 0 < sum(not r["keep"] for r in found.values()) < 300


def test_length_histogram_is_brute_force(spark, odd):
    count = lambda t: len(vocabularies.byte_bpe("byte_bpe_50k").encode_ordinary(t))
    n = sorted(count(r["text"]) for r in odd.select("text").collect() if r["text"] is not None)
    sums = lengths.length_histogram(odd).cache()
    for row in sums.collect():
        at = row["n_tokens"]
        assert row["n_docs"] == n.count(at)
        assert row["docs_ge"] == sum(x >= at for x in n) and row["tokens_ge"] == sum(x for x in n if x >= at)
        assert row["truncated_total"] == sum(min(x, at) for x in n) and row["docs_le"] == sum(x <= at for x in n)
    for limit in (0, 1, 7, 100, 10**9):
        assert lengths.truncated_total(sums, limit).first()[0] == sum(min(x, limit) for x in n)
    for share in (0.1, 0.5, 0.9, 1.0):
        assert lengths.quantile(sums, share).first()[0] == n[int(np.ceil(share * len(n) - 1e-9)) - 1]
    sums.unpersist()


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(rotated, "CELL_ROWS", 60)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    points = (centres[rng.integers(0, 6, 400)] + 0.3 * rng.normal(size=(400, 16))).astype(np.float32)
    given = [(k, p.tolist(), 1) for k, p in enumerate(points)]
    given += [(400, None, 1), (None, points[0].tolist(), 1), (401, [1.0, None] + [0.0] * 14, 1), (402, [1.0], 1), (403, [0.0] * 16, 1), (7, points[7].tolist(), 1)]
    table = spark.createDataFrame(given, "vec_id long, embedding array<float>, neighbour int")
    found = rotated.nearest_neighbours(table, 5).collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r["vec_id"]].append((r["rank"], r["neighbour"], r["score"]))
    assert set(by) == {*range(400), 403} and all(len(v) == 5 for v in by.values())
    own = points @ points.T
    np.fill_diagonal(own, -np.inf)
    hits = 0
    for k in set(range(400)) - {7}:
        best = sorted(own[k], reverse=True)[4]
        hits += sum(s >= best - 1e-4 for _, _, s in by[k])
        assert all(o != k for _, o, _ in by[k])
    assert hits / (399 * 5) >= 0.9
    few = spark.createDataFrame(given[:3], "vec_id long, embedding array<float>, neighbour int")
    assert rotated.nearest_neighbours(few, 5).count() == 6


def _recall(spark, points, k=10):
    table = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<float>")
    scores = collections.defaultdict(list)
    for r in rotated.nearest_neighbours(table, k).collect():
        scores[r["vec_id"]].append(r["score"])
    own = points @ points.T
    np.fill_diagonal(own, -np.inf)
    least = -np.sort(-own, axis=1)[:, k - 1] - 1e-4
    return sum(s >= least[i] for i, found in scores.items() for s in found) / (len(points) * k)


def test_neighbours_of_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(rotated, "CELL_ROWS", 60)
    rng = np.random.default_rng(8)
    points = (rng.normal(size=(6, 16))[rng.integers(0, 6, 300)] + 0.3 * rng.normal(size=(300, 16))).astype(np.float32)
    given = [(k, p) for k, p in enumerate(points)]
    given += [(7, points[7])] * 11  # equal rows
    given += [(8, points[8] * (1 + c / 100)) for c in range(1, 12)]  # one id, many vectors close by
    given += [(9, points[k]) for k in (20, 40, 60)]  # and far apart
    ids, all_points = np.array([k for k, _ in given]), np.array([p for _, p in given])
    product = all_points @ all_points.T
    best = np.full((300, 300), -np.inf, dtype=np.float32)
    np.maximum.at(best, (ids[:, None], ids[None, :]), product)
    np.fill_diagonal(best, -np.inf)
    table = spark.createDataFrame([(k, p.tolist()) for k, p in given], "vec_id long, embedding array<float>")
    by = collections.defaultdict(list)
    for r in rotated.nearest_neighbours(table, 10).collect():
        by[r["vec_id"]].append((r["rank"], r["neighbour"], r["score"]))
    assert set(by) == set(range(300))
    right = {}
    for k, found in by.items():
        assert sorted(r for r, _, _ in found) == list(range(1, 11)) and len({o for _, o, _ in found} - {k}) == 10
        least = np.sort(best[k])[-10] - 1e-4
        right[k] = sum(s >= least for _, _, s in found)
    assert sum(right.values()) >= 0.95 * 3000 and all(right[k] >= 9 for k in (7, 8, 9))


def test_neighbours_beside_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(rotated, "CELL_ROWS", 60)
    points = np.random.default_rng(9).normal(size=(200, 8)).astype(np.float32)
    good = [(k, p.tolist()) for k, p in enumerate(points)]
    bad = [(1000, []), (1001, [1.0]), (1002, [1.0] * 9)]
    bad += [(1100 + k, [x] * 8) for k, x in enumerate((float("nan"), float("inf"), float("-inf"), 1e30, -1e30))]
    bad += [(1200 + k, [float("nan")] + [1.0] * 7) for k in range(50)]
    wanted = None
    for rows in (good, bad + good):
        table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
        found = {(r["vec_id"], r["rank"]): r["neighbour"] for r in rotated.nearest_neighbours(table, 5).collect()}
        wanted = wanted or found
        assert len(found) == 1000 and found == wanted
    even = [(k, p.tolist()[: 8 - k % 2]) for k, p in enumerate(points)]
    found = rotated.nearest_neighbours(spark.createDataFrame(even, "vec_id long, embedding array<float>"), 5)
    assert {r["vec_id"] for r in found.collect()} == set(range(1, 200, 2))


@pytest.mark.parametrize("kind", ["low-dimensional", "decaying spectrum", "many clusters"])
def test_neighbours_in_other_cells(spark, monkeypatch, kind):
    monkeypatch.setattr(rotated, "CELL_ROWS", 100)
    rng = np.random.default_rng(4)
    if kind == "low-dimensional":
        points = rng.normal(size=(2000, 16)) @ rng.normal(size=(16, 256))
    elif kind == "decaying spectrum":
        points = rng.normal(size=(2000, 256)) * np.arange(1, 257) ** -0.5
    else:
        points = rng.normal(size=(60, 64))[rng.integers(0, 60, 2000)] + 0.6 * rng.normal(size=(2000, 64))
    points = (points / np.linalg.norm(points, axis=1)[:, None]).astype(np.float32)
    assert _recall(spark, points) >= 0.95


def test_neighbours_of_a_query_set(spark, monkeypatch):
    """Every 50th id against all rows; a third of all rows one vector, ids as text."""
    monkeypatch.setattr(rotated, "CELL_ROWS", 200)
    monkeypatch.setattr(rotated, "BLOCK_ROWS", 90)
    monkeypatch.setattr(rotated, "TASK_QUERIES", 4)
    points = np.random.default_rng(5).normal(size=(1200, 64)).astype(np.float32)
    points[::3] = points[0]
    given = spark.createDataFrame([(f"{i:05d}", p.tolist(), i) for i, p in enumerate(points)], "vec_id string, embedding array<float>, _h int")
    found = rotated.nearest_neighbours(given, queries=F.col("vec_id").cast("int") % 50 == 0).collect()
    by = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: (r["vec_id"], r["rank"])):
        by[int(r["vec_id"])].append((int(r["neighbour"]), r["score"]))
    assert set(by) == set(range(0, 1200, 50))
    hits = 0
    for k, got in by.items():
        own = points @ points[k]
        own[k] = -np.inf
        best = np.lexsort((np.arange(1200), -own.round(3)))[:10]
        assert len(got) == 10 and np.allclose([s for _, s in got], own[[o for o, _ in got]], atol=1e-3)
        hits += len({o for o, _ in got} & set(best.tolist()))
    assert hits >= 0.9 * 240


def test_neighbours_of_one_id_with_most_vectors(spark, monkeypatch):
    monkeypatch.setattr(rotated, "CELL_ROWS", 100)
    points = np.random.default_rng(6).normal(size=(600, 32)).astype(np.float32)
    ids = [3 if i < 400 else i for i in range(600)]
    given = spark.createDataFrame([(i, p.tolist()) for i, p in zip(ids, points)], "vec_id int, embedding array<float>")
    best = collections.defaultdict(lambda: -np.inf)
    for i, row in zip(ids, points @ points.T):
        for j, x in zip(ids, row):
            best[i, j] = max(best[i, j], x)
    found = rotated.nearest_neighbours(given, 5).collect()
    right = sum(r["score"] >= sorted((best[r["vec_id"], j] for j in {*ids} - {r["vec_id"]}), reverse=True)[4] - 1e-3 for r in found)
    assert len(found) == 5 * 201 and right >= 0.95 * len(found)


def test_packing_cases(spark, odd, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 3)
    packed = packing.best_fit_packing(odd, 256).collect()
    fill = collections.Counter()
    held = collections.Counter()
    for r in packed:
        fill[r["bin_id"]] += r["n_tokens"]
        held[r["doc_id"]] += r["n_tokens"]
        assert r["start"] == r["piece"] * 256 and 1 <= r["n_tokens"] <= 256
    count = lambda t: len(vocabularies.byte_bpe("byte_bpe_50k").encode_ordinary(t or ""))
    wanted = collections.Counter()
    for r in odd.select("doc_id", "text").collect():
        wanted[r["doc_id"]] += count(r["text"])
    assert held == +wanted
    bins: list[int] = []
    for length in sorted((r["n_tokens"] for r in packed), reverse=True):
        fitting = [(room, k) for k, room in enumerate(bins) if room >= length]
        if fitting:
            bins[min(fitting)[1]] -= length
        else:
            bins.append(256 - length)
    assert sorted(fill.values()) == sorted(256 - b for b in bins)


def test_tree_encoding_cases(spark, odd):
    made = bpe.encode(odd, check=True)
    encode = vocabularies.byte_bpe("byte_bpe_50k").encode_ordinary
    texts = collections.Counter((r["doc_id"], r["text"]) for r in odd.collect())
    back = collections.Counter((r["doc_id"], r["text"]) for r in bpe.decode(made).collect())
    assert back == texts
    for r in made.collect():
        assert r["exact"] is not False
        if r["tokens"] is None:
            assert r["n_tokens"] is None
    short = {r["doc_id"]: r["tokens"] for r in made.where("doc_id IN (1, 8)").collect()}
    assert short == {1: [], 8: encode("line\nline\nother\n\nline")}


def test_line_bitmaps_are_brute_force(spark, odd, documents):
    for table in (odd, documents):
        seen, wanted = set(), {}
        keyed = {(r["doc_id"], r["text"]) for r in table.collect() if r["text"] is not None}
        keys = {(r["doc_id"], r["text"]): r["k"] for r in table.select("doc_id", "text", F.xxhash64("text").alias("k")).collect()}
        for doc, text in sorted(keyed, key=lambda d: (-(1 << 63) if d[0] is None else d[0], keys[d])):
            bits = []
            for line in text.encode().split(b"\n"):
                bare = line.strip()
                bits.append(not bare or bare not in seen)
                seen.add(bare)
            wanted[doc, text] = lines.run_lengths(np.array(bits, dtype=bool))
        found = lines.line_bitmaps(table).collect()
        assert len(found) == table.count()
        assert collections.Counter((r["doc_id"], r["keep"]) for r in found) == collections.Counter(
            (r["doc_id"], wanted.get((r["doc_id"], r["text"]))) for r in table.collect()
        )
        for r in found:
            if r["keep"] is not None:
                bits = lines.from_run_lengths(r["keep"])
                assert (len(bits), bits.sum()) == (r["n_lines"], r["n_kept"])


def test_line_stage_applies_the_bitmaps(spark, odd):
    found = corpus_pipeline.line_dedup(spark, odd, "")
    assert found.columns == odd.columns and found.dtypes == odd.dtypes
    by = collections.defaultdict(list)
    for r in found.collect():
        by[r["doc_id"]].append(r)
    assert by[8][0]["text"] == "line\nother\n" and by[8][0]["n_chars"] == 11 and by[8][0]["c0"] == 7
    assert 9 not in by and 1 in by and by[3][0]["text"] is None


def test_warc_table_cases(spark):
    pages = [(1, "http://a", "x" * 5000), (1, "http://a", "x" * 5000), (2, None, ""), (None, "u", "é\r\n0\r\n"), (4, "u", None), (5, "u", "y" * 300_000)]
    table = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, origin string")
    found = {r["page_id"]: r for r in warc.reassembled_pages(table).collect()}
    assert set(found) == {1, 2, None, 5} and all(r["status"] == "ok" for r in found.values())
    assert found[5]["html"] == "y" * 300_000 and found[2]["html"] == "" and found[2]["url"] is None and found[None]["html"] == "é\r\n0\r\n"
    records = warc.segment(table.where("page_id = 5"))
    some = records.where(~F.decode("record", "ISO-8859-1").contains("WARC-Segment-Number: 7\r\n"))
    assert [r["status"] for r in warc.reassemble(some.union(records.sparkSession.createDataFrame([(None,), (bytearray(b"bad"),)], "record binary"))).collect()] == ["missing"]


def test_near_duplicates_cases(spark, odd):
    found = minmax.near_duplicates(odd).collect()
    groups = collections.defaultdict(list)
    for r in found:
        groups[r["group_id"]].append(r)
    prose = groups[None]
    assert sorted((r["doc_id"] is None, r["doc_id"], r["keep"]) for r in prose if r["doc_id"] is not None) == [(False, 4, False)] * 3 + [(False, 5, False)]
    assert [r["keep"] for r in prose if r["doc_id"] is None] == [True]
    assert {r["doc_id"] for r in found} == {None, 4, 5, 8}  # 8 is a repeated row
    stay = minmax.drop_near_duplicates(odd).collect()
    assert collections.Counter(r["doc_id"] for r in stay) == collections.Counter([1, 2, 3, 6, 7, 8, 9, 10, 11, None, None])


def test_near_duplicates_catch_pairs(spark, documents):
    sets = {}
    for r in documents.collect():
        w = words_of(r["text"])
        sets[r["doc_id"]] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))}
    inverse, shared = collections.defaultdict(list), collections.Counter()
    for doc, grams in sets.items():
        for gram in grams:
            inverse[gram].append(doc)
    for docs in inverse.values():
        shared.update((a, b) for i, a in enumerate(docs) for b in docs[:i])
    near = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in shared.items()}
    group = {r["doc_id"]: r["group_id"] for r in minmax.near_duplicates(documents).collect()}
    close = [p for p, j in near.items() if j >= 0.6]
    assert close and np.mean([group.get(a, -1) == group.get(b, -2) for a, b in close]) >= 0.95
    for doc, rep in group.items():
        assert doc == rep or any(near.get((doc, o), near.get((o, doc), 0)) >= 0.3 for o, g in group.items() if g == rep and o != doc)


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert found == {n: root(n) for e in edges for n in e if e[0] != e[1]}


def brute_passages(table):
    texts = {}
    for r in table.select("doc_id", "text", F.xxhash64("text").alias("k")).collect():
        if r["text"] is not None:
            texts[(-(1 << 63) if r["doc_id"] is None else r["doc_id"], r["k"])] = words_of(r["text"])
    where = collections.defaultdict(list)
    for doc in sorted(texts):
        w = texts[doc]
        for p in range(len(w) - bwt.LEAST + 1):
            where[tuple(w[p : p + bwt.LEAST])].append((doc, p))
    flagged = {("first", *places[0]) for places in where.values() if len(places) > 1}
    flagged |= {("repeat", *p) for places in where.values() for p in places[1:]}
    out = []
    for kind, doc, p in sorted(flagged):
        if out and out[-1][:2] == [kind, doc] and out[-1][3] - bwt.LEAST + 1 == p:
            out[-1][3] = p + bwt.LEAST
        else:
            out.append([kind, doc, p, p + bwt.LEAST])
    return collections.Counter((None if d[0] == -(1 << 63) else d[0], kind, b, e) for kind, d, b, e in out)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeated_passages_are_brute_force(spark, odd, documents, hot, monkeypatch):
    monkeypatch.setattr(bwt, "HOT", hot)
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in rng.integers(0, 50, 300)]
    made = [" ".join(base[:120]), " ".join(base[60:200]), " ".join(["the"] * 130), " ".join(["a", "b", "c"] * 50), " ".join(base[:49]), " ".join(base + base[:70])]
    own = spark.createDataFrame(rows(*made), SCHEMA)
    for table in (own, odd.where("doc_id IS NULL OR doc_id <> 6"), documents):
        found = collections.Counter(map(tuple, bwt.repeated_passages(table).collect()))
        assert found == brute_passages(table)


def test_passage_stage_takes_out_later_occurrences(spark):
    rng = np.random.default_rng(10)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    passage, a, b = word(60), word(30), word(30)
    table = spark.createDataFrame(rows(f"{a} {passage}. {b}", f"{b}! {passage} {a}", passage, "", None, " "), SCHEMA)
    found = {r["doc_id"]: r for r in corpus_pipeline.passage_dedup(spark, table, "").collect()}
    assert found[1]["text"] == f"{a} {passage}. {b}" and found[2]["text"] == f"{b}!  {a}" and 3 not in found
    assert {4, 5, 6} <= set(found) and found[2]["n_chars"] == len(found[2]["text"])


def test_passages_of_scripts_without_spaces(spark):
    rng = np.random.default_rng(14)
    word = lambda n: "".join(rng.choice(list("日本語文字東京大学中国人民的是不了在上下"), n))
    passage = word(60)
    texts = [f"{word(40)}。{passage}、{word(30)}", f"{passage}「{word(50)}」", "กขค" * 40, "ab—cd… " * 30]
    table = spark.createDataFrame(rows(*texts), SCHEMA)
    found = collections.Counter(map(tuple, bwt.repeated_passages(table).collect()))
    assert found == brute_passages(table) and found[2, "repeat", 0, 60] == 1 and found[1, "first", 40, 100] == 1
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.passage_dedup(spark, table, "").collect()}
    assert left[1] == texts[0] and left[2] == texts[1][60:]


def test_classifier_holds_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    network = bytecnn.fit_on(docs, labels, 250)
    trained = labels.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "quality").limit(250).select("doc_id")
    held = labels.join(trained, "doc_id", "left_anti").join(bytecnn.score(docs, network), "doc_id").collect()
    assert len(held) > 100
    right = np.array([(r["probability"] >= 0.5) == (r["quality"] == 1) for r in held])
    good = np.array([r["keep"] for r in held if r["quality"] == 1])
    assert right.mean() > 0.93 and good.mean() > 0.97


def test_classifier_cases(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (8, 0, 0), (None, 1, 1), (9, None, None), (8, 0, 0)], "doc_id long, quality int, toxic int")
    found = bytecnn.quality_scores(odd, labels).collect()
    assert len(found) == odd.count()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert all((r["probability"] is None) == (not texts[r["doc_id"]]) for r in found if r["doc_id"] is not None)
    single = bytecnn.quality_scores(odd, labels.where("quality = 1")).collect()
    assert all(r["probability"] is None and r["keep"] for r in single)


def test_quality_stage_keeps_the_columns(spark, odd):
    found = corpus_pipeline.quality_rules(spark, odd, "")
    assert found.dtypes == odd.dtypes and found.count() <= odd.count()


def test_pipeline_is_brute_force(spark, documents, tmp_path, monkeypatch):
    """All stages' results, and that those of ``run`` are the last one's."""
    monkeypatch.setattr(fertility, "FEWEST", 10)
    bad = [(5_000_000 + k, t, "en", "s", len(t)) for k, t in enumerate(("\x01\x02 §¶† " * 400, "zq" * 3000, "a " * 900))]
    parts = documents.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(bad, "doc_id long, text string, lang string, source string, n_chars long"))
    parts.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    expected = sorted((r["doc_id"], r["text"], r["lang"]) for r in docs.collect())
    assert len({d for d, _, _ in expected}) == len(expected)
    steps = (brute.quality, brute.lines, brute.near, lambda d: brute.passages(d, bwt.LEAST))
    for (name, stage), step in zip(corpus_pipeline.STAGES, steps):
        before, expected = len(expected), sorted(step(expected))
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert sorted((r["doc_id"], r["text"], r["lang"]) for r in docs.collect()) == expected, name
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect()) or name != "line dedup"
        assert len(expected) < before or name == "suffix-array dedup"
    wanted = brute.bins(expected, packing.CAPACITY)
    for packed in (corpus_pipeline.best_fit(spark, docs, ""), corpus_pipeline.run(spark, str(tmp_path))):
        fill = collections.Counter()
        for r in packed.collect():
            fill[r["bin_id"]] += r["n_tokens"]
        assert sorted(fill.values()) == wanted


def test_queries_are_registered():
    names = [n.split("_")[0] for n in queries.QUERIES]
    assert names == [f"op{k}" for k in range(1, 11)] and set(queries.ORACLES) <= set(queries.QUERIES)


def test_strange_ids_and_names(spark, strange):
    """Every operator and stage with ids as text and clashing names."""
    number = {r["doc_id"] for r in strange.collect()}
    for made in (fertility.fertility_rules(strange), bpe.encode(strange), lines.line_bitmaps(strange)):
        assert collections.Counter(r["doc_id"] for r in made.collect()) == collections.Counter(r["doc_id"] for r in strange.collect())
    groups = {(r["doc_id"], r["group_id"], r["group_size"]) for r in minmax.near_duplicates(strange).collect()}
    assert {d for d, _, n in groups if n == 3} == {"p-1", "p-2", None} and {d for d, _, n in groups if n == 2} == {"q"}
    passages = [(r["doc_id"], r["kind"], r["end_word"] - r["start_word"]) for r in bwt.repeated_passages(strange).collect()]
    assert sorted((d, n) for d, _, n in passages if n == 60) == [("p-1", 60), ("p-3", 60)] and len({k for d, k, n in passages if n == 60}) == 2
    assert {r["doc_id"] for r in packing.best_fit_packing(strange, 64).collect()} == number
    docs = strange
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, "")
        assert found.columns == strange.columns and found.dtypes == strange.dtypes
        rows_found = found.collect()
        before = collections.Counter(r["_row"] for r in docs.collect())
        assert not collections.Counter(r["_row"] for r in rows_found) - before  # other columns as they were
        assert any(r["doc_id"] is None and r["text"] is None for r in rows_found), name
        docs = found
    assert sum(r["doc_id"] == "q" and r["text"] == "three" for r in docs.collect()) == 1


def test_quality_stage_judges_null_ids(spark, documents):
    """Rows without an id go by their own text."""
    bad = "\x01\x02 §¶† " * 400
    made = documents.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(None, bad, "en"), (None, "plain words here", "en"), (-(1 << 63), "words", "en")], "doc_id long, text string, lang string"))
    kept = corpus_pipeline.quality_rules(spark, made, "").where("doc_id IS NULL OR doc_id < 0").collect()
    assert sorted((r["doc_id"] is None, r["text"]) for r in kept) == [(False, "words"), (True, "plain words here")]


def test_least_id_is_no_null(spark):
    made = spark.createDataFrame(rows("same words in both", "same words in both", first=0), SCHEMA)
    made = made.withColumn("doc_id", F.when(F.col("doc_id") == 0, F.lit(None)).otherwise(F.lit(-(1 << 63))))
    found = {(r["doc_id"], r["group_size"]) for r in minmax.near_duplicates(made).collect()}
    assert found == {(None, 2), (-(1 << 63), 2)}


@pytest.mark.parametrize("block", [50_000, 40])
def test_a_bucket_in_blocks(spark, documents, block, monkeypatch):
    usual = collections.Counter(map(tuple, minmax.near_duplicates(documents).collect()))
    monkeypatch.setattr(minmax, "BLOCK", 2 if block == 40 else block)
    monkeypatch.setattr(minmax, "DIRECT", 1)
    assert collections.Counter(map(tuple, minmax.near_duplicates(documents).collect())) == usual


def test_row_that_stays_is_defined(spark):
    made = [(1, "a b c d e", lang, source, 9) for lang in ("fr", "en", "de") for source in ("x", "y")]
    kept = set()
    for order in (made, made[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        kept.add(tuple(map(tuple, corpus_pipeline.near_dedup(spark, docs, "").collect())))
    assert len(kept) == 1 and len(kept.pop()) == 1


def test_fit_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {k % 100}") for k in range(3000)] + [(2, "z" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(bytecnn, "fit", lambda texts, labels: seen.append(list(texts)))
    bytecnn.fit_on(docs, labels, 2)
    bytecnn.fit_on(docs, labels, 1000, 60)
    assert len(seen[0]) == 2 and len(seen[1]) == len(set(seen[1])) and sum(map(len, seen[1])) <= 60


def test_pages_that_share_an_id(spark):
    made = [("p-1", "u", "<a>"), ("p-1", "u", "<b>" * 900), (None, None, "x"), (None, "v", "y"), ("null", "u", "z"), ("a b%/>é", "u", "w"), ("p-1", "u", "<a>")]
    pages = spark.createDataFrame(made, "page_id string, url string, html string")
    found = warc.reassembled_pages(pages).collect()
    assert collections.Counter((r["page_id"], r["url"], r["html"]) for r in found) == collections.Counter(set(made)) and {r["status"] for r in found} == {"ok"}


def test_files_of_records(spark):
    import gzip

    records = warc.records_of("p", "http://a/", "é" * 3000) + warc.records_of("q", None, "WARC/1.1 inside\r\n\r\n")
    files = [b"".join(records), b"".join(map(gzip.compress, records)), None, b"", b"\x1f\x8bnot", records[0][:-100]]
    table = spark.createDataFrame([(f,) for f in files], "content binary")
    found = warc.reassemble(warc.records_of_files(table)).collect()  # both files have the same records
    assert sorted((r["status"], r["body"]) for r in found) == [("ok", "WARC/1.1 inside\r\n\r\n"), ("ok", "é" * 3000)]
