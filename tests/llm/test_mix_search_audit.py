"""The audit, the search and the mix against their SQL, on sample tables and on awkward ones, and by hand."""

import math
import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import curriculum, divergence, lexical, queries

FOLDER = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string"
LONG = " ".join(f"w{i % 97} and the rest of it {i}" for i in range(20000))
AWKWARD = [
    (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t", None, None), (4, LONG, "en", "a"), (5, "The cat sat. The CAT! Élan é1x", "en", "b"), (6, "the cat sat on the mat", "en", "b"),
    (6, "the cat sat on the mat", "en", "b"), (6, "another cat", "en", "b"), (None, "the cat and the dog", "en", "c"), (None, "the cat and the dog", "en", "c"), (7, "der hund", "de", "a"), (8, "12 34", "fr", "z"),
    (9, "x y", "fr", "q"), (10, "cat " * 50, None, "b"), (11, "日本語 cat\x00the\x7fmat", "en", "\U0001f600"), (12, "the", "en", "ﬀ"), (13, "cat", "", ""),
]
ITEMS = [(1, "the cat"), (2, None), (None, "cat cat mat"), (3, ""), (4, "unheard"), (1, "the cat"), (5, "日本語 é1x w5 w5"), (6, "Dog. HUND"), (7, "and")]


def documents(spark, rows=AWKWARD):
    return spark.createDataFrame(rows, DOCUMENTS).withColumns({n: F.lit(i) for i, n in enumerate(("term", "n", "item", "part", "rank", "size", "range", "missing", "score"))})


def by_sql(sql, docs, items=()):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.execute("create table benchmark (item_id bigint, text varchar)")
    for name, rows in (("documents", docs), ("benchmark", items)):
        for row in rows:
            con.execute(f"insert into {name} values ({', '.join('?' * len(row))})", row)
    found = con.sql(sql)
    return found.columns, ordered(found.fetchall())


def ordered(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"create view {file.split('.')[0]} as select * from '{FOLDER}/{file}'")
    found = con.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(found.columns)
    rows = ordered(df.select(*found.columns).collect())
    assert rows and rows == ordered(found.fetchall())


def test_parts_of_tables_that_the_optimizer_cannot_size(spark):
    import functools

    from seriesloom.llm import _arrays

    docs = spark.range(2000).select("id", F.repeat(F.lit("x"), 50_000).alias("text"))
    mixed = functools.reduce(lambda a, _: a.join(docs.select("id"), "id"), range(12), docs)
    assert _arrays.input_bytes(mixed) >= _arrays.UNKNOWN and _arrays.measured_bytes(mixed) == 2000 * (50_000 + 16)
    assert _arrays.part_count(mixed) == 24 and _arrays.file_count(mixed) == 4


# audit


@pytest.mark.parametrize("more", [{}, {"block": 1, "chunk_rows": 20}])
def test_audit_of_awkward_tables(spark, more):
    columns, expected = by_sql(queries.DIVERGENCE_SQL, AWKWARD)
    found = divergence.audit(documents(spark), **more)
    assert ordered(found.select(*columns).collect()) == expected
    assert any(r[0] == "fr" and r[4] == 0 for r in expected) and any(r[2] == "term" for r in expected)


def test_audit_by_hand(spark):
    rows = [(1, "x x y", "l", "a"), (2, "x y", "l", "b"), (3, "y x z", "l", "b")]
    found = {(r.source, r.part, r.item): (r.value, r.rank) for r in divergence.audit(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    p = {"a": (1 + 10**9 * 3 // 5, 1 + 10**9 * 2 // 5), "b": (1 + 10**9 * 3 // 6, 1 + 10**9 * 3 // 6), "": (1 + 10**9 * 5 // 9, 1 + 10**9 * 4 // 9)}
    f = lambda x, y: (x - y) ** 2 // y
    assert found == {
        ("a", "pair", "b"): (sum(map(f, p["a"], p["b"])), 1), ("b", "pair", "a"): (sum(map(f, p["b"], p["a"])), 1),
        ("a", "term", "x"): (f(p["a"][0], p[""][0]), 1), ("b", "term", "y"): (f(p["b"][1], p[""][1]), 1),
    }


def test_audit_of_many_sources_and_none(spark):
    words = [f"{c}{d}" for c in "abcdefg" for d in "hijkl"]
    rows = [(i, " ".join(words[j % len(words)] for j in range(i % 17, i % 17 + i % 29)), "l", f"s{i % 40:02d}") for i in range(600)]
    _, expected = by_sql(queries.DIVERGENCE_SQL, rows)
    assert ordered(divergence.audit(spark.createDataFrame(rows, DOCUMENTS), block=7, chunk_rows=100).collect()) == expected
    assert divergence.audit(documents(spark).limit(0)).count() == 0


def test_shares_beyond_64_bits():
    n, whole, terms = np.array([[0, 7 * 10**12, 10**12]]), np.array([9 * 10**12]), 10**8
    assert divergence.shares(n, whole, terms)[0].tolist() == [1 + 10**9 * (k + 1) // (9 * 10**12 + 10**8) for k in n[0].tolist()]


def test_task_tables_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 3)
    batches = [pa.RecordBatch.from_pydict({"lang": ["l"], "source": ["s"], "text": [t]}) for t in ("a b c", "A d", "e f g h", "")]
    found = Counter()
    out = list(divergence.count_terms(iter(batches)))
    for b in out:
        for r in b.to_pylist():
            found[r["term"]] += r["n"]
    assert len(out) > 2 and found == Counter({"a": 2, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1, "g": 1, "h": 1, "": 0})


# search


@pytest.mark.parametrize("more", [{}, {"item_bytes": 12}])
def test_search_of_awkward_tables(spark, more, monkeypatch):
    monkeypatch.setattr(lexical, "TRIPLES", 4)
    columns, expected = by_sql(queries.SEARCH_SQL, AWKWARD, ITEMS)
    found = lexical.search(documents(spark), spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("item", F.lit(1)), **more)
    assert ordered(found.select(*columns).collect()) == expected
    assert {r[0] for r in expected} == {1, None, 5, 6, 7}


def test_search_by_a_loop_over_all_documents(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    terms = {i: Counter(split(t)) for i, t in rows}
    count, length = sum(1 for c in terms.values() if c), sum(sum(c.values()) for c in terms.values())
    df = Counter(t for c in terms.values() for t in c)
    expected = []
    for item, text in items:
        scores = defaultdict(int)
        for t in split(text):
            w = math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
            for i, c in terms.items():
                if t in c:
                    scores[i] += w * (10**9 * c[t] // (1000 * c[t] + 8 * (25 + 75 * sum(c.values()) * count // length)))
        best = sorted((-s, i) for i, s in scores.items() if s > 0)[:10]
        expected += [(item, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert ordered(queries.op12_lexical_search(spark, FOLDER).collect()) == ordered(expected)


def test_ties_by_identifier_over_many_parts(spark):
    rows = [(i, "same words here", "en", "s") for i in range(500, 0, -1)] + [(None, "same words here", "en", "s")] * 20 + [(1000 + i, "other", "en", "s") for i in range(600)]
    found = lexical.search(spark.createDataFrame(rows, DOCUMENTS).repartition(9), spark.createDataFrame([(1, "words")], "item_id long, text string"))
    assert [(r.rank, r.doc_id) for r in found.orderBy("rank").collect()] == [(i, i) for i in range(1, 11)]
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert lexical.search(documents(spark), nothing).count() == 0 == lexical.search(documents(spark).limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count()


def test_radix_order():
    keys = np.random.default_rng(1).integers(0, 1 << 50, 5000, dtype=np.uint64)
    assert (keys[lexical.radix_order(keys)] == np.sort(keys)).all() and len(lexical.radix_order(keys[:0])) == 0
    items, docs, sums = lexical.accumulated(np.array([2, 0, 2, 0]), np.array([1, 3, 1, 2]), np.array([5, 6, 7, 8]))
    assert (items.tolist(), docs.tolist(), sums.tolist()) == ([0, 0, 2], [2, 3, 1], [8, 6, 12])


# mix


def test_mix_of_awkward_tables(spark):
    columns, expected = by_sql(queries.MIX_SQL, AWKWARD)
    found = curriculum.mix(documents(spark)).select(*columns).collect()
    assert ordered(found) == expected
    assert curriculum.mix(documents(spark).limit(0)).count() == 0
    bare = [(1, None, "en", "a"), (2, "", "en", None)]
    assert ordered(curriculum.mix(spark.createDataFrame(bare, DOCUMENTS)).collect()) == [(1, 0, 0, 0.0, 0, None, None), (2, 0, 0, 0.0, 0, None, None)]


def test_mix_of_a_hot_source_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(curriculum, "RANGE_ROWS", 1)
    rows = [(i if i % 7 else None, "w " * (i % 23), "en", "hot" if i % 3 else f"s{i % 30:02d}") for i in range(1500)] + [(5, "a b c", "en", "hot")] * 400
    columns, expected = by_sql(queries.MIX_SQL, rows)
    docs = spark.createDataFrame(rows, DOCUMENTS)
    found = ordered(curriculum.mix(docs).select(*columns).collect())
    assert found == expected == ordered(curriculum.mix(docs.repartition(7)).select(*columns).collect())
    assert all(r[4] <= 2 * r[1] for r in found)
    taken = defaultdict(int)
    for r in found:
        taken[r[2], r[3]] += r[4]
    assert len(taken) == 11 and all(abs(n - t) < 1 for (_, t), n in taken.items())


def test_schedule_is_in_order_and_follows_demand(spark):
    rows = [(i, "w " * 10, "en", "abc"[i % 3]) for i in range(900)]
    plan = curriculum.schedule(spark.createDataFrame(rows, DOCUMENTS)).collect()
    positions = [r.position for r in plan]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] < 1
    assert sum(r.words for r in plan) == 13500 - 0 and {r.repeat for r in plan} == {0, 1}
    for source, s in zip("abc", curriculum.SCHEDULES, strict=True):
        own = [r for r in plan if r.source == source]
        whole, (a, b) = sum(r.words for r in own), (s[0][1], s[1][1])
        for t in (0.25, 0.5, 0.75):
            share = (a * t + (b - a) * t * t / 2) / curriculum.integral(s)
            assert abs(sum(r.words for r in own if r.position < t) - share * whole) <= 10


def test_schedules_of_several_pieces(spark):
    bent = ((0.0, 0.0), (0.5, 4.0), (0.75, 0.0), (1.0, 0.0))
    assert curriculum.integral(bent) == 1.5
    shares = spark.createDataFrame([(x,) for x in (0.0, 0.25, 2 / 3, 0.9)], "u double").select(curriculum.due(F.col("u"), bent).alias("t"))
    weight = lambda t: (4 * t * t if t <= 0.5 else 1 + 0.5 - 8 * (0.75 - t) ** 2) / 1.5
    for u, r in zip((0.0, 0.25, 2 / 3, 0.9), shares.collect(), strict=True):
        assert abs(weight(r.t) - u) < 1e-9
    with pytest.raises(ValueError):
        curriculum.checked((((0.0, 1.0), (0.5, 1.0)),))


def test_shards_number_by_bytes(spark, tmp_path, monkeypatch):
    from seriesloom.llm import sstable

    monkeypatch.setattr(sstable, "SHARD_BYTES", 2000)
    docs = spark.createDataFrame([(i, "some words of a text " * 20) for i in range(60)], "doc_id long, text string")
    manifest = sstable.write_shards(docs, queries.tokenizer_path(), 2, str(tmp_path))
    found = sstable.read_shards(spark, manifest).orderBy("start").collect()
    assert len(manifest) > 8 and [r.doc_id for r in found] == list(range(60)) and found[-1].start + found[-1].n_tokens == sum(x["n_tokens"] for x in manifest)
