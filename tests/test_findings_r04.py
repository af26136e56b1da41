"""Findings of round 4: each test failed before."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tessera.functions.rounding import rounded_array
from tessera.operators import hybrid, postings, rows
from tessera.operators.store import bucket


def test_fusion_rounds_as_its_sql(spark):
    """F1: 0.7 and 0.3 times numbers of six decimals are often halfway between two such numbers."""
    rng = np.random.default_rng(6)
    b, v = (rng.integers(1, 10**6, 2000) / 1e6 for _ in range(2))
    rows = [(1, name, i, float(d[i]), i + 1) for name, d in (("bm25", b), ("vector", v)) for i in range(2000)]
    got = {r["doc_id"]: r["rerank"] for r in hybrid.fuse(spark.createDataFrame(rows, "query_id long, backend string, doc_id long, distance double, rank int")).collect()}
    values = ", ".join(f"({i}, {float(x)!r}::DOUBLE, {float(y)!r}::DOUBLE)" for i, (x, y) in enumerate(zip(b, v)))
    want = dict(duckdb.sql(f"SELECT i, round(0.7 * (1 - b) + (1 - 0.7) * (1 - v), 6) FROM (VALUES {values}) t(i, b, v)").fetchall())
    assert got == want


def test_halves_go_up(spark):
    """a cosine of 1/128 is halfway, as is 3/128, that of three of 16 query words among 1,024."""
    x = np.array([1 - 1 / 128, 1 - 3 / 128, -3 / 128, 0.25])
    assert rounded_array(x).tolist() == [r[0] for r in duckdb.sql("SELECT round(x, 6) FROM (VALUES (1, 1 - 1 / 128), (2, 1 - 3 / 128), (3, -3 / 128), (4, 0.25::DOUBLE)) t(i, x) ORDER BY i").fetchall()]
    docs = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(1024)))], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w1 w2 w3 " + " ".join(f"x{i}" for i in range(13)))], "query_id long, text string")
    assert [r["distance"] for r in hybrid.set_cosine(asked, docs, 1).collect()] == [0.976563]


def test_postings_travel_in_packs(spark):
    """a row for each term that documents read together hold; blocks are those of single postings, whether or not terms are split in groups."""
    rng = np.random.default_rng(7)
    words = ["often"] * 40 + [f"w{i}" for i in range(300)]
    docs = [(f"d{i}", ["often", *map(str, rng.choice(words, rng.integers(0, 40)))] if i % 50 else []) for i in range(1500)]
    each = spark.createDataFrame(docs, "doc_id string, tokens array<string>").repartition(3)
    want = sorted((t, d, ts.count(t), len(ts)) for d, ts in docs for t in set(ts))
    packs = rows.packs(each)
    assert packs.count() <= 3 * 301 < len(want) / 10
    facts = rows.lengths_and_frequent(each, 0.5).collect()
    assert sorted((r["doc_id"], r["dl"]) for r in facts if r["term"] is None) == sorted((d, len(ts)) for d, ts in docs)
    assert {r["term"] for r in facts if r["term"]} == {"often"} and sum(r["n"] or 0 for r in facts) == 1470
    often = spark.createDataFrame([("often", 1470), ("w1", 3)], "term string, df long")
    for done in (postings.blocks_of(packs, None, lambda t: bucket(t, 4)), postings.blocks_of(packs, often, lambda t: bucket(t, 4), big=128), postings.blocks(postings.decoded(postings.blocks_of(packs, None, lambda t: bucket(t, 1))), often, lambda t: bucket(t, 4))):
        found = done.withColumn("ok", F.forall("docs", lambda d: postings.part_of(d, F.col("parts")) == F.col("part"))).collect()
        assert all(r["ok"] and r["docs"] == sorted(r["docs"]) and r["n"] == len(r["docs"]) and r["max_tf"] == max(r["tfs"]) and r["min_dl"] == min(r["dls"]) for r in found)
        assert len({(r["term"], r["part"]) for r in found}) == len(found) and {r["parts"] for r in found if r["term"] == "often"} == {32}
        assert sorted((r["term"], *p) for r in found for p in zip(r["docs"], r["tfs"], r["dls"])) == want


def test_repacked_leaves_replaced_rows_out(spark, monkeypatch):
    """what merges keep of blocks, in place and by a join where too many ids are replaced."""
    blocks = spark.createDataFrame([(0, "x", ["a", "b"], [1, 2], [3, 4]), (0, "y", ["b"], [1], [4]), (1, "x", ["b", "c"], [5, 6], [7, 8])], "seg int, term string, docs array<string>, tfs array<int>, dls array<int>")
    dead = spark.createDataFrame([("b", 1), ("nowhere", 2)], "doc_id string, dead int")
    key = lambda packs: sorted((r["term"], *p) for r in packs.collect() for p in zip(r["docs"], r["tfs"], r["dls"]))
    want = [("x", "a", 1, 3), ("x", "b", 5, 7), ("x", "c", 6, 8)]
    assert key(postings.Reader(blocks, dead, None).packs()) == want
    assert key(postings.Reader(blocks, dead.limit(0), None).packs()) == key(postings.Reader(blocks, None, None).packs()) == sorted([*want, ("x", "b", 2, 4), ("y", "b", 1, 4)])
    monkeypatch.setattr(postings, "BROADCAST_IDS", 1)
    assert key(postings.Reader(blocks, dead, None).packs()) == want
