"""The stored index: tables that change apart, merges by size, block postings, graphs, filters, vacuum."""

import math
import os
import random
import threading

import numpy as np
import pytest

from tessera.functions.models import HashingEmbedder
from tessera.operators import graph, lexical, postings, vector
from tessera.operators.store import Engine, IndexStore

CHUNK = "doc_id string, source_id string, serial_number int, text string, metadata string"


def chunks(spark, *rows):
    return spark.createDataFrame([(i, i, 0, t, m) for i, t, m in rows], CHUNK)


def vecs(spark, *rows):
    return spark.createDataFrame([(i, v, "{}") for i, v in rows], "doc_id string, embedding array<float>, metadata string")


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def one(spark, text):
    return spark.createDataFrame([("q", text)], "query_id string, text string")


def test_chunks_and_vectors_apart(spark, tmp_path):
    """Neither kind's writes touch the other; a deletion takes both, or the one that is named."""
    engine = Engine(spark, f"file://{tmp_path}/index")
    ask = spark.createDataFrame([("q", [1.0, 0.1])], "query_id string, embedding array<float>")
    engine.upsert(chunks(spark, *((k, f"red {k}", "{}") for k in "abcde")))
    engine.store.write(vectors=vecs(spark, ("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])))
    assert ids(engine.store.table("chunks")) == list("abcde") and ids(engine.search(one(spark, "red"))) == list("abcde")
    engine.upsert(chunks(spark, ("a", "blue a", "{}")))
    assert ids(engine.store.table("vectors")) == list("abc") and ids(engine.search(one(spark, "red"))) == list("bcde")
    engine.store.write(vectors=vecs(spark, ("a", [0.0, 1.0])))
    assert [r["doc_id"] for r in engine.search_vectors(ask, 1).collect()] == ["c"] and ids(engine.search(one(spark, "blue"))) == ["a"]
    engine.store.write(dead=spark.createDataFrame([("b",)], "doc_id string"), of=("vectors",))
    assert ids(engine.store.table("vectors")) == list("ac") and "b" in ids(engine.store.table("chunks"))
    engine.delete_by_ids(spark.createDataFrame([("a",)], "doc_id string"))
    engine.store.merge()
    assert ids(engine.store.table("vectors")) == ["c"] and ids(engine.store.table("chunks")) == list("bcde") and len(engine.store.segments()) == 1


def test_merges_by_size(spark, tmp_path):
    """Rows are written again once a size, not once a write, and what is merged equals an index built at once."""
    store, fanout, each, batches = IndexStore(spark, f"file://{tmp_path}/index", fanout=2), 2, 4, 6
    rnd, now, written = random.Random(2), {}, 0
    for k in range(batches):
        rows = {f"d{rnd.randrange(40)}": " ".join(rnd.choices("abcdefg", k=5)) for _ in range(each)}
        now |= rows
        store.write(chunks(spark, *((i, t, "{}") for i, t in rows.items())))
    for name in os.listdir(tmp_path / "index" / "segments"):
        written += spark.read.parquet(f"file://{tmp_path}/index/segments/{name}/chunks").count()
    assert len(store.segments()) <= 3 * math.ceil(math.log(batches, fanout))
    assert written <= each * batches * (1 + math.ceil(math.log(batches * each, fanout)))
    again = lexical.counted(lexical_tokens(spark, now))
    assert sorted(map(tuple, store.table("postings").collect())) == sorted(map(tuple, again.collect()))
    assert {r["doc_id"]: r["text"] for r in store.table("chunks").collect()} == now
    store.vacuum(keep=1, older_s=0)
    assert set(os.listdir(tmp_path / "index" / "segments")) == {s["segment"] for s in store.segments()}
    assert {r["doc_id"]: r["text"] for r in store.table("chunks").collect()} == now


def lexical_tokens(spark, docs):
    from tessera.functions.text import tokenize

    return spark.createDataFrame(list(docs.items()), "doc_id string, text string").select("doc_id", tokenize("text").alias("tokens"))


def test_merge_keeps_deletions_of_older_segments(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/index", fanout=100)
    store.write(chunks(spark, ("a", "one", "{}"), ("b", "two", "{}")))
    store.write(dead=spark.createDataFrame([("a",)], "doc_id string"))
    store.write(chunks(spark, ("c", "three", "{}")))
    store.merge(1, 3)
    assert ids(store.table("chunks")) == ["b", "c"] and len(store.segments()) == 2


def test_rival_writers(spark, tmp_path):
    stores = [IndexStore(spark, f"file://{tmp_path}/index", fanout=2) for _ in range(3)]
    threads = [threading.Thread(target=lambda k=k, s=s: s.write(chunks(spark, (f"d{k}", "word", "{}")))) for k, s in enumerate(stores)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert ids(stores[0].table("chunks")) == ["d0", "d1", "d2"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(5)
    words = [f"w{min(int(rnd.expovariate(0.03)), 200)}" for _ in range(20_000)]
    docs = {f"d{k}": " ".join(rnd.choices(words, k=rnd.randint(5, 40)) + ([f"topic{k % 160}"] * (1 + k % 4) if k % 7 == 0 else [])) for k in range(12_000)}
    store = IndexStore(spark, f"file://{tmp_path_factory.mktemp('blocks')}/index")
    store.write(spark.createDataFrame([(i, i, 0, t, "{}") for i, t in docs.items()], CHUNK))
    changed = {f"d{k}": "w1 w2 topic3 " + docs[f"d{k}"] for k in range(0, 12_000, 400)}
    store.write(spark.createDataFrame([(i, i, 0, t, "{}") for i, t in changed.items()], CHUNK))
    store.write(dead=spark.createDataFrame([(f"d{k}",) for k in range(0, 12_000, 111)], "doc_id string"))
    now = {i: t for i, t in (docs | changed).items() if int(i[1:]) % 111}
    return store, now, words


def test_blocks_leave_postings_unread(spark, corpus):
    """The same rows as scoring every posting, replaced and deleted documents included; most postings stay in their blocks."""
    store, now, words = corpus
    rnd = random.Random(9)
    queries = [(f"q{k}", " ".join([f"topic{5 * k}", *rnd.choices(words, k=2)])) for k in range(3)]
    asked = spark.createDataFrame(queries, "query_id string, text string")
    trace: dict = {}
    got = store.ranked(lexical.query_terms(asked), 5, 1.5, 0.75, 1.0, trace=trace, one_pass=0)
    want = lexical.search(asked, spark.createDataFrame(list(now.items()), "doc_id string, text string"), 5)
    columns = ["query_id", "doc_id", "score", "rank"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert trace["taken"] < trace["held"] / 3, trace
    only = spark.createDataFrame([(i,) for i in now if int(i[1:]) % 3 == 0], "doc_id string")
    got = store.ranked(lexical.query_terms(asked), 10, 1.5, 0.75, 1.0, allowed=only, one_pass=0)
    want = lexical.search(asked, spark.createDataFrame(list(now.items()), "doc_id string, text string"), 10, candidates=only)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    for one_pass in (0, lexical.ONE_PASS):
        got = store.ranked(lexical.query_terms(asked), 10, 1.5, 0.75, 1.0, allowed=only, one_pass=one_pass)
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert store.ranked(lexical.query_terms(one(spark, "nowhere to be found")), 10, 1.5, 0.75, 1.0).count() == 0


def test_blocks_are_bounded(spark, corpus):
    store, _, _ = corpus
    rows = store._rows(store.segments(), "postings")
    sizes = rows.selectExpr("max(n) AS n", "max(size(docs) - n) AS d").first()
    assert sizes["n"] <= 4 * postings.BLOCK and sizes["d"] == 0


def test_filters_open_matching_segments(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/index")
    for k in range(4):
        engine.upsert(chunks(spark, *((f"s{k}-{j}", "t", f'{{"part": {k}, "name": "n{j}", "flag": {"true" if k else "false"}, "many": {100 * k + j}}}') for j in range(300 if k == 3 else 20))))

    def opened(df):
        return {f.split("/segments/")[1].split("/")[0] for f in df.inputFiles() if "/chunks/" in f}

    names = [s["segment"] for s in engine.store.segments()]
    found = engine.store.by_ids(spark.createDataFrame([("s2-7",), ("none",), (None,)], "doc_id string"))
    assert ids(found) == ["s2-7"] and names[2] in opened(found) and len(opened(found)) <= 2
    found = engine.store.where(part=1, name="n3")
    assert ids(found) == ["s1-3"] and opened(found) == {names[1]}
    assert opened(engine.store.where(flag=False)) == {names[0]} and opened(engine.store.where(part="1")) == set() and engine.store.where(part="1").count() == 0
    assert ids(engine.store.where(many=305)) == ["s3-5"] and opened(engine.store.where(many=305)) == {names[3]}
    assert opened(engine.store.where(many=5)) == {names[0], names[3]}  # the last segment's values are too many to list
    assert engine.store.where(nothing=1).count() == 0


def test_insert_reads_few_segments(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/index", embedder=HashingEmbedder(8), graphs=True)
    engine.upsert(chunks(spark, ("a", "red apple", "{}")))
    engine.insert(chunks(spark, ("a", "other", "{}"), ("b", "green apple", "{}")))
    assert {r["doc_id"]: r["text"] for r in engine.store.table("chunks").collect()} == {"a": "red apple", "b": "green apple"}
    assert ids(engine.search_vectors(one(spark, "apple"), 2, approximate=True)) == ["a", "b"]


# -- graphs -----------------------------------------------------------------


def clustered(n, d=32, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(60, d))[rng.integers(60, size=n)] + 0.4 * rng.normal(size=(n, d))).astype(np.float32)


def test_graph_recall(spark, tmp_path):
    """0.9 of the exact hits and more, at under a quarter of the distances, with replaced and deleted rows and two segments."""
    x, new = clustered(6000), clustered(200, seed=1)
    store = IndexStore(spark, f"file://{tmp_path}/index", graphs=True)
    frame = lambda rows: spark.createDataFrame([(i, v.tolist()) for i, v in rows], "doc_id string, embedding array<float>")
    store.write(vectors=frame((f"v{k}", v) for k, v in enumerate(x)))
    store.write(vectors=frame((f"v{7 * k}", v) for k, v in enumerate(new)))
    store.write(dead=spark.createDataFrame([(f"v{k}",) for k in range(0, 6000, 13)], "doc_id string"))
    asked = frame((f"v{k}", x[k]) for k in range(3, 6000, 120)).withColumnRenamed("doc_id", "query_id")
    trace: dict = {}
    found = store.near(asked, 10, beam=48, trace=trace)
    exact = vector.search(store.table("vectors"), asked, 10, "doc_id")
    assert vector.recall(found, exact, "doc_id") >= 0.9
    assert trace["cost"] < 0.25 * 50 * 6200, trace
    both = found.join(exact.select("query_id", "doc_id", exact["distance"].alias("d")), ["query_id", "doc_id"])
    assert both.where("abs(distance - d) > 1e-6").count() == 0 and ids(found.where("doc_id = 'v0'")) == []
    store.merge()
    assert vector.recall(store.near(asked, 10, beam=48), exact, "doc_id") >= 0.9


def test_graph_small_and_odd(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/index", graphs=True)
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [1.0, 0.0]), ("e", [-1.0, 0.5])]
    store.write(vectors=vecs(spark, *rows))
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id long, embedding array<float>")
    assert [(r["query_id"], r["doc_id"], r["distance"]) for r in store.near(asked, 5).orderBy("rank").collect()] == [(1, "a", 0.0), (1, "d", 0.0), (1, "e", 1.894427)]
    x = np.ones((300, 4), np.float32) / 2  # all equal: any hits will do, but as many as asked
    node, score, _ = graph.Graph.build(x, 4).search(x[:3], 10, 16)
    assert (node >= 0).all() and np.allclose(score, 1)


def test_text_query_ids(spark):
    v = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([("q1", [0.0, 2.0])], "query_id string, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in vector.search(v, asked, 2).orderBy("rank").collect()] == [("q1", 0), ("q1", 1)]
    cells = vector.Cells(v, 2)
    assert cells.search(cells.assigned(v), asked, 2, probes=2).count() == 2
