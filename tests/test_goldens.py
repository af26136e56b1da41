import math

import pytest
from pyspark.sql import functions as F

from tessera.errors import FrameError, MetadataError
from tessera.functions import chunk, text
from tessera.operators import context, hybrid, ingest, lexical, vector
from tessera.sources import notes_xml, readers


def chunks_of(spark, value, c):
    return spark.createDataFrame([(value,)], "text string").select(c(F.col("text"))).first()[0]


@pytest.mark.parametrize("value, want", [("HelloWorld", ["Hello", "World"]), ("Hi", ["Hi"]), ("こんにちは世界", ["こんにちは", "世界"]), ("", []), (None, [])])
def test_fixed(spark, value, want):
    assert chunks_of(spark, value, lambda c: chunk.fixed(c, 5)) == want


@pytest.mark.parametrize("value, want", [("Hello world. How are you?", ["Hello world.", " How are you?"]), ("Hello", ["Hello"]), ("こんにちは。元気ですか？はい、元気です！", ["こんにちは。", "元気ですか？", "はい、元気です！"]), (None, [])])
def test_natural_and_single(spark, value, want):
    assert chunks_of(spark, value, chunk.natural) == want
    assert chunks_of(spark, value, chunk.single) == ([value] if value else [])


def test_packing(spark):
    assert [len(x) for x in chunks_of(spark, "abc.abc.abc.abcdefghijk.a.", lambda c: chunk.packed(c, 10))] == [8, 4, 12, 2]


def test_chunked_rows(spark):
    df = spark.createDataFrame([("doc-1", "abcdefghij", "T")], "source_doc_id string, body_text string, database_title string")
    got = ingest.from_rows_chunked(df, "source_doc_id", "body_text", lambda c: chunk.fixed(c, 4)).orderBy("serial_number").collect()
    assert [(r["doc_id"], r["text"], r["chunk_index_in_page"], r["page_number"]) for r in got] == [(f"doc-1_No.{k}", t, k, 1) for k, t in enumerate(("abcd", "efgh", "ij"))]
    assert '"database_title":"T"' in got[0]["metadata"] and "body_text" not in got[0]["metadata"]
    with pytest.raises(FrameError):
        ingest.unique_ids(spark.createDataFrame([(1,), (1,)], "id long"), "id")
    with pytest.raises(MetadataError):
        ingest.split_metadata({"text": "x"})
    assert ingest.split_metadata({"id": 1, "doc_id": 2, "extra": 3}) == ({"doc_id": 1}, {"extra": 3})


CORPUS = [("d_No.0", "d", 0, "apple banana apple"), ("d_No.1", "d", 1, "banana cherry"), ("d_No.2", "d", 2, "cherry durian cherry elder")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, "doc_id string, source_id string, serial_number int, text string")


@pytest.mark.parametrize("q, want", [("apple", [("d_No.0", 2.382014, 0.295682)]), ("banana cherry", [("d_No.1", 2.045898, 0.32831), ("d_No.2", 1.07646, 0.481589), ("d_No.0", 0.940007, 0.515462)]),
                                     ("apple apple", [("d_No.0", 4.764028, 0.17349)]), ("zzz", [])])
def test_bm25(spark, corpus, q, want):
    got = lexical.search(spark.createDataFrame([(1, q)], "query_id long, text string"), corpus).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [w[0] for w in want]
    for r, w in zip(got, want):
        assert math.isclose(r["score"], w[1], abs_tol=2e-6) and math.isclose(r["distance"], w[2], abs_tol=2e-6)


def test_enhance_and_fusion(spark, corpus):
    hits = spark.createDataFrame([(1, "d_No.1"), (1, "d_No.0")], "query_id long, doc_id string")
    got = {r["doc_id"]: r["enhanced_text"] for r in hybrid.enhance(hits, corpus).collect()}
    assert got == {"d_No.1": "apple banana applebanana cherrycherry durian cherry elder", "d_No.0": "apple banana applebanana cherry"}
    rows = [(1, "bm25", "A", 0.2, 1), (1, "bm25", "B", 0.5, 2), (1, "vector", "B", 0.1, 1), (1, "vector", "C", 0.4, 2)]
    fused = hybrid.fuse(spark.createDataFrame(rows, "query_id long, backend string, doc_id string, distance double, rank int"))
    assert {(r["backend"], r["rank"]): (r["doc_id"], r["rerank"]) for r in fused.collect()} == {("bm25", 1): ("A", 0.8), ("bm25", 2): ("B", 0.62), ("vector", 1): ("B", 0.62), ("vector", 2): ("C", 0.6)}
    trimmed = hybrid.dedup_trim(spark.createDataFrame([(1, "x", 0.3, 1), (1, "y", 0.2, 2), (1, "x", 0.1, 3)], "query_id long, doc_id string, distance double, rank int"), 2)
    assert [(r["doc_id"], r["distance"]) for r in trimmed.orderBy("rank").collect()] == [("x", 0.1), ("y", 0.2)]


def test_context_format(spark):
    raw = "RAG Rank: 0\ndoc_id: d_No.1\nsemantic distance: 0.25\ncategory_1: c\nText: l1\nl2\n\n--- Optimized Queries ---\nq"
    r = context.parse(spark.createDataFrame([(raw,)], "context_string string")).first()
    assert (r["rag_rank"], r["doc_id"], r["semantic_distance"], r["category_1"], r["text"], r["notes_link"]) == (0, "d_No.1", 0.25, "c", "l1\nl2", "")
    r = context.parse(spark.createDataFrame([("RAG Rank: 3x\nsemantic distance: oops\nText: t",)], "context_string string")).first()
    assert (r["rag_rank"], r["semantic_distance"], r["text"]) == (0, 0.0, "t")
    one = spark.createDataFrame([([" a ", "", "a", "b", "c", "d"], "[[RAG_RANK=7]] x [[RAG_RANK=3]] [[RAG_RANK=3]]")], "q array<string>, a string")
    assert one.select(context.sanitize_queries(F.col("q")), context.cited_ranks(F.col("a"))).first()[:] == (["a", "b", "c"], [7, 3])


def test_vectors_and_links(spark):
    v = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)] + [(9, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = vector.search(v, spark.createDataFrame([(0, [0.0, 2.0])], "query_id long, embedding array<float>"), 2).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1] and got[0]["distance"] == 0
    link = text.link(F.lit("notes://server/db/"), F.col("r"), F.lit("U"))
    assert [x[0] for x in spark.createDataFrame([("R",), (None,)], "r string").select(link).collect()] == ["notes://server/db/R/0/U", None]


def test_readers():
    assert readers.html_to_text("<html><body><h1>Title</h1><script>x</script><p>Some &amp; paragraph.</p></body></html>") == "Title Some & paragraph."
    xml = '<database replicaid="R" title="T"><document form="F"><noteinfo unid="U" noteid="1"/><item name="Subject"><text>S</text></item><item name="Body"><richtext><par>a</par><table><tablerow><tablecell columnspan="2">x|y</tablecell></tablerow></table></richtext></item></document></database>'
    d = notes_xml.parse(xml)[0]
    assert d["doc_id"] == "R:U" and d["metadata"]["subject"] == "S" and "| x\\|y | x\\|y |" in d["body_text"]


def test_store_and_stream(spark, tmp_path):
    from tessera.operators.store import Engine
    from tessera.streaming.ingest import ingest_stream

    engine = Engine(spark, f"file://{tmp_path}/index")
    rows = spark.createDataFrame([("a", "one two."), ("b", "three one.")], "id string, body string")
    rows.write.parquet(str(tmp_path / "in"))
    ingest_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), engine, "id", "body", chunk.natural, str(tmp_path / "ck")).awaitTermination()
    q = spark.createDataFrame([(1, "one")], "query_id long, text string")
    assert engine.search(q).count() == 2
    engine.delete_by_ids(spark.createDataFrame([("a_No.0",)], "doc_id string"))
    assert [r["doc_id"] for r in engine.search(q).collect()] == ["b_No.0"]
    assert engine.store.postings_of(spark.createDataFrame([("one",)], "term string")).count() == 1


def test_segments_and_vectors(spark, tmp_path):
    """Upserts, inserts and deletes by segments, merged when many; vectors follow; both searches filter before they rank."""
    from tessera.functions.models import HashingEmbedder
    from tessera.operators.store import Engine

    engine = Engine(spark, f"file://{tmp_path}/index", embedder=HashingEmbedder(16), prefixes=("", ""))
    engine.store.fanout = 4
    rows = lambda *xs: spark.createDataFrame([(i, i, 0, t, m) for i, t, m in xs], "doc_id string, source_id string, serial_number int, text string, metadata string")
    engine.upsert(rows(("a", "red apple", '{"k": 1}'), ("b", "green apple", '{"k": 2}')))
    engine.upsert(rows(("a", "blue plum", '{"k": 1}'), ("c", "apple pie", '{"k": 1}')))
    engine.insert(rows(("b", "other", "{}"), ("d", "apple tree", '{"k": "1"}')))
    q = spark.createDataFrame([(1, "apple")], "query_id long, text string")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(engine.search(q)) == ["b", "c", "d"] and ids(engine.search(q, where={"k": 1})) == ["c"]
    assert ids(engine.store.table("vectors")) == ["a", "b", "c", "d"] and ids(engine.search_vectors(q, 2, where={"k": 1})) == ["a", "c"]
    engine.delete_by_metadata(k=2)  # the fourth segment: merged
    assert len(engine.store.segments()) == 1 and ids(engine.search(q)) == ["c", "d"] and ids(engine.store.table("vectors")) == ["a", "c", "d"]
    want = lexical.search(q, engine.store.table("chunks"), 10).select("doc_id", "score").collect()
    assert sorted(want) == sorted(lexical.ranked(lexical.query_terms(q), __import__("tessera.operators.store", fromlist=["Indexed"]).Indexed(engine.store), 10, 1.5, 0.75, 1.0).select("doc_id", "score").collect())


def test_ranking_is_exact(spark):
    """Floors and bounds drop nothing: the same as scoring every posting, ties included."""
    import random

    rnd = random.Random(3)
    words = [f"w{min(int(rnd.expovariate(0.08)), 60)}" for _ in range(6000)]
    docs = [(k, " ".join(rnd.choices(words, k=rnd.randint(1, 30)))) for k in range(300)]
    queries = [(k, " ".join(rnd.choices(words, k=8))) for k in range(12)]
    asked, corpus = spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = lexical.search(asked, corpus, 5).collect()
    n, avg = len(docs), sum(len(t.split()) for _, t in docs) / len(docs)
    df = {w: sum(w in t.split() for _, t in docs) for w in set(words)}
    want = []
    for q, words_asked in queries:
        scores = []
        for d, t in docs:
            ts = t.split()
            if set(ts) & set(words_asked.split()):
                parts = [max(0, math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1)) * (ts.count(w) * 2.5 / (ts.count(w) + 1.5 * (0.25 + 0.75 * len(ts) / avg)) + 1) for w in words_asked.split() if w in ts]
                scores.append((-round(sum(parts), 6), d))
        want += [(q, d, r + 1) for r, (_, d) in enumerate(sorted(scores)[:5])]
    assert sorted((r["query_id"], r["doc_id"], r["rank"]) for r in got) == sorted(want)
    each = corpus.select("doc_id", text.tokenize("text").alias("tokens"))
    got = lexical.ranked(lexical.query_terms(asked), lexical.Corpus(each), 5, 1.5, 0.75, 1.0, one_pass=0).collect()
    assert sorted((r["query_id"], r["doc_id"], r["rank"]) for r in got) == sorted(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
