"""Abbreviations learned from counts, and table functions in SQL."""

import re

from pyspark.sql import functions as F

from tessera.functions import chunk, tables
from tessera.operators import sentences

TEXT = "Dr. Smith met Prof. Lee at approx. 3.14 p.m. on Monday. They talked about J. Doe e.g. in the lab. Nobody came! Was it late? "
FILL = "The lab was open. Many people came on Monday. Dr. Lee and Dr. Smith were in the lab. Prof. Doe and Prof. Smith were late. They came approx. at noon, approx. in time, e.g. by bus, e.g. on foot, at 5 p.m. as always. "


def learned(spark):
    return spark.createDataFrame([(FILL * 5,), (TEXT,), (None,), ("",)], "text string")


def test_abbreviations(spark):
    docs = learned(spark)
    counts = {r["word"]: (r["n_period"], r["n_plain"]) for r in sentences.words_and_periods(docs).collect()}
    text = FILL * 5 + TEXT
    for w in ("dr", "lab", "monday", "e.g"):
        before = len(re.findall(rf"(?<![\w.]){re.escape(w)}\.", text.lower()))
        assert counts[w] == (before, len(re.findall(rf"(?<![\w.]){re.escape(w)}(?![\w])", text.lower())) - before)
    found = {r["word"] for r in sentences.abbreviations(docs).collect()}
    assert {"dr", "prof", "e.g", "p.m"} <= found and not found & {"lab", "monday", "open", "smith"}


def test_split(spark):
    docs = learned(spark)
    found = sentences.abbreviations(docs)
    cut = lambda t: spark.createDataFrame([(t,)], "text string").select(sentences.split(F.col("text"), found)).first()[0]
    parts = cut("Dr. Smith met Prof. Lee at 3.14 p.m. in the lab. They saw J. Doe. Nobody came! Late?")
    assert parts == ["Dr. Smith met Prof. Lee at 3.14 p.m. in the lab.", " They saw J. Doe.", " Nobody came!", " Late?"]
    assert cut("") == [] and cut("no end") == ["no end"] and "".join(cut(TEXT)) == TEXT
    none = spark.createDataFrame([], "word string")
    assert spark.createDataFrame([("One. Two.",)], "text string").select(sentences.split(F.col("text"), none)).first()[0] == ["One.", " Two."]
    packed = spark.createDataFrame([(FILL,)], "text string").select(chunk.packed(F.col("text"), 60, sentences=lambda c: sentences.split(c, found)).alias("c")).first()[0]
    assert "".join(packed) == FILL and not any(p.rstrip().endswith(("Dr.", "Prof.", "e.g.")) for p in packed)


def test_table_functions(spark):
    tables.register(spark, {"chunk_words": lambda text: text.split()})
    docs = spark.createDataFrame([(1, FILL), (2, ""), (3, None), (4, "one. two")], "doc_id long, text string")
    got = spark.sql("SELECT doc_id, pos, chunk FROM {d}, LATERAL chunk_packed(text, 50)", d=docs)
    want = docs.select("doc_id", F.posexplode(chunk.packed(F.col("text"), 50)).alias("pos", "chunk"))
    assert sorted(got.collect()) == sorted(want.collect())
    assert [r[:] for r in spark.sql("SELECT pos, chunk FROM {d}, LATERAL chunk_words(text) WHERE doc_id = 4 ORDER BY pos", d=docs).collect()] == [(0, "one."), (1, "two")]
    files = spark.createDataFrame([("txt", bytearray(b"plain")), ("html", bytearray(b"<p>a</p>")), ("docx", bytearray(b"bad")), ("odd", bytearray(b"")), ("txt", None)], "kind string, content binary")
    got = spark.sql("SELECT kind, u.unit_index, u.text, u.error IS NOT NULL AS failed FROM {f}, LATERAL file_units(kind, content) u", f=files)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("txt", 0, "plain", False), ("html", 0, "a", False), ("docx", None, None, True), ("odd", None, None, True)], key=str)
