import pytest
from pyspark.sql import functions as F

from tessera.config import EngineConfig
from tessera.functions.models import HashingEmbedder
from tessera.functions.text import morphological
from tessera.operators.backends import Backends, VectorBackend
from tessera.operators.store import IndexStore
from tessera.sources import readers

CHUNK = "doc_id string, source_id string, serial_number int, text string, metadata string"


def test_backends(spark, tmp_path):
    """Writes fan out, searches come back in one form, whatever is active; a formatter of one's own."""
    chunks = lambda *rows: spark.createDataFrame([(i, "s", k, t, m) for k, (i, t, m) in enumerate(rows)], CHUNK)
    both = Backends.from_config(spark, f"file://{tmp_path}/both", EngineConfig({"BACKENDS": {"GRAPHS": "true"}}), HashingEmbedder(32))
    both.upsert(chunks(("a", "red apple", '{"k": 1}'), ("b", "green apple", '{"k": 2}'), ("c", "blue sky", '{"k": 1}')))
    both.insert(chunks(("c", "not this", "{}"), ("d", "apple tree", '{"k": 3}')))
    ask = spark.createDataFrame([("q", "apple")], "query_id string, text string")
    hits = lambda found, name: sorted(r["doc_id"] for r in found if r["backend"] == name)
    found = both.search(ask, 3).collect()
    assert hits(found, "bm25") == ["a", "b", "d"] and hits(found, "vector") == ["a", "b", "d"]
    found = both.search(ask, 3, {"k": 2}).collect()
    assert hits(found, "bm25") == hits(found, "vector") == ["b"]
    both.delete_by_ids(spark.createDataFrame([("a",)], "doc_id string"))
    both.delete_by_metadata(k=2)
    found = both.search(ask, 3).collect()
    assert hits(found, "bm25") == ["d"] and "a" not in hits(found, "vector") and "b" not in hits(found, "vector")
    near = both.active["bm25"].enhance(spark.createDataFrame([("q", "bm25", "d", 0.1, 1)], "query_id string, backend string, doc_id string, distance double, rank int")).first()
    assert near["enhanced_text"] == "apple treeblue sky"

    class Upper:
        def rows(self, backend, found):
            return found.select(F.upper("doc_id").alias("id"), F.lit(backend).alias("of"))

    both.formatter = Upper()
    assert ("D", "bm25") in {tuple(r) for r in both.search(ask, 1).collect()}


def test_choice(spark, tmp_path):
    with pytest.warns(UserWarning, match="no backend"):
        none = Backends.from_config(spark, f"file://{tmp_path}/none", EngineConfig({"BACKENDS": {"VECTOR": "false", "LEXICAL": "off"}}))
    with pytest.raises(ValueError, match="no backend"):
        none.search(spark.createDataFrame([("q", "x")], "query_id string, text string"), 1)
    assert list(Backends.from_config(spark, f"file://{tmp_path}/one", EngineConfig({"BACKENDS": {"VECTOR": "false"}})).active) == ["bm25"]
    with pytest.raises(ValueError, match="embedder"):
        VectorBackend(IndexStore(spark, f"file://{tmp_path}/x"))


def test_bad_pages():
    """A page that cannot be read is empty; the others are there."""

    class Page:
        def __init__(self, text):
            self.text = text

        def get(self):
            if self.text is None:
                raise RuntimeError("broken")
            return self.text

    assert readers.pages([Page("one"), Page(None), Page("")], lambda p: p.get()) == [(0, "one"), (1, ""), (2, "")]


def test_analyser_in_batches(spark):
    def analyse(texts):
        return [[("名詞", w) for w in t.split()] for t in texts]

    df = spark.createDataFrame([("b A",), (None,), ("c",)], "t string")
    assert [r[0] for r in df.select(morphological(F.col("t"), analyse, batched=True)).collect()] == [["b", "a"], [], ["c"]]
