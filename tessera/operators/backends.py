"""Index backends behind one interface, chosen by configuration; writes fan out to all, searches come back in one long form."""

from __future__ import annotations

import warnings
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import models
from ..functions.text import tokenize
from . import hybrid, lexical, vector
from .store import IndexStore


class Backend(Protocol):
    """Rows are chunks (doc_id, text, metadata, ...), queries (query_id, text); a search gives (query_id, doc_id, distance, rank)."""

    def insert(self, chunks: DataFrame) -> None: ...

    def upsert(self, chunks: DataFrame) -> None: ...

    def delete_by_ids(self, ids: DataFrame) -> None: ...

    def delete_by_metadata(self, **equal) -> None: ...

    def search(self, queries: DataFrame, k: int, where: dict | None = None) -> DataFrame: ...

    def enhance(self, hits: DataFrame, before: int = 1, after: int = 1) -> DataFrame: ...


class Formatter(Protocol):
    def rows(self, backend: str, found: DataFrame) -> DataFrame: ...


class LongForm:
    """(query_id, backend, doc_id, distance, rank)."""

    def rows(self, backend: str, found: DataFrame) -> DataFrame:
        return found.select("query_id", F.lit(backend).alias("backend"), F.col("doc_id").cast("string").alias("doc_id"), "distance", "rank")


class StoreBackend:
    """What both kinds share: a store that keeps the chunks, for metadata and context."""

    def __init__(self, store: IndexStore):
        self.store = store

    def insert(self, chunks: DataFrame) -> None:
        """Ids that are stored stay as they are."""
        new = chunks.dropDuplicates(["doc_id"])
        if self.store.has("chunks"):
            new = new.join(self.store.by_ids(new.select("doc_id")).select("doc_id"), "doc_id", "left_anti").select(chunks.columns)
        self.store.write(new)

    def upsert(self, chunks: DataFrame) -> None:
        self.store.write(chunks.dropDuplicates(["doc_id"]))

    def delete_by_ids(self, ids: DataFrame) -> None:
        self.store.write(dead=ids)

    def delete_by_metadata(self, **equal) -> None:
        self.store.write(dead=self.store.where(**equal).select("doc_id"))

    def enhance(self, hits: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
        return hybrid.enhance(hits, self.store.table("chunks"), before, after, fallback=True)


class LexicalBackend(StoreBackend):
    def __init__(self, store: IndexStore, config: EngineConfig | None = None):
        super().__init__(store)
        self.config = config or EngineConfig()

    def search(self, queries: DataFrame, k: int, where: dict | None = None) -> DataFrame:
        k1, b, delta = (float(self.config.get("BM25", x)) for x in ("K1", "B", "DELTA"))
        terms = lexical.query_terms(queries, tokens=self.store.tokens)
        return self.store.ranked(terms, k, k1, b, delta, self.store.where(**where).select("doc_id") if where else None)


class VectorBackend(StoreBackend):
    """The store's embedder makes the vectors; queries bring an `embedding`, or a text that it embeds with `prefix`."""

    def __init__(self, store: IndexStore, prefix: str = ""):
        super().__init__(store)
        if store.embedder is None:
            raise ValueError("a vector backend needs an embedder")
        self.prefix = prefix

    def search(self, queries: DataFrame, k: int, where: dict | None = None) -> DataFrame:
        if "embedding" not in queries.columns:
            queries = queries.select("query_id", models.embed(F.concat(F.lit(self.prefix), "text"), self.store.embedder).alias("embedding"))
        if self.store.graphs and not where:
            return self.store.near(queries, k)
        rows = self.store.table("vectors")
        for name, value in (where or {}).items():
            rows = rows.where(lexical.metadata_equals(F.col("metadata"), name, value))
        return vector.search(rows, queries, k, "doc_id")


class Backends:
    """All active backends as one: writes go to each in turn, the vectors first; searches are put in long form, unmerged."""

    def __init__(self, active: dict[str, Backend], formatter: Formatter | None = None):
        self.active, self.formatter = active, formatter or LongForm()
        if not active:
            warnings.warn("no backend is active: nothing is stored and no search finds anything", stacklevel=2)

    @classmethod
    def from_config(cls, spark: SparkSession, path: str, config: EngineConfig, embedder=None, prefixes: tuple[str, str] = ("", ""), tokens=tokenize, formatter: Formatter | None = None) -> Backends:
        """BACKENDS.VECTOR and BACKENDS.LEXICAL, true unless set to another word, and BACKENDS.GRAPHS, off unless true."""
        on = lambda name, default: (config.get("BACKENDS", name) or default).lower() == "true"
        active: dict[str, Backend] = {}
        if on("VECTOR", "true"):
            active["vector"] = VectorBackend(IndexStore(spark, f"{path.rstrip('/')}/vector", tokens, embedder, prefixes[1], graphs=on("GRAPHS", "false")), prefixes[0])
        if on("LEXICAL", "true"):
            active["bm25"] = LexicalBackend(IndexStore(spark, f"{path.rstrip('/')}/bm25", tokens), config)
        return cls(active, formatter)

    def insert(self, chunks: DataFrame) -> None:
        for b in self.active.values():
            b.insert(chunks)

    def upsert(self, chunks: DataFrame) -> None:
        for b in self.active.values():
            b.upsert(chunks)

    def delete_by_ids(self, ids: DataFrame) -> None:
        for b in self.active.values():
            b.delete_by_ids(ids)

    def delete_by_metadata(self, **equal) -> None:
        for b in self.active.values():
            b.delete_by_metadata(**equal)

    def search(self, queries: DataFrame, k: int, where: dict | None = None) -> DataFrame:
        found = [self.formatter.rows(name, b.search(queries, k, where)) for name, b in self.active.items()]
        if not found:
            raise ValueError("no backend is active")
        out = found[0]
        for x in found[1:]:
            out = out.unionByName(x)
        return out
