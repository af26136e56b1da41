"""A persisted index of segments and the engine facade.

A segment is a folder of what one write brought: chunks, blocks of postings (partitioned by a
hash bucket of the term, so a query's terms prune partitions), lengths, vectors and, if asked for, their
proximity graphs. Each table has its own tombstones: `dead_chunks` and `dead_vectors` name the ids
whose rows in older segments are replaced or deleted there, so chunks and vectors of one id
live and change apart. For reading less, a segment also keeps a Bloom filter of its ids and
the values of its metadata keys that have few.

Small segments have few buckets, so a write makes few files. A write costs what it brings: when `fanout` neighbouring segments have grown to a like size,
they are merged into one of the next size, so a row is written again once a size, not once a write. A
merge moves postings and vectors; no text is tokenised or embedded again. The list of
segments is a `VersionLog`: readers see whole versions, and of two writers neither loses its
segment. `vacuum` deletes segments that no version names any longer.
"""

from __future__ import annotations

import math
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import EngineConfig
from ..functions import models
from ..functions.models import OverlapEvaluator
from ..functions.text import tokenize
from . import graph, hybrid, ingest, lexical, postings, rows, vector
from .manifest import VersionLog
from .staging import remove, stored

#: Buckets of a segment's terms at most, and chunks that a bucket is made for.
BUCKETS, BUCKET_CHUNKS = 64, 4000
KINDS = ("chunks", "vectors")
#: Of what kind each table's rows are.
OF = {"chunks": "chunks", "postings": "chunks", "doc_stats": "chunks", "values": "chunks", "vectors": "vectors", "graph": "vectors"}
#: Ids in a Bloom filter; more make it less sharp, never wrong. Values of a metadata key that are listed. Ids that a lookup tests one by one.
BLOOM_IDS, LISTED, LOOKED_UP = 4_000_000, 256, 10_000


def bucket(term, n: int):
    return F.pmod(F.xxhash64(term), F.lit(n)).cast("int")


def metadata_values(chunks: DataFrame) -> DataFrame:
    """(key, kind, value) of top-level metadata members, as text; a key of over `LISTED` values has the one row (key, null, null)."""
    spark, view = chunks.sparkSession, f"chunks_{uuid.uuid4().hex}"
    chunks.select(F.try_parse_json("metadata").alias("v")).createOrReplaceTempView(view)
    try:
        each = spark.sql(f"SELECT key, schema_of_variant(value) AS kind, try_variant_get(value, '$', 'string') AS value FROM {view}, LATERAL variant_explode(v) WHERE key IS NOT NULL").distinct()
    finally:
        spark.catalog.dropTempView(view)
    ranked = each.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("kind", "value"))).where(F.col("n") <= LISTED + 1)
    many = F.max("n").over(Window.partitionBy("key")) > LISTED
    return ranked.withColumn("many", many).where(~F.col("many") | (F.col("n") == 1)).select("key", F.when(~F.col("many"), F.col("kind")).alias("kind"), F.when(~F.col("many"), F.col("value")).alias("value"))


class IndexStore:
    """embedder: texts to vectors; prefix: put before a text that is embedded, never stored; graphs: whether vectors get a proximity graph."""

    def __init__(self, spark: SparkSession, path: str, tokens=tokenize, embedder=None, prefix: str = "", fanout: int = 8, graphs: bool = False):
        self.spark, self.path, self.tokens, self.embedder, self.prefix, self.fanout, self.graphs = spark, path.rstrip("/"), tokens, embedder, prefix, fanout, graphs
        self.log = VersionLog(spark, f"{self.path}/manifest")

    def version(self) -> int:
        return self.log.version()

    def segments(self, version: int | None = None) -> list[dict]:
        """Oldest first."""
        return self.log.entries(version)

    # -- reading
    def _read(self, segment: dict, name: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(segment["tables"][name])).parquet(f"{self.path}/segments/{segment['segment']}/{name}")

    def _dead(self, segments: list[dict], kind: str) -> DataFrame | None:
        """(doc_id, dead): rows of segments before `dead` are replaced. The first segment's ids hide nothing."""
        parts = [self._read(x, f"dead_{kind}").withColumn("dead", F.lit(k)) for k, x in enumerate(segments) if k and f"dead_{kind}" in x["tables"]]
        if not parts:
            return None
        gone = parts[0]
        for x in parts[1:]:
            gone = gone.unionByName(x)
        gone = gone.groupBy("doc_id").agg(F.max("dead").alias("dead"))
        if lexical.is_small(gone):
            return gone
        # a write names all its ids: those that no older segment holds hide nothing
        ids = self._rows(segments, "doc_stats" if kind == "chunks" else "vectors")
        if ids is None:
            return gone
        first = ids.groupBy("doc_id").agg(F.min("seg").alias("first"))
        return stored(gone.join(first, "doc_id").where(F.col("first") < F.col("dead")).select("doc_id", "dead"))

    def _rows(self, segments: list[dict], name: str, only: set[int] | None = None) -> DataFrame | None:
        """Rows of these segments with `seg`, replaced ones too; only: numbers of the segments to open."""
        rows = None
        for k, x in enumerate(segments):
            if name in x["tables"] and (only is None or k in only):
                one = self._read(x, name).withColumn("seg", F.lit(k))
                rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
        return rows

    def _live(self, segments: list[dict], name: str, only: set[int] | None = None) -> DataFrame | None:
        """Rows that no later segment replaces, with `seg`."""
        rows = self._rows(segments, name, only)
        dead = None if rows is None else self._dead(segments, OF[name])
        if dead is not None:
            rows = rows.join(lexical.small_ids(dead), "doc_id", "left").where(F.col("dead").isNull() | (F.col("dead") <= F.col("seg"))).drop("dead")
        return rows

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """chunks, postings (term, doc_id, tf, dl), doc_stats or vectors, as of a version."""
        segments = self.segments(version)
        if name == "postings":
            rows = self._rows(segments, "postings")
            if rows is not None:
                return self._reader(segments, rows).everything().select("term", "doc_id", "tf", "dl")
        elif (rows := self._live(segments, name)) is not None:
            return rows.drop("seg")
        raise ValueError(f"the index holds no {name}")

    def has(self, name: str) -> bool:
        return any(name in x["tables"] for x in self.segments())

    def _filters(self, segments: list[dict], kind: str) -> dict[int, object]:
        """Bloom filter of the ids, by segment number; one small file a segment."""
        read, out = self.spark._jvm.org.apache.spark.util.sketch.BloomFilter.readFrom, {}
        for k, x in enumerate(segments):
            if kind in x["bloom"]:
                path, store = self._file(x, f"bloom_{kind}")
                stream = store.open(path)
                out[k] = read(stream)
                stream.close()
        return out

    def _file(self, segment: dict, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/segments/{segment['segment']}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def by_ids(self, ids: DataFrame, name: str = "chunks") -> DataFrame:
        """Live rows of these ids (doc_id). Few ids are tested on the segments' filters, and only segments that may hold one are opened."""
        segments, only = self.segments(), None
        wanted = ids.select(F.col("doc_id").cast("string").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
        if lexical.is_small(wanted, LOOKED_UP):
            asked = [r[0] for r in wanted.collect()]
            filters = self._filters(segments, OF[name])
            only = {k for k, x in enumerate(segments) if name in x["tables"] and (k not in filters or any(filters[k].mightContainString(i) for i in asked))}
        rows = self._live(segments, name, only)
        if rows is None:
            return self._live(segments, name).limit(0).drop("seg") if self.has(name) else self.spark.createDataFrame([], "doc_id string")
        return rows.join(lexical.small(wanted), "doc_id", "left_semi").drop("seg")

    def where(self, **equal) -> DataFrame:
        """Live chunks whose metadata all equal these values, typed. Segments whose listed values rule them out are not opened."""
        segments = self.segments()
        listed = self._rows(segments, "values")
        only = {k for k, x in enumerate(segments) if "chunks" in x["tables"]}
        if listed is not None:
            found: dict = {}
            for r in listed.where(F.col("key").isin(list(equal))).collect():  # at most LISTED rows a key and segment
                found.setdefault((r["seg"], r["key"]), set()).add((r["kind"], r["value"]))
            kinds = {bool: "BOOLEAN", int: "BIGINT", str: "STRING"}
            for key, v in equal.items():
                text = str(v).lower() if isinstance(v, bool) else str(v)
                if type(v) in kinds:
                    may = lambda k: "values" not in segments[k]["tables"] or found.get((k, key), set()) & {(kinds[type(v)], text), (None, None)}  # noqa: E731, B023
                    only = {k for k in only if may(k)}
        rows = self._live(segments, "chunks", only)
        if rows is None:
            rows = self._live(segments, "chunks")
            if rows is None:
                raise ValueError("the index holds no chunks")
            return rows.limit(0).drop("seg")
        for key, v in equal.items():
            rows = rows.where(lexical.metadata_equals(F.col("metadata"), key, v))
        return rows.drop("seg")

    def _reader(self, segments: list[dict], rows: DataFrame, allowed: DataFrame | None = None, count: bool = False) -> postings.Reader:
        return postings.Reader(rows, self._dead(segments, "chunks"), allowed, count)

    def reader(self, terms: DataFrame, allowed: DataFrame | None = None, count: bool = False) -> postings.Reader:
        """The blocks of these terms; their buckets prune partitions, the sort prunes row groups."""
        segments, want = self.segments(), terms.select("term").distinct()
        hashes = {r[0] for r in want.select(bucket(F.col("term"), BUCKETS)).distinct().collect()}  # BUCKETS at most
        rows = None
        for k, x in enumerate(segments):
            if "postings" in x["tables"]:
                one = self._read(x, "postings").withColumn("seg", F.lit(k)).where(F.col("bucket").isin(sorted({h % x["buckets"] for h in hashes})))
                rows = one if rows is None else rows.unionByName(one)
        if rows is None:
            raise ValueError("the index holds no postings")
        return self._reader(segments, rows.join(lexical.small(want), "term", "left_semi"), allowed, count)

    def postings_of(self, terms: DataFrame, of: DataFrame | None = None) -> DataFrame:
        """Live postings (term, doc_id, tf, dl) of these terms, in the documents `of` if given."""
        reader = self.reader(terms, None if of is None else of.select("doc_id").distinct())
        return reader.everything().select("term", "doc_id", "tf", "dl")

    # -- writing
    def _put(self, made: dict, table: str, df: DataFrame, by: str | None = None) -> DataFrame:
        path = f"{self.path}/segments/{made['segment']}/{table}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        made["tables"][table] = df.schema.jsonValue()
        return self.spark.read.schema(df.schema).parquet(path)

    def _put_postings(self, made: dict, packs: DataFrame, often: DataFrame | None) -> None:
        """packs: as `rows.PACK`; often: (term, df), about how many postings frequent terms have."""
        made["buckets"] = 1 << int(math.log2(max(1, min(BUCKETS, made["rows"]["chunks"] // BUCKET_CHUNKS))))
        self._put(made, "postings", postings.blocks_of(packs, often, lambda term: bucket(term, made["buckets"])), "bucket")

    def _put_filter(self, made: dict, kind: str, ids: DataFrame, n: int) -> None:
        found = ids._jdf.stat().bloomFilter("doc_id", max(1, min(n, BLOOM_IDS)), 0.01)
        path, store = self._file(made, f"bloom_{kind}")
        stream = store.create(path, True)
        found.writeTo(stream)
        stream.close()
        made["bloom"].append(kind)

    def _put_vectors(self, made: dict, rows: DataFrame) -> DataFrame:
        kept = self._put(made, "vectors", rows)
        made["rows"]["vectors"] = kept.count()
        if self.graphs:
            self._put(made, "graph", graph.build(kept, "doc_id", made["rows"]["vectors"]))
        self._put_filter(made, "vectors", kept.select("doc_id"), made["rows"]["vectors"])
        return kept

    def _put_chunks(self, made: dict, rows: DataFrame) -> DataFrame:
        kept = self._put(made, "chunks", rows)
        made["rows"]["chunks"] = kept.count()
        self._put_filter(made, "chunks", kept.select("doc_id"), made["rows"]["chunks"])
        if "metadata" in kept.columns:
            self._put(made, "values", metadata_values(kept))
        return kept

    def _new(self) -> dict:
        return {"segment": uuid.uuid4().hex[:16], "at": time.time(), "tables": {}, "rows": {}, "bloom": []}

    def write(self, chunks: DataFrame | None = None, dead: DataFrame | None = None, vectors: DataFrame | None = None, of: tuple[str, ...] = KINDS) -> int:
        """Add a segment: these rows replace stored ones of their ids and kind. With an embedder, chunks bring their vectors.
        dead: ids that go from the tables `of`. Nobody sees the segment before its entry is committed. The version."""
        made, ids = self._new(), {}
        if chunks is not None:
            kept = self._put_chunks(made, chunks)
            each = kept.select("doc_id", F.coalesce(self.tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
            share = postings.BIG / max(1, made["rows"]["chunks"])
            facts = stored(rows.lengths_and_frequent(each, share))
            often = facts.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df")) if share < 1 else None
            self._put_postings(made, rows.packs(each), often)
            self._put(made, "doc_stats", facts.where("term IS NULL").select("doc_id", "dl"))
            ids["chunks"] = kept.select("doc_id")
            if self.embedder is not None and vectors is None:
                vectors = kept.select("doc_id", models.embed(F.concat(F.lit(self.prefix), F.coalesce("text", F.lit(""))), self.embedder).alias("embedding"), "metadata" if "metadata" in kept.columns else F.lit("{}").alias("metadata"))
        if vectors is not None:
            ids["vectors"] = self._put_vectors(made, vectors).select("doc_id")
        for kind in KINDS:
            parts = [x for x in (ids.get(kind), dead.select("doc_id") if dead is not None and kind in of else None) if x is not None]
            if parts:
                gone = self._put(made, f"dead_{kind}", (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).distinct())
                made["rows"].setdefault(kind, gone.count() if kind not in ids else 0)
        version = self.log.update(lambda now: [*now, made])
        while (run := self._due(self.segments())) is not None:
            version = self.merge(*run)
        return version

    def tier(self, segment: dict) -> int:
        return int(math.log(max(1, sum(segment["rows"].values())), self.fanout) + 1e-9)

    def _due(self, segments: list[dict]) -> tuple[int, int] | None:
        """The newest segments that are of one size or below, if there are `fanout` of them: (first, end)."""
        tiers = [self.tier(x) for x in segments]
        for t in sorted(set(tiers)):
            first = len(tiers)
            while first and tiers[first - 1] <= t:
                first -= 1
            if len(tiers) - first >= self.fanout:
                return first, len(tiers)
        return None

    def merge(self, first: int = 0, end: int | None = None) -> int:
        """One segment in place of the segments first to end: their live rows, and their tombstones as long as older segments stand
        before them. What others added meanwhile stays behind it; if they have merged these, nothing changes."""
        every = self.segments()
        old = every[first:end]
        if not old:
            return self.version()
        made = self._new()
        if (rows := self._live(old, "chunks")) is not None:
            self._put_chunks(made, rows.drop("seg"))
            # what replaced rows add to the frequencies makes some blocks smaller
            held = self._rows(old, "postings")
            often = held.groupBy("term").agg(F.sum("n").alias("df")) if made["rows"]["chunks"] >= postings.BIG else None
            self._put_postings(made, self._reader(old, held).packs(), often)
            self._put(made, "doc_stats", self._live(old, "doc_stats").drop("seg"))
        if (rows := self._live(old, "vectors")) is not None:
            self._put_vectors(made, rows.drop("seg"))
        for kind in KINDS if first else ():
            parts = [self._read(x, f"dead_{kind}") for x in old if f"dead_{kind}" in x["tables"]]
            if parts:
                gone = parts[0]
                for x in parts[1:]:
                    gone = gone.unionByName(x)
                self._put(made, f"dead_{kind}", gone.distinct())
        names = [x["segment"] for x in old]

        def change(now: list[dict]) -> list[dict] | None:
            at = next((k for k, x in enumerate(now) if x["segment"] == names[0]), None)
            if at is None or [x["segment"] for x in now[at : at + len(names)]] != names:
                return None
            return [*now[:at], made, *now[at + len(names) :]]

        version = self.log.update(change)
        if made["segment"] not in {x["segment"] for x in self.segments(version)}:
            remove(self.spark, f"{self.path}/segments/{made['segment']}")
        return version

    def vacuum(self, keep: int = 10, older_s: float = 3600.0) -> None:
        """Delete segments that the newest `keep` versions do not name: replaced ones, and those of writers that died. Folders younger
        than `older_s` stay, since their writer may not have committed yet; readers of a version that goes must have ended."""
        live = {x["segment"] for x in self.log.vacuum(keep, older_s)}
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/segments")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for s in store.listStatus(path) if store.exists(path) else []:
            if s.getPath().getName() not in live and s.getModificationTime() <= (time.time() - older_s) * 1000:
                store.delete(s.getPath(), True)

    # -- searching
    def ranked(self, terms: DataFrame, k: int, k1: float, b: float, delta: float, allowed: DataFrame | None = None, trace: dict | None = None, one_pass: int = lexical.ONE_PASS) -> DataFrame:
        """BM25+ top k from the stored blocks: all postings of the terms in one pass where they are few, else the blocks that matter; trace: gets `taken`, the postings taken out of blocks, and `held`, those of the terms."""
        reader = self.reader(terms, None if allowed is None else allowed.select("doc_id").distinct(), trace is not None)
        n, words, _ = lexical.statistics(self.table("doc_stats")).first()
        out = postings.ranked(terms, reader, n, words, k, k1, b, delta, one_pass=one_pass)
        if trace is not None:
            out = stored(out)
            trace |= {"taken": reader.taken, "held": reader.meta.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]}
        return out

    def near(self, queries: DataFrame, k: int, beam: int = 64, trace: dict | None = None, checked: bool = False, ties: Column | None = None) -> DataFrame:
        """(query_id, doc_id, distance, rank) by the proximity graphs, approximate. A shard brings its `beam` best, so that replaced
        rows among them leave room; checked: the k-th hit is a floor, and all vectors that are no farther are brought, so the hits are
        exact; ties: order of equal distances, else by doc_id; trace: gets `cost`, the distances computed."""
        segments = self.segments()
        rows = self._rows(segments, "graph")
        if rows is None or any("vectors" in x["tables"] and "graph" not in x["tables"] for x in segments):
            raise ValueError("some vectors have no graph; open the store with graphs=True and merge it")
        found = stored(graph.search(rows, queries, max(k, beam), "doc_id", beam))
        if trace is not None:
            trace["cost"] = found.agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0]
        dead = self._dead(segments, "vectors")

        def best(found: DataFrame) -> DataFrame:
            if dead is not None:
                found = found.join(lexical.small_ids(dead), "doc_id", "left").where(F.col("dead").isNull() | (F.col("dead") <= F.col("seg")))
            return lexical.top(found.select("query_id", "doc_id", "distance"), k, F.col("distance"), F.col("doc_id") if ties is None else ties)

        if not checked:
            return best(found)
        # as many floors as queries, which are broadcast anyway
        floors = {r["query_id"]: r["distance"] for r in best(found).where(F.col("rank") == k).select("query_id", "distance").collect()}
        return best(graph.within(rows, queries, floors))


class Indexed:
    """What `lexical.ranked` asks of the stored index: no text is read or tokenised."""

    def __init__(self, store: IndexStore, allowed: DataFrame | None = None):
        self.store, self.allowed = store, allowed

    def read(self, terms: DataFrame) -> tuple[int, int, dict[str, int], DataFrame]:
        n, words, _ = lexical.statistics(self.store.table("doc_stats")).first()
        post = stored(self.store.postings_of(terms))
        rows = post if self.allowed is None else post.join(lexical.small(self.allowed.select("doc_id").distinct()), "doc_id", "left_semi")
        return n, words, {r["term"]: r["df"] for r in lexical.frequencies(post).collect()}, rows


class Engine:
    """Ingest, maintain, search, widen, rerank, flatten over one store."""

    def __init__(self, spark: SparkSession, path: str, config: EngineConfig | None = None, evaluator=None, embedder=None, prefixes: tuple[str, str] = ("", ""), tokens=tokenize, graphs: bool = False):
        """prefixes: put before queries and before stored texts when they are embedded; graphs: whether vectors can be searched approximately."""
        self.spark, self.config, self.evaluator, self.embedder, self.prefixes = spark, config or EngineConfig(), evaluator or OverlapEvaluator(), embedder, prefixes
        self.store = IndexStore(spark, path, tokens, embedder, prefixes[1], graphs=graphs)

    def _chunks(self) -> DataFrame | None:
        return self.store.table("chunks") if self.store.has("chunks") else None

    def ingest_files(self, path, chunker) -> int:
        from ..sources.readers import read_files

        return self.upsert(ingest.from_units(read_files(self.spark, path), chunker))

    def ingest_rows_chunked(self, df: DataFrame, id_col: str, text_col: str, chunker) -> int:
        return self.upsert(ingest.from_rows_chunked(ingest.unique_ids(df, id_col), id_col, text_col, chunker))

    def ingest_rows(self, df: DataFrame, id_col: str, text_col: str) -> int:
        rows = ingest.from_rows(ingest.unique_ids(df, id_col), id_col, text_col)
        return self.upsert(rows.select("doc_id", F.col("doc_id").alias("source_id"), F.lit(0).alias("serial_number"), F.lit(1).alias("page_number"), F.lit(0).alias("chunk_index_in_page"), "text", "metadata"))

    def upsert(self, chunks: DataFrame) -> int:
        # texts are shuffled only if an id repeats
        return self.store.write(chunks.dropDuplicates(["doc_id"]) if rows.repeats(chunks, "doc_id") else chunks)

    def insert(self, chunks: DataFrame) -> int:
        """Ids that are stored stay as they are; filters tell which segments to look into."""
        new = chunks.dropDuplicates(["doc_id"])
        if self.store.has("chunks"):
            new = new.join(self.store.by_ids(new.select("doc_id")).select("doc_id"), "doc_id", "left_anti").select(new.columns)
        return self.store.write(new)

    def lookup(self, ids: DataFrame) -> DataFrame:
        """Stored chunks of these ids (doc_id)."""
        return self.store.by_ids(ids)

    def delete_by_ids(self, ids: DataFrame) -> int:
        """From chunks, postings and vectors alike."""
        return self.store.write(dead=ids)

    def delete_by_metadata(self, **equal) -> int:
        return self.store.write(dead=self.where(**equal))

    def where(self, **equal) -> DataFrame:
        """(doc_id) of the chunks whose metadata all equal these values, typed."""
        return self.store.where(**equal).select("doc_id")

    def search(self, queries: DataFrame, k: int | None = None, vector: DataFrame | None = None, where: dict | None = None) -> DataFrame:
        """Hits in long form, from the stored postings; vector: a second list (query_id, doc_id, distance, rank), if there is one. where: metadata, before the search."""
        k, get = k or int(self.config.get("SEARCH", "TOP_K")), lambda x: float(self.config.get("BM25", x))
        terms = lexical.query_terms(queries, tokens=self.store.tokens)
        found = self.store.ranked(terms, k, get("K1"), get("B"), get("DELTA"), self.where(**where) if where else None)
        return hybrid.union(found, vector)

    def search_vectors(self, queries: DataFrame, k: int | None = None, where: dict | None = None, approximate: bool = False, beam: int = 64, checked: bool = False, ties: Column | None = None) -> DataFrame:
        """(query_id, doc_id, distance, rank) of the stored vectors; queries with an `embedding`, or with a text that the engine's embedder takes.
        approximate: by the proximity graphs, with a beam of this width, checked and ties as in `IndexStore.near`; with a filter the search is exact, over the rows that pass."""
        if "embedding" not in queries.columns:
            if self.embedder is None:
                raise ValueError("queries need an embedding, or the engine an embedder")
            queries = queries.select("query_id", models.embed(F.concat(F.lit(self.prefixes[0]), "text"), self.embedder).alias("embedding"))
        if approximate and not where:
            return self.store.near(queries, k or int(self.config.get("SEARCH", "TOP_K")), beam, checked=checked, ties=ties)
        rows = self.store.table("vectors")
        for name, value in (where or {}).items():
            rows = rows.where(lexical.metadata_equals(F.col("metadata"), name, value))
        return vector.search(rows, queries, k or int(self.config.get("SEARCH", "TOP_K")), "doc_id")

    def enhance(self, hits: DataFrame) -> DataFrame:
        return hybrid.enhance(hits, self.store.table("chunks"), int(self.config.get("SEARCH", "CONTEXT_BEFORE")), int(self.config.get("SEARCH", "CONTEXT_AFTER")), fallback=True)

    def rerank(self, hits: DataFrame, queries: DataFrame) -> DataFrame:
        return hybrid.rerank(hits, queries, self.store.table("chunks"), self.evaluator)

    def fuse(self, hits: DataFrame) -> DataFrame:
        return hybrid.fuse(hits, float(self.config.get("FUSION", "ALPHA")))

    def flatten(self, hits: DataFrame) -> DataFrame:
        return hybrid.flatten(hits, self.store.table("chunks"))

    def dump(self, n: int = 20) -> None:
        for name in ("chunks", "postings", "doc_stats"):
            self.store.table(name).show(n)
