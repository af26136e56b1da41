"""Postings in blocks with impact bounds, and a top k that leaves blocks unread.

A block holds about `BLOCK` postings of one term: those of the documents whose hash has the same
last bits. How many bits depends on the term's frequency, so blocks of a document are found from its hash,
whatever the term, and a frequent term is many rows, never one. Beside its postings
a block keeps their largest tf and smallest length, whose saturation no posting in it exceeds
at any average length. Merging segments takes blocks apart and together again; no text is read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.rounding import rounded
from . import rows
from .lexical import BROADCAST_IDS, ONE_PASS, _with_distance, saturation, small, small_ids, top, weighted
from .staging import stored

BLOCK = 32
#: Postings of a term that one task gets; of terms with more, groups of about as many.
BIG = 1 << 16
KEY = ["seg", "term", "part"]


def part_of(doc_id: Column, parts: Column) -> Column:
    """Number of the block that holds this document, of `parts` (a power of two)."""
    return F.xxhash64(doc_id).bitwiseAND(parts - 1)


def packed(post: DataFrame, least: int = 1 << 18) -> DataFrame:
    """(term, doc_id, tf, dl) -> packs: postings of a term that are read together in one row."""
    rows.bounded_batches(post.sparkSession)

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= least:
                yield pack(held)
                held, n = [], 0
        if n:
            yield pack(held)

    def pack(held) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        flat = pc.dictionary_encode(t.column("term").combine_chunks())
        term = flat.indices.to_numpy()
        order = np.argsort(term, kind="stable")
        starts = np.flatnonzero(np.diff(term[order], prepend=-1))
        ends, order = pa.array(np.append(starts, len(term)), pa.int32()), pa.array(order)
        lists = [pa.ListArray.from_arrays(ends, t.column(c).combine_chunks().take(order)) for c in ("doc_id", "hash", "tf", "dl")]
        return pa.record_batch([flat.dictionary.take(pa.array(term[order.to_numpy()][starts])), *lists], names=["term", "docs", "hashes", "tfs", "dls"])

    each = post.select("term", F.col("doc_id").cast("string").alias("doc_id"), F.col("tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl"))
    return each.withColumn("hash", F.xxhash64("doc_id")).mapInArrow(run, rows.PACK)


def repacked(stored_blocks: DataFrame, dead: DataFrame | None) -> DataFrame:
    """Blocks (seg, term, docs, tfs, dls) -> packs of their live postings; dead: (doc_id, dead), few enough to broadcast."""
    rows.bounded_batches(stored_blocks.sparkSession)
    shared = None
    if dead is not None:
        gone = dead.select(F.xxhash64("doc_id").alias("hash"), "doc_id", "dead").toArrow().sort_by("hash").combine_chunks()
        found = gone.column("hash").to_numpy()
        most = int(np.unique(found, return_counts=True)[1].max(initial=0))  # ids of one hash
        shared = stored_blocks.sparkSession.sparkContext.broadcast((found, gone.column("doc_id").combine_chunks(), gone.column("dead").to_numpy(), most)) if most else None

    def live(docs: pa.Array, hashes: np.ndarray, seg: np.ndarray) -> np.ndarray:
        known, ids, since, most = shared.value
        keep, first = np.ones(len(docs), bool), np.searchsorted(known, hashes)
        for k in range(most):
            at = np.minimum(first + k, len(known) - 1)
            hit = np.flatnonzero((known[at] == hashes) & (since[at] > seg))
            same = pc.equal(docs.take(pa.array(hit)), ids.take(pa.array(at[hit]))).to_numpy(zero_copy_only=False).astype(bool)
            keep[hit[same]] = False
        return keep

    def run(batches):
        for t in rows._tables(batches, 1 << 18):
            docs = t.column("docs").combine_chunks()
            sizes, term = np.diff(docs.offsets.to_numpy()), pc.dictionary_encode(t.column("term").combine_chunks())
            one = term.indices.to_numpy()
            flat = [t.column(c).combine_chunks().flatten() for c in ("docs", "hashes", "tfs", "dls")]
            of = np.repeat(np.arange(len(one)), sizes)
            if shared is not None:
                keep = live(flat[0], flat[1].to_numpy(), t.column("seg").to_numpy()[of])
                of, flat = of[keep], [x.filter(pa.array(keep)) for x in flat]
            of = one[of]
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            if len(starts):
                ends = pa.array(np.append(starts, len(of)), pa.int32())
                yield pa.record_batch([term.dictionary.take(pa.array(of[starts])), *[pa.ListArray.from_arrays(ends, x) for x in flat]], names=["term", "docs", "hashes", "tfs", "dls"])

    return stored_blocks.select("term", "docs", F.transform("docs", lambda d: F.xxhash64(d)).alias("hashes"), "tfs", "dls", "seg").mapInArrow(run, rows.PACK)


def blocks(post: DataFrame, often: DataFrame, bucket: Callable[[Column], Column]) -> DataFrame:
    """(term, doc_id, tf, dl) -> blocks, as `blocks_of` packs."""
    return blocks_of(packed(post), often, bucket)


def blocks_of(packs: DataFrame, often: DataFrame | None, bucket: Callable[[Column], Column], big: int = BIG) -> DataFrame:
    """Packs -> (term, parts, part, n, max_tf, min_dl, docs, tfs, dls, bucket), sorted in each task; postings are shuffled once.

    A term's postings meet in one task, which counts them and cuts them to blocks. Those of terms that `often` (term, df) gives `big`
    postings or more, which may be a bound, are dealt to tasks in groups by the documents' hashes, about `big` to a group."""
    # at most one term for `big` postings
    many = {} if often is None else {r["term"]: 1 << int(math.log2(r["df"] / BLOCK)) for r in often.where(F.col("df") >= big).select("term", "df").collect()}
    groups = {t: max(1, parts * BLOCK // big) for t, parts in many.items()}
    fields = {"term": pa.string(), "parts": pa.int64(), "part": pa.int64(), "n": pa.int32(), "max_tf": pa.int32(), "min_dl": pa.int32(), "docs": pa.list_(pa.string()), "tfs": pa.list_(pa.int32()), "dls": pa.list_(pa.int32()), "bucket": pa.int32()}
    schema = pa.schema(list(fields.items()))
    LISTS = ["docs", "hashes", "tfs", "dls"]  # noqa: N806

    def split(batches):
        """Packs of frequent terms by group; parts: 0 if the task that gets them is to count."""
        names, known, by = pa.array(list(groups), pa.string()), np.array([*many.values(), 0]), np.array([*groups.values(), 1])
        for b in batches:
            at = pc.index_in(b.column(0), value_set=names).fill_null(len(names)).to_numpy(zero_copy_only=False)
            sizes = np.diff(b.column(1).offsets.to_numpy())
            pack = np.repeat(np.arange(b.num_rows), sizes)
            group = b.column(2).flatten().to_numpy() & (np.repeat(by[at], sizes) - 1)
            order = np.lexsort((group, pack)) if group.any() else None
            flat = [c.flatten() for c in b.columns[1:]]
            if order is not None:
                pack, group, flat = pack[order], group[order], [x.take(pa.array(order)) for x in flat]
            starts = np.flatnonzero((np.diff(pack, prepend=-1) != 0) | (np.diff(group, prepend=-1) != 0))
            ends = pa.array(np.append(starts, len(pack)), pa.int32())
            yield pa.record_batch([b.column(0).take(pa.array(pack[starts])), pa.array(known[at[pack[starts]]], pa.int64()), pa.array(group[starts], pa.int64()), *[pa.ListArray.from_arrays(ends, x) for x in flat]], names=["term", "parts", "grp", *LISTS])

    def made(t: pa.Table) -> pa.RecordBatch:
        """Blocks of whole groups, whose packs are next to each other."""
        docs = t.column("docs").combine_chunks()
        sizes, run = np.diff(docs.offsets.to_numpy()), np.cumsum(_starts(t)) - 1
        first = np.flatnonzero(_starts(t))
        run_of, parts = np.repeat(run, sizes), t.column("parts").to_numpy()[first]
        count = np.bincount(run_of, minlength=len(first))
        counted = np.left_shift(1, np.floor(np.log2(np.maximum(count, BLOCK) / BLOCK)).astype(np.int64))
        parts = np.where(parts > 0, parts, counted)
        part = t.column("hashes").combine_chunks().flatten().to_numpy() & (parts[run_of] - 1)
        named = pc.dictionary_encode(docs.flatten())
        place = np.empty(len(named.dictionary), np.int64)
        place[pc.array_sort_indices(named.dictionary).to_numpy()] = np.arange(len(place))
        order = np.lexsort((place[named.indices.to_numpy()], part, run_of))
        run_of, part = run_of[order], part[order]
        starts = np.flatnonzero((np.diff(run_of, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
        ends, taken = np.append(starts, len(order)), pa.array(order)
        tf, dl = (t.column(c).combine_chunks().flatten().to_numpy()[order] for c in ("tfs", "dls"))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (docs.flatten().take(taken), pa.array(tf), pa.array(dl))]
        head = {c: t.column(c).combine_chunks().take(pa.array(first[run_of[starts]])) for c in ("term", "bucket")}
        facts = [np.diff(ends).astype(np.int32), np.maximum.reduceat(tf, starts), np.minimum.reduceat(dl, starts)]
        return pa.RecordBatch.from_arrays([head["term"], pa.array(parts[run_of[starts]]), pa.array(part[starts]), *map(pa.array, facts), *lists, head["bucket"]], schema=schema)

    def cut(batches, least: int = 1 << 17):
        """The last group of what is held may go on in the next batch."""
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b.column(3).flatten())
            if n < least:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            last = int(np.flatnonzero(_starts(t))[-1])
            if last:
                yield made(t.slice(0, last).combine_chunks())
            held = t.slice(last).combine_chunks().to_batches()
            n = sum(len(b.column(3).flatten()) for b in held)
        if n:
            yield made(pa.Table.from_batches(held).combine_chunks())

    every = "term string, parts long, grp long, docs array<string>, hashes array<long>, tfs array<int>, dls array<int>"
    one = (packs.mapInArrow(split, every) if groups else packs.select("term", F.lit(0).cast("long").alias("parts"), F.lit(0).cast("long").alias("grp"), *LISTS)).withColumn("bucket", bucket(F.col("term")))
    dealt = one.withColumn("place", F.pmod(F.xxhash64("term", "grp"), F.lit(4096))).repartition("bucket", "place")
    ddl = "term string, parts long, part long, n int, max_tf int, min_dl int, docs array<string>, tfs array<int>, dls array<int>, bucket int"
    return dealt.sortWithinPartitions("bucket", "term", "grp").drop("place").mapInArrow(cut, ddl).sortWithinPartitions("bucket", "term", "part")


def _starts(t: pa.Table) -> np.ndarray:
    """Whether a pack is of another term or group than the one before it."""
    term, group = pc.dictionary_encode(t.column("term").combine_chunks()).indices.to_numpy(), t.column("grp").to_numpy()
    return (np.diff(term, prepend=-1) != 0) | (np.diff(group, prepend=-1) != 0)


def decoded(rows: DataFrame, *keep: str) -> DataFrame:
    """Blocks -> (keep..., term, doc_id, tf, dl)."""
    return rows.select(*keep, "term", F.explode(F.arrays_zip("docs", "tfs", "dls")).alias("p")).select(*keep, "term", F.col("p.docs").alias("doc_id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))


class Reader:
    """The blocks of a query's terms in all segments of a store, and how many postings were taken out of them.

    rows: (seg, term, parts, part, n, max_tf, min_dl, docs, tfs, dls); dead: (doc_id, dead) or None: the document's rows of
    segments before `dead` are replaced; allowed: (doc_id) or None."""

    def __init__(self, rows: DataFrame, dead: DataFrame | None, allowed: DataFrame | None, count: bool = False):
        self.rows, self.dead, self.allowed, self.count, self.taken = rows, dead, allowed, count, 0

    @cached_property
    def meta(self) -> DataFrame:
        """The blocks without their postings, written once."""
        return stored(self.rows.select("seg", "term", "parts", "part", "n", "max_tf", "min_dl"))

    def everything(self) -> DataFrame:
        """All live postings (seg, term, doc_id, tf, dl)."""
        post = self._live(decoded(self.rows, "seg"))
        return post.join(small(self.allowed), "doc_id", "left_semi") if self.allowed is not None else post

    def packs(self) -> DataFrame:
        """All live postings as packs; taken out of packs only where too many documents are replaced to broadcast them."""
        if self.dead is not None and self.dead.limit(BROADCAST_IDS + 1).count() > BROADCAST_IDS:
            return packed(self.everything())
        return repacked(self.rows, self.dead)

    def _live(self, post: DataFrame) -> DataFrame:
        if self.dead is not None:
            post = post.join(small_ids(self.dead), "doc_id", "left").where(F.col("dead").isNull() | (F.col("dead") <= F.col("seg"))).drop("dead")
        return post

    def postings(self, wanted: DataFrame, filtered: bool = True) -> DataFrame:
        """Live postings (seg, term, doc_id, tf, dl) of the blocks `wanted` (seg, term, part)."""
        wanted = wanted.distinct()
        if self.count:
            self.taken += self.meta.join(wanted, KEY, "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        post = self._live(decoded(self.rows.join(small(wanted), KEY, "left_semi"), "seg"))
        return post.join(small(self.allowed), "doc_id", "left_semi") if filtered and self.allowed is not None else post

    def terms(self) -> tuple[list, dict[str, int]]:
        """((seg, term, parts, largest tf, smallest length) of each, live document frequency by term)."""
        facts = self.meta.groupBy("seg", "term", "parts").agg(F.sum("n").alias("n"), F.max("max_tf").alias("tf"), F.min("min_dl").alias("dl")).collect()
        df: dict[str, int] = {}
        for r in facts:
            df[r["term"]] = df.get(r["term"], 0) + r["n"]
        if self.dead is not None:
            # only blocks that hold a replaced document are looked into
            sizes = self.meta.select("parts").distinct()
            hit = self.dead.crossJoin(F.broadcast(sizes)).select("parts", part_of(F.col("doc_id"), F.col("parts")).alias("part")).distinct()
            gone = decoded(self.rows.join(small(hit), ["parts", "part"], "left_semi"), "seg").join(small_ids(self.dead), "doc_id").where(F.col("dead") > F.col("seg"))
            for r in gone.groupBy("term").agg(F.count("*").alias("n")).collect():
                df[r["term"]] -= r["n"]
        return facts, {t: n for t, n in df.items() if n}


def ranked(terms: DataFrame, reader: Reader, n: int, words: int, k: int, k1: float, b: float, delta: float, seeds: int = 2, one_pass: int = ONE_PASS) -> DataFrame:
    """The exact top k of (query_id, term, qn), a small table, over n documents of `words` words. Up to `one_pass` postings
    are scored at once.

    Beyond, the rarest terms of a query are read whole and name seeds, whose k-th best full score is a floor. Documents without
    these terms have the rest alone: terms that together cannot reach the floor name none of them, and blocks of the others
    are read only if their bound, with the rest's, reaches it. Of the documents named, those are scored in full whose
    blocks' bounds still reach the floor, from the blocks that hold them and no others.
    """
    spark, slack, avg = terms.sparkSession, 1e-5, words / n if n and words else 1.0
    asked = terms.select("query_id", "term", "qn").collect()
    facts, df = reader.terms()
    bound = lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg)) + delta
    most: dict[str, float] = {}
    for r in facts:
        most[r["term"]] = max(most.get(r["term"], 0.0), bound(r["tf"], r["dl"]))
    by_query = weighted(asked, n, df)
    schema = StructType([terms.schema["query_id"], StructField("term", StringType()), StructField("w", DoubleType())])
    frame = lambda rows: F.broadcast(spark.createDataFrame(rows, schema))  # noqa: E731  as small as the queries
    places = F.broadcast(spark.createDataFrame([(r["seg"], r["term"], r["parts"]) for r in facts], StructType([StructField("seg", IntegerType()), StructField("term", StringType()), StructField("parts", LongType())])))
    every = [(q, t, w) for q, ts in by_query.items() for w, t in ts]
    meta, avgdl = reader.meta, F.lit(float(avg))
    impact = F.col("w") * saturation(avgdl, k1, b, delta)
    block_impact = F.col("w") * (F.col("max_tf") * (k1 + 1) / (F.col("max_tf") + k1 * (1 - b + b * F.col("min_dl") / avgdl)) + delta)

    def whole(weights: list[tuple]) -> DataFrame:
        return meta.join(frame(sorted({(None, t, 0.0) for _, t, _ in weights})).select("term"), "term", "left_semi").select(KEY)

    def partial(post: DataFrame, weights: list[tuple]) -> DataFrame:
        return post.repartition("doc_id").join(frame(weights), "term").groupBy("query_id", "seg", "doc_id").agg(F.sum(impact).alias("score"))

    def pieces(found: DataFrame, weights: list[tuple]) -> DataFrame:
        """(query_id, seg, doc_id, term, w, part) of the blocks that can hold these documents' terms."""
        return found.select("query_id", "seg", "doc_id").join(frame(weights), "query_id").join(places, ["seg", "term"]).select("query_id", "seg", "doc_id", "term", "w", part_of(F.col("doc_id"), F.col("parts")).alias("part"))

    def scored(found: DataFrame) -> DataFrame:
        """Full scores of (query_id, seg, doc_id)."""
        need = pieces(found, every)
        post = reader.postings(need.select(KEY))
        return need.join(post, ["seg", "term", "doc_id"]).groupBy("query_id", "doc_id").agg(F.sum(impact).alias("score"))

    if sum(df[t] for _, t, _ in every) <= one_pass:
        return _with_distance(partial(reader.postings(whole(every)), every).groupBy("query_id", "doc_id").agg(rounded(F.sum("score")).alias("score")), k)
    first = []
    for q, ts in by_query.items():
        held = 0
        for w, t in ts:
            first.append((q, t, w))
            held += df[t]
            if held >= seeds * k:
                break
    # documents with one of the first terms are all known from here on; the others have the rest of the terms alone
    known = stored(partial(reader.postings(whole(first)), first))
    seed = stored(top(known, seeds * k, F.desc("score"), F.col("doc_id")).select("query_id", "seg", "doc_id"))
    kth = top(scored(seed), k, F.desc("score"), F.col("doc_id")).where(F.col("rank") == k)
    floor = {r["query_id"]: r["score"] - slack for r in kth.select("query_id", "score").collect()}
    firsts = {(q, t) for q, t, _ in first}
    rest = [x for x in every if x[:2] not in firsts]
    naming, needs, leasts = [], [], []
    for q, ts in by_query.items():
        ts = [(w, t) for w, t in ts if (q, t) not in firsts]
        light, cut, least, all_most = 0.0, len(ts), floor.get(q, 0.0), sum(w * most[t] for w, t in ts)
        while cut and light + ts[cut - 1][0] * most[ts[cut - 1][1]] < least:
            cut -= 1
            light += ts[cut][0] * most[ts[cut][1]]
        naming += [(q, t, w) for w, t in ts[:cut]]
        needs += [(q, t, least - (all_most - w * most[t])) for w, t in ts[:cut]]
        leasts.append((q, "", least))
    least = frame(leasts).select("query_id", F.col("w").alias("least"))

    def able(found: DataFrame, others: list[tuple]) -> DataFrame:
        """Those that reach the floor with what the blocks of their other terms can add at most."""
        if others:
            extra = pieces(found, others).join(meta.select(*KEY, "max_tf", "min_dl"), KEY).groupBy("query_id", "seg", "doc_id").agg(F.sum(block_impact).alias("extra"))
            found = found.join(extra, ["query_id", "seg", "doc_id"], "left").withColumn("score", F.col("score") + F.coalesce("extra", F.lit(0.0)))
        return found.join(least, "query_id").where(F.col("score") >= F.col("least")).select("query_id", "seg", "doc_id")

    found = able(known, rest)
    if naming:
        wanted = meta.join(frame(naming), "term").join(frame(needs).withColumnRenamed("w", "need"), ["query_id", "term"]).where(block_impact >= F.col("need")).select(KEY)
        named = stored(partial(reader.postings(wanted), naming).join(known.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti"))
        chosen = {x[:2] for x in naming}
        found = found.unionByName(able(named, [x for x in rest if x[:2] not in chosen]))
    found = stored(found)
    return _with_distance(scored(found).withColumn("score", rounded(F.col("score"))), k)
