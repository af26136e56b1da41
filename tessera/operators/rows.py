"""Ranking where documents lie: a document's tokens are one row, so what a query makes of it is summed in the task
that reads it. Nothing is shuffled but k rows a query and task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells of a matrix of queries by documents that is held at once.
CELLS = 1 << 21


def bounded_batches(spark: SparkSession) -> None:
    """Batches bounded in rows and in bytes, so that long texts fit a JVM and a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def repeats(docs: DataFrame, id_col: str) -> bool:
    """Whether an id has several rows; only ids are shuffled."""
    return bool(docs.groupBy(F.col(id_col)).agg(F.count("*").alias("n")).where("n > 1").select("n").take(1))


def held(column: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, number of the term, times) of the terms that each row's tokens hold, by row and term, and the tokens of each row."""
    sizes = np.diff(column.offsets.to_numpy())
    ids = pc.index_in(column.flatten(), value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(ids >= 0)
    key, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes)[at] * max(1, len(terms)) + ids[at], return_counts=True)
    return key // max(1, len(terms)), key % max(1, len(terms)), tf, sizes


def counted(each: DataFrame) -> DataFrame:
    """(doc_id string, tokens) -> (term, doc_id, tf, dl), ids unique: a row's postings arise where it lies."""
    bounded_batches(each.sparkSession)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            column = b.column(1)
            flat = pc.dictionary_encode(column.flatten())
            sizes, n = np.diff(column.offsets.to_numpy()), max(1, len(flat.dictionary))
            key, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
            doc = key // n
            yield pa.record_batch([flat.dictionary.take(pa.array(key % n)), b.column(0).take(pa.array(doc)), pa.array(tf, pa.int64()), pa.array(sizes[doc], pa.int32())], names=["term", "doc_id", "tf", "dl"])

    return each.select("doc_id", "tokens").mapInArrow(run, "term string, doc_id string, tf long, dl int")


def _tables(batches, least: int):
    """Arrow batches put together until their second column's lists hold `least` items."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += len(b.column(1).flatten())
        if n >= least:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _postings(tokens: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, number of the term, row, times) of rows' tokens, by term and row, and the tokens of each row."""
    flat, sizes = pc.dictionary_encode(tokens.flatten()), np.diff(tokens.offsets.to_numpy())
    n = max(1, len(sizes))
    key, tf = np.unique(flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(len(sizes)), sizes), return_counts=True)
    return flat.dictionary, key // n, key % n, tf, sizes


#: Columns of packs: postings of one term that arose together; hashes are those of the documents' ids.
PACK = "term string, docs array<string>, hashes array<long>, tfs array<int>, dls array<int>"


def packs(each: DataFrame, least: int = 1 << 20) -> DataFrame:
    """(doc_id string, tokens), ids unique -> packs of about `least` tokens' documents: a row for each term, not for each posting."""
    bounded_batches(each.sparkSession)

    def run(batches):
        for t in _tables(batches, least):
            ids, hashes = t.column(0).combine_chunks(), t.column(2).to_numpy()
            terms, term, doc, tf, sizes = _postings(t.column(1).combine_chunks())
            starts = np.flatnonzero(np.diff(term, prepend=-1))
            ends = pa.array(np.append(starts, len(term)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in (ids.take(pa.array(doc)), pa.array(hashes[doc]), pa.array(tf, pa.int32()), pa.array(sizes[doc], pa.int32()))]
            yield pa.record_batch([terms.take(pa.array(term[starts])), *lists], names=["term", "docs", "hashes", "tfs", "dls"])

    return each.select("doc_id", "tokens", F.xxhash64("doc_id")).mapInArrow(run, PACK)


def lengths_and_frequent(each: DataFrame, share: float, least: int = 1 << 20) -> DataFrame:
    """(doc_id, dl, null, null) of each document and (null, null, term, n): how many of the documents read together hold a term,
    of terms that are in at least this share of them. A term's sum is short of its frequency by less than that share of all documents."""
    bounded_batches(each.sparkSession)

    def run(batches):
        for t in _tables(batches, least):
            tokens = t.column(1).combine_chunks()
            sizes = np.diff(tokens.offsets.to_numpy())
            none = lambda n, kind: pa.nulls(n, kind)
            yield pa.record_batch([t.column(0).combine_chunks(), pa.array(sizes, pa.int64()), none(len(sizes), pa.string()), none(len(sizes), pa.int64())], names=["doc_id", "dl", "term", "n"])
            if share < 1:
                terms, term, *_ = _postings(tokens)
                n = np.bincount(term, minlength=len(terms))
                often = np.flatnonzero(n >= share * len(sizes))
                yield pa.record_batch([none(len(often), pa.string()), none(len(often), pa.int64()), terms.take(pa.array(often)), pa.array(n[often], pa.int64())], names=["doc_id", "dl", "term", "n"])

    return each.select("doc_id", "tokens").mapInArrow(run, "doc_id string, dl long, term string, n long")


def totals(tokens: DataFrame, terms: list[str]) -> tuple[int, int, np.ndarray]:
    """(rows, tokens of all rows, rows that hold each term) of a column `tokens` without nulls."""
    bounded_batches(tokens.sparkSession)

    def count(batches):
        value_set, n, words, df = pa.array(terms, pa.string()), 0, 0, np.zeros(len(terms), np.int64)
        for b in batches:
            _, term, _, sizes = held(b.column(0), value_set)
            n, words = n + b.num_rows, words + int(sizes.sum())
            df += np.bincount(term, minlength=len(terms))
        seen = np.flatnonzero(df)
        yield pa.record_batch([pa.array([-2, -1, *seen.tolist()], pa.int32()), pa.array([n, words, *df[seen].tolist()], pa.int64())], names=["term", "n"])

    got = {r["term"]: r["n"] for r in tokens.mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return got.get(-2, 0), got.get(-1, 0), np.array([got.get(k, 0) for k in range(len(terms))], np.int64)


def best(docs: DataFrame, terms: list[str], asked: list[list[tuple[int, float]]], k: int, score: Callable) -> DataFrame:
    """(query int, doc_id, score) of the k best of each query in each task; of equal scores the smaller doc_id.

    docs: (doc_id, tokens), ids unique, tokens not null; asked: (number of a term, weight) of each query; score: (weights' sums
    by query and document, document's tokens) from `impact`, made by score(None, tf, dl), to what is ranked, largest first."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    pairs = sorted((t, q, w) for q, ts in enumerate(asked) for t, w in ts)
    of = np.array([p[0] for p in pairs], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((terms, np.searchsorted(of, np.arange(len(terms) + 1)), np.array([p[1] for p in pairs], np.int64), np.array([p[2] for p in pairs], float)))
    n_queries = len(asked)

    def run(batches):
        terms, first, query, weight = shared.value
        value_set, least, kept = pa.array(terms, pa.string()), np.full(n_queries, -np.inf), None
        for b in batches:
            doc, term, tf, sizes = held(b.column(1), value_set)
            names = b.column(0)
            names = np.array(names.to_pylist(), dtype=object) if kind == "string" else names.to_numpy(zero_copy_only=False)
            step = max(1, CELLS // max(1, n_queries))
            for a in range(0, b.num_rows, step):
                lo, hi = np.searchsorted(doc, [a, a + step])
                if lo == hi:
                    continue
                d, t, width = doc[lo:hi] - a, term[lo:hi], min(step, b.num_rows - a)
                # a posting counts for each query that asks for its term
                many = first[t + 1] - first[t]
                place = np.repeat(first[t] - np.cumsum(many) + many, many) + np.arange(many.sum())
                cell = query[place] * width + np.repeat(d, many)
                x = weight[place] * np.repeat(score(None, tf[lo:hi], sizes[a + d]), many)
                there = np.bincount(cell, minlength=n_queries * width).reshape(n_queries, width) > 0
                s = score(np.bincount(cell, x, n_queries * width).reshape(n_queries, width), None, sizes[a : a + width])
                s = np.where(there, s, -np.inf)
                floor = np.maximum(least, np.partition(s, width - k, axis=1)[:, width - k] if width > k else -np.inf)
                r, c = np.nonzero(there & (s >= floor[:, None]))
                if not len(r):
                    continue
                new = (r, s[r, c], names[a + c])
                kept = new if kept is None else tuple(np.concatenate(z) for z in zip(kept, new))
                order = np.lexsort((kept[2], -kept[1], kept[0])) if kind != "string" else _order(kept)
                q = kept[0][order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                order = order[rank < k]
                kept = tuple(z[order] for z in kept)
                last = np.flatnonzero(rank[rank < k] == k - 1)
                least[kept[0][last]] = kept[1][last]
        if kept is not None:
            names = pa.array(kept[2].tolist(), b.schema.field(0).type)
            yield pa.record_batch([pa.array(kept[0], pa.int32()), names, pa.array(kept[1], pa.float64())], names=["query", "doc_id", "score"])

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "tokens").mapInArrow(run, f"query int, doc_id {kind}, score double")


def _order(kept) -> np.ndarray:
    """By query, score and text id; numpy's own order of objects would compare them pair by pair."""
    ids = pc.array_sort_indices(pa.array(kept[2].tolist(), pa.string())).to_numpy()
    place = np.empty(len(ids), np.int64)
    place[ids] = np.arange(len(ids))
    return np.lexsort((place, -kept[1], kept[0]))
