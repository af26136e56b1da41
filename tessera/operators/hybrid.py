"""Two ranked lists per query: union, de-duplication, fusion, reranking, neighbour context, flattening."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import Evaluator
from ..functions.rounding import rounded, rounded_array
from . import rows
from .lexical import is_small, numbered_queries, query_terms, small, top
from .staging import stored


def set_cosine(queries: DataFrame, docs: DataFrame, k: int = 10, tokens=None) -> DataFrame:
    """Top k by the cosine of distinct-token sets: the deterministic stand-in for a dense index. (query_id, doc_id, distance, rank)."""
    from ..functions.text import tokenize

    tokens = tokens or tokenize
    terms = query_terms(queries, tokens=tokens).where("query_id IS NOT NULL")
    if is_small(terms) and docs.schema["doc_id"].dataType.simpleString() in ("string", "bigint", "int") and not rows.repeats(docs, "doc_id"):
        names, asked_by, asked = numbered_queries(terms)
        nq = np.array([[len(ts)] for ts in asked], float).reshape(-1, 1)
        # negative, since the largest is taken; documents without a token are found by no query
        score = lambda sums, tf, nd: np.ones(len(tf)) if sums is None else -rounded_array(1 - sums / np.sqrt(nq * np.maximum(nd, 1)))
        each = docs.select("doc_id", F.coalesce(F.array_distinct(tokens(F.col("text"))), F.array().cast("array<string>")).alias("tokens"))
        found = rows.best(each, names, [[(t, 1.0) for t in ts] for ts in asked], k, score)
        return top(found.join(asked_by, "query").select("query_id", "doc_id", (F.lit(0.0) - F.col("score")).alias("distance")), k, F.col("distance"), F.col("doc_id"))
    q = small(terms.select("query_id", "term"))
    nq = F.broadcast(q.groupBy("query_id").agg(F.count("*").alias("nq")))
    each = docs.select("doc_id", F.array_distinct(tokens(F.col("text"))).alias("terms"))
    post = each.select("doc_id", F.size("terms").alias("nd"), F.explode("terms").alias("term"))
    both = post.join(q, "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("both"), F.first("nd").alias("nd"))
    scored = both.join(nq, "query_id").select("query_id", "doc_id", rounded(1 - F.col("both") / F.sqrt(F.col("nq") * F.col("nd").cast("double"))).alias("distance"))
    return top(scored, k, F.col("distance"), F.col("doc_id"))


def union(lexical: DataFrame | None, vector: DataFrame | None) -> DataFrame:
    """Long form (query_id, backend, doc_id, distance, rank) of the active lists, unmerged."""
    parts = [df.select("query_id", F.lit(name).alias("backend"), "doc_id", "distance", "rank") for name, df in (("bm25", lexical), ("vector", vector)) if df is not None]
    if not parts:
        raise ValueError("no backend is active")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def per_query_k(k: int, n_queries: Column, factor: int = 2) -> Column:
    """How many hits each of n queries brings to a request for k."""
    return F.greatest(F.lit(1), F.floor(F.lit(k * factor) / n_queries).cast("int"))


def dedup_trim(hits: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), order: tuple[str, ...] = ()) -> DataFrame:
    """Smallest distance per document (first by `order` on ties), then the k nearest."""
    first = Window.partitionBy(*by, "doc_id").orderBy("distance", *order)
    once = hits.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "rank")
    return top(once, k, F.col("distance"), F.col("doc_id"), by=by)


def fuse(hits: DataFrame, alpha: float = 0.7) -> DataFrame:
    """Adds `rerank`: alpha * lexical + (1 - alpha) * vector score, one side's own score if the other is missing; each list is ranked anew."""
    hits = stored(hits)  # read twice
    side = lambda name: F.max(F.when(F.col("backend") == name, 1 - F.col("distance")))
    both = hits.groupBy("query_id", "doc_id").agg(side("bm25").alias("b"), side("vector").alias("v"))
    score = F.when(F.col("b").isNull(), F.col("v")).when(F.col("v").isNull(), F.col("b")).otherwise(alpha * F.col("b") + float(1 - Decimal(str(alpha))) * F.col("v"))  # 1 - 0.7 is 0.3, as in SQL
    scored = hits.withColumnRenamed("rank", "old_rank").join(both.select("query_id", "doc_id", rounded(score).alias("rerank")), ["query_id", "doc_id"])
    return top(scored, 1 << 30, F.desc("rerank"), F.col("old_rank"), by=("query_id", "backend")).drop("old_rank")


def rerank(hits: DataFrame, queries: DataFrame, docs: DataFrame, model: Evaluator, text_col: str = "text") -> DataFrame:
    """Scores each hit's text against its query, best first; the old rank breaks ties."""
    if text_col in hits.columns:
        texts = hits
    elif text_col in docs.columns:
        hits = stored(hits)
        texts = docs.select("doc_id", text_col).join(small(hits), "doc_id").select(*hits.columns, text_col)
    else:
        raise ValueError(f"no column {text_col!r} in hits or documents")
    scored = texts.join(small(queries.select("query_id", F.col("text").alias("query"))), "query_id").withColumn("rerank", model.score(F.col("query"), F.col(text_col)))
    return top(scored.withColumnRenamed("rank", "old_rank"), 1 << 30, F.desc("rerank"), F.col("old_rank"), by=("query_id", "backend")).drop("query", "old_rank")


def enhance(hits: DataFrame, chunks: DataFrame, before: int = 1, after: int = 1, fallback: bool = False) -> DataFrame:
    """Adds enhanced_text: texts of serials n-before .. n+after of the same source, in order; missing serials stay gaps.

    Offsets are exploded and equi-joined, so the join never becomes a range join. With fallback, a
    blank context is the hit's own text, and a hit without chunk gets an empty text.
    """
    hits = stored(hits)
    ids = small(hits.select("doc_id").distinct())
    found = stored(chunks.join(ids, "doc_id", "left_semi").select("doc_id", "source_id", "serial_number", F.col("text").alias("__own")))
    around = F.explode(F.sequence(F.col("serial_number") - before, F.col("serial_number") + after))
    wanted = stored(found.select("source_id", around.alias("serial_number")).distinct())
    # of the chunks' texts only neighbours of hits are joined
    texts = chunks.select("source_id", "serial_number", F.col("text").alias("__near")).join(small(wanted), ["source_id", "serial_number"], "left_semi")
    keys = [c for c in hits.columns]
    near = hits.join(found, "doc_id", "left").withColumn("serial_number", F.explode_outer(F.sequence(F.col("serial_number") - before, F.col("serial_number") + after)))
    got = near.join(texts, ["source_id", "serial_number"], "left")
    pieces = F.array_sort(F.collect_list(F.when(F.col("__near").isNotNull(), F.struct("serial_number", "__near"))))  # before + 1 + after at most
    out = got.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda x: x["__near"]), "").alias("enhanced_text"), F.first("__own").alias("__own"))
    if fallback:
        blank = F.regexp_replace("enhanced_text", r"(?U)^\s+|\s+$", "") == ""
        out = out.withColumn("enhanced_text", F.coalesce(F.when(~blank, F.col("enhanced_text")), "__own", F.lit("")))
    return out.drop("__own")


def flatten(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per query and document: sources, text, a distance per backend, metadata, enhanced text and rerank of its first occurrence."""
    place = F.struct(F.when(F.col("backend") == "bm25", 0).otherwise(1), "rank")
    first = lambda c: F.min_by(c, place) if c in hits.columns else F.lit(None).cast("double" if c == "rerank" else "string")
    wide = hits.groupBy("query_id", "doc_id").agg(
        F.array_join(F.array_sort(F.collect_set("backend")), ", ").alias("source"),
        F.max(F.when(F.col("backend") == "bm25", F.col("distance"))).alias("distance_bm25"), F.max(F.when(F.col("backend") == "vector", F.col("distance"))).alias("distance_vector"),
        first("enhanced_text").alias("enhanced_text"), first("rerank").alias("rerank_score"))
    taken, wide = {*wide.columns} - {"doc_id"}, stored(wide)  # its size tells whether texts need a shuffle
    return docs.select(*[F.col(c).alias(f"meta_{c}") if c in taken else F.col(c) for c in docs.columns]).join(small(wide), "doc_id").select(*wide.columns, *[f"meta_{c}" if c in taken else c for c in docs.columns if c != "doc_id"])
