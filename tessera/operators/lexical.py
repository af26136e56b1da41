"""BM25+ over derived tables: postings, document lengths, corpus statistics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..functions.rounding import rounded, rounded_array
from ..functions.text import tokenize
from . import rows
from .staging import stored

#: Queries whose term list is below this many rows are broadcast; more are joined by shuffle.
BROADCAST_TERMS = 200_000


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens=tokenize) -> DataFrame:
    """(term, doc_id, tf)."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens=tokenize) -> DataFrame:
    """(doc_id, dl) in tokens; empty documents count with 0."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.size(tokens(F.col(text_col))), F.lit(0)).cast("long").alias("dl"))


def frequencies(post: DataFrame) -> DataFrame:
    """(term, df)."""
    return post.groupBy("term").agg(F.count("*").alias("df"))


def statistics(dl: DataFrame) -> DataFrame:
    """One row: n, total_words, avgdl (0 for an empty corpus)."""
    return dl.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_words")).withColumn("avgdl", F.when(F.col("n") > 0, F.col("total_words") / F.col("n")).otherwise(0.0))


def idf(n: Column, df: Column) -> Column:
    """Never negative; 0 for a term that no document holds."""
    return F.when(df > 0, F.greatest(F.lit(0.0), F.log((n - df + 0.5) / (df + 0.5) + 1))).otherwise(0.0)


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "text", tokens=tokenize, others: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, term, qn): repeated tokens count."""
    return queries.select(F.col(id_col).alias("query_id"), *others, F.explode(tokens(F.col(text_col))).alias("term")).groupBy("query_id", *others, "term").agg(F.count("*").alias("qn"))


def is_small(df: DataFrame, rows: int = BROADCAST_TERMS) -> bool:
    return len(df.limit(rows + 1).select(F.lit(1)).take(rows + 1)) <= rows


def small(df: DataFrame, rows: int = BROADCAST_TERMS) -> DataFrame:
    """df to broadcast, if a look at its size allows it."""
    return F.broadcast(df) if is_small(df, rows) else df


#: Replaced ids below this many are broadcast, so that postings and texts need no shuffle to leave them out.
BROADCAST_IDS = 2_000_000


def small_ids(ids: DataFrame) -> DataFrame:
    """ids to broadcast, if they are no more than `BROADCAST_IDS`; counted by the executors."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def counted(each: DataFrame) -> DataFrame:
    """(doc_id, tokens) -> (term, doc_id, tf, dl)."""
    return (each.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
            .groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl")))


class Corpus:
    """What ranking asks of documents given as (doc_id, tokens). `allowed` (doc_id) limits what may be found, not what is counted."""

    def __init__(self, each: DataFrame, allowed: DataFrame | None = None):
        self.each, self.allowed = each, allowed

    def read(self, terms: DataFrame) -> tuple[int, int, dict[str, int], DataFrame]:
        """(documents, words, document frequency by term, written postings (term, doc_id, tf, dl) of these terms)."""
        n, words, _ = statistics(self.each.select(F.size("tokens").cast("long").alias("dl"))).first()
        every = self.each.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(F.broadcast(terms.select("term")), "term", "left_semi")
        post = stored(every.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl")))
        return n, words, {r["term"]: r["df"] for r in frequencies(post).collect()}, _within(post, self.allowed)


def _within(post: DataFrame, ids: DataFrame | None) -> DataFrame:
    return post if ids is None else post.join(small(ids.select("doc_id").distinct()), "doc_id", "left_semi")


def search(queries: DataFrame, docs: DataFrame, k: int = 10, id_col: str = "doc_id", k1: float = 1.5, b: float = 0.75, delta: float = 1.0,
           candidates: DataFrame | None = None, text_col: str = "text", tokens=tokenize) -> DataFrame:
    """Top k per query: (query_id, doc_id, score, distance, rank).

    Statistics come from the whole corpus, also when `candidates` (doc_id) limits what may be found. Ties go to the smaller
    doc_id. Texts are tokenised where they lie, once for the statistics and once for the scores, so that no tokens are written or
    shuffled. Where an id has several rows, which count as one document, or terms are many, postings are grouped instead.
    """
    terms = query_terms(queries, text_col="text", tokens=tokens)
    each = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>")).alias("tokens"))
    few = is_small(terms)
    if few and each.schema["doc_id"].dataType.simpleString() in ("string", "bigint", "int") and not rows.repeats(docs, id_col):
        return _in_place(terms, each, each if candidates is None else _within(docs.withColumnRenamed(id_col, "doc_id"), candidates).select("doc_id", F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>")).alias("tokens")), k, k1, b, delta)
    each = stored(each)
    if few:
        return ranked(terms, Corpus(each, candidates), k, k1, b, delta)
    # so many queries that their terms are no small side: every posting meets every query that has its term
    stats = F.broadcast(statistics(each.select(F.size("tokens").cast("long").alias("dl"))))
    post = counted(each.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi") if candidates is not None else each)
    df = each.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = terms.join(df, "term").crossJoin(stats).select("query_id", "term", F.col("avgdl"), (F.col("qn") * idf(F.col("n"), F.col("df"))).alias("w"))
    scored = post.join(weights, "term").groupBy("query_id", "doc_id").agg(rounded(F.sum(F.col("w") * saturation(F.col("avgdl"), k1, b, delta))).alias("score"))
    return _with_distance(scored, k)


def numbered_queries(terms: DataFrame) -> tuple[list[str], DataFrame, list[dict[int, int]]]:
    """Of a small (query_id, term, qn): distinct terms, (query, query_id) to broadcast, and qn by number of the term for each query."""
    names, of, asked = {}, {}, []
    for r in terms.select("query_id", "term", "qn").collect():
        q = of.setdefault(r["query_id"], len(of))
        if q == len(asked):
            asked.append({})
        asked[q][names.setdefault(r["term"], len(names))] = r["qn"]
    schema = StructType([StructField("query", IntegerType()), terms.schema["query_id"]])
    return list(names), F.broadcast(terms.sparkSession.createDataFrame([(n, q) for q, n in of.items()], schema)), asked


def _in_place(terms: DataFrame, each: DataFrame, allowed: DataFrame, k: int, k1: float, b: float, delta: float) -> DataFrame:
    """The exact top k of `allowed` (doc_id, tokens), with the statistics of `each`."""
    names, queries, asked = numbered_queries(terms)
    n, words, df = rows.totals(each.select("tokens"), names)
    avgdl = words / n if n and words else 1.0
    weight = [max(0.0, math.log((n - d + 0.5) / (d + 0.5) + 1)) if d else 0.0 for d in df.tolist()]

    def score(sums, tf, dl):
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)) + delta if sums is None else rounded_array(sums)

    found = rows.best(allowed, names, [[(t, qn * weight[t]) for t, qn in ts.items()] for ts in asked], k, score)
    return _with_distance(found.join(queries, "query").select("query_id", "doc_id", "score"), k)


def saturation(avgdl: Column, k1: float, b: float, delta: float) -> Column:
    return F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl)) + delta


def _with_distance(scored: DataFrame, k: int) -> DataFrame:
    return top(scored, k, F.desc("score"), F.col("doc_id")).withColumn("distance", rounded(1 / (F.col("score") + 1)))


#: Postings to score, over all queries, up to which they are scored in one pass; beyond, floors and bounds leave most of them out. The rows are the same.
ONE_PASS = 50_000_000


def weighted(asked: list, n: int, df: dict[str, int]) -> dict:
    """(weight, term) by query, heaviest first, of the query terms that a document holds."""
    out: dict = {}
    for r in asked:
        if df.get(r["term"]):
            out.setdefault(r["query_id"], []).append((r["qn"] * max(0.0, math.log((n - df[r["term"]] + 0.5) / (df[r["term"]] + 0.5) + 1)), r["term"]))
    for ts in out.values():
        ts.sort(reverse=True)
    return out


def ranked(terms: DataFrame, corpus, k: int, k1: float, b: float, delta: float, seeds: int = 8, one_pass: int = ONE_PASS) -> DataFrame:
    """The exact top k. terms: (query_id, term, qn), a small table; their postings are taken out of the corpus once.

    Where there is much to score, a floor is found first. A term adds at most its weight times k1 + 1 + delta. The rarest
    terms of a query name seeds; the k-th best full score of these is the floor. Terms that together cannot reach it name no
    document: the others' postings do, and of their documents only those are scored in full whose partial score and the
    rest's bound reach it.
    """
    spark, most, slack = terms.sparkSession, k1 + 1 + delta, 1e-5
    asked = terms.select("query_id", "term", "qn").collect()
    schema = StructType([terms.schema["query_id"], StructField("term", StringType()), StructField("w", DoubleType())])
    frame = lambda rows: F.broadcast(spark.createDataFrame(rows, schema))
    n, words, df, post = corpus.read(spark.createDataFrame(sorted({(r["term"],) for r in asked}), "term string"))
    avgdl = F.lit(float(words / n) if n and words else 1.0)
    by_query = weighted(asked, n, df)
    every = [(q, t, w) for q, ts in by_query.items() for w, t in ts]

    def scored(weights: list[tuple], of: DataFrame | None = None) -> DataFrame:
        """(query_id, doc_id, score) by these weights; of: (query_id, doc_id) to score, else all that hold a term."""
        # postings are dealt by document, so that what queries make of them is summed where it arises; a query keeps k rows a task
        both = _within(post, of).repartition("doc_id").join(frame(weights), "term")
        if of is not None:
            both = both.join(small(of.select("query_id", "doc_id")), ["query_id", "doc_id"], "left_semi")
        return both.groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * saturation(avgdl, k1, b, delta)).alias("score"))

    if sum(df[t] for _, t, _ in every) <= one_pass:
        return _with_distance(scored(every).withColumn("score", rounded(F.col("score"))), k)
    first = []
    for q, ts in by_query.items():
        held = 0
        for w, t in ts:
            first.append((q, t, w))
            held += df[t]
            if held >= seeds * k:
                break
    found = stored(top(scored(first), seeds * k, F.desc("score"), F.col("doc_id")).select("query_id", "doc_id"))
    kth = top(scored(every, found), k, F.desc("score"), F.col("doc_id")).where(F.col("rank") == k)
    floor = {r["query_id"]: r["score"] for r in kth.select("query_id", "score").collect()}
    naming, bounds = [], []
    for q, ts in by_query.items():
        rest, cut = 0.0, len(ts)
        while cut and rest + ts[cut - 1][0] * most < floor.get(q, 0.0) - slack:
            cut -= 1
            rest += ts[cut][0] * most
        naming += [(q, t, w) for w, t in ts[:cut]]
        bounds.append((q, "", floor.get(q, 0.0) - rest - slack))
    able = scored(naming).join(frame(bounds).select("query_id", F.col("w").alias("least")), "query_id").where(F.col("score") >= F.col("least"))
    able = stored(able.select("query_id", "doc_id"))
    return _with_distance(scored(every, able).withColumn("score", rounded(F.col("score"))), k)


def top(scored: DataFrame, k: int, *order: Column, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The first k of each group, with rank."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def post_filter(hits: DataFrame, docs: DataFrame, column: str, value: str) -> DataFrame:
    """After top k, so fewer than k may stay; compared as trimmed text."""
    return hits.join(docs.where(F.trim(F.col(column).cast("string")) == value).select("doc_id"), "doc_id", "left_semi")


def insert(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """New snapshot; ids that exist are left as they are, repeated new ids count once."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """New snapshot; given ids are replaced."""
    return old.join(new.select(key), key, "left_anti").unionByName(new.dropDuplicates([key]))


def delete_ids(old: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return old.join(ids.select(key).distinct(), key, "left_anti")


def delete_where(old: DataFrame, **equal) -> DataFrame:
    """Rows whose columns all equal these values go; null equals nothing."""
    gone = F.lit(True)
    for k, v in equal.items():
        gone = gone & F.coalesce(F.col(k) == F.lit(v), F.lit(False))
    return old.where(~gone)


def metadata_equals(metadata: Column, key: str, value) -> Column:
    """Typed comparison with a JSON member: the number 8 is not the text \"8\"."""
    kind = {bool: "BOOLEAN", int: "BIGINT", float: "DOUBLE", str: "STRING"}[type(value)]
    member = F.variant_get(F.try_parse_json(metadata), f"$.{key}", "variant")
    typed = F.try_variant_get(F.try_parse_json(metadata), f"$.{key}", {"BIGINT": "bigint"}.get(kind, kind.lower()))
    return F.coalesce((F.schema_of_variant(member) == kind) & (typed == F.lit(value)), F.lit(False))
