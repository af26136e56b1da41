"""The context text format: build, parse, and follow citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIVIDER = "--- Optimized Queries ---"
CATEGORIES = [f"category_{k}" for k in range(1, 6)]
FIELDS = ["notes_link", *CATEGORIES]


def build(hits: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """One context_string per group: a block per hit by backend and rank; ranks restart at 0 in each backend. A group holds top-k hits."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    extra = [F.when(F.coalesce(F.col(c), F.lit("")) != "", line(c, F.col(c))) for c in FIELDS if c in hits.columns]
    block = F.concat_ws("\n", line("RAG Rank", (F.col("rank") - 1).cast("string")), line("doc_id", F.col("doc_id").cast("string")),
                        line("semantic distance", F.col("distance").cast("string")), *extra, line("Text", F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("backend", "rank", block.alias("block"))))
    return hits.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n").alias("context_string"))


def append_queries(context: Column, queries: Column) -> Column:
    """queries: array of strings."""
    return F.concat(context, F.lit(f"\n\n{DIVIDER}\n"), F.array_join(queries, "\n"))


def sanitize_queries(queries: Column, most: int = 3) -> Column:
    """Trimmed, non-empty, distinct in first-seen order, at most `most`."""
    return F.slice(F.array_distinct(F.filter(F.transform(queries, lambda x: F.trim(x)), lambda x: x != "")), 1, most)


def parse(df: DataFrame, column: str = "context_string") -> DataFrame:
    """One row per block: the other columns, rag_rank, doc_id, semantic_distance, notes_link, category_1..5, text. Bad numbers are 0."""
    text = F.regexp_replace(F.substring_index(F.col(column), DIVIDER, 1), r"\r\n?", "\n")
    blocks = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*RAG Rank:\s*\d[\s\S]*?(?=^[ \t]*RAG Rank:\s*\d|\z)"), F.lit(0))
    rest = [c for c in df.columns if c != column]
    cut = df.select(*rest, F.posexplode(blocks).alias("block_no", "block"))
    parts = F.split("block", r"(?m)^[ \t]*Text:", 2)
    cut = cut.select(*rest, "block_no", parts[0].alias("head"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("body"))
    value = lambda name: F.trim(F.regexp_extract("head", rf"(?m)^[ \t]*{name}:([^\n]*)", 1))
    return cut.select(*rest, "block_no", F.coalesce(value("RAG Rank").try_cast("int"), F.lit(0)).alias("rag_rank"), value("doc_id").alias("doc_id"),
                      F.coalesce(value("semantic distance").try_cast("double"), F.lit(0.0)).alias("semantic_distance"),
                      *[value(c).alias(c) for c in FIELDS], F.regexp_replace("body", r"(?U)^\s+|\s+$", "").alias("text"))


def cited_ranks(answer: Column) -> Column:
    """Distinct ranks in first-seen order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[\[RAG_RANK=(\d+)\]\]"), F.lit(1)), lambda x: x.cast("int")))


def cited_rows(rows: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Parsed rows that an answer cites, with their place in the citation order; a rank may name a row of either backend."""
    cites = answers.select(key, F.posexplode(cited_ranks(F.col("answer"))).alias("cite_no", "rag_rank"))
    return rows.join(cites, [key, "rag_rank"])


def source_title(df: DataFrame) -> Column:
    """Categories joined by ' / ' if the first is set, else the doc_id."""
    cats = [F.nullif(F.col(c), F.lit("")) for c in CATEGORIES if c in df.columns]
    return F.when(F.coalesce(F.col("category_1"), F.lit("")) != "", F.concat_ws(" / ", *cats)).otherwise(F.col("doc_id"))
