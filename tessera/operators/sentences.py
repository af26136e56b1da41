"""Sentence ends that know abbreviations, learned from the corpus without labels.

A word that nearly always stands before a period is an abbreviation; one that does so now and then ends sentences. Each
word's counts before a period and elsewhere give the likelihood ratio of the two, scaled down for long words
and for each time it stands without its period, up for periods inside it. One grouped count over all texts; no
text is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunk import natural
from ..functions.text import ascii_lower
from .lexical import is_small

WORD = r"[\p{L}]+(?:\.[\p{L}]+)*\.?"
#: How surely an abbreviation keeps its period; the score from which a word is one; abbreviations that a split looks up at most.
SURE, SCORE, MOST = 0.99, 0.3, 50_000


def words_and_periods(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n_period, n_plain): how often each word, ASCII lower-cased, stands right before a period, and elsewhere."""
    token = docs.select(F.explode(F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(WORD), F.lit(0))).alias("token"))
    before = F.col("token").endswith(".").cast("long")
    return token.groupBy(F.rtrim(F.col("token"), F.lit(".")).alias("word")).agg(F.sum(before).alias("n_period"), F.sum(1 - before).alias("n_plain"))


def scored(counts: DataFrame) -> DataFrame:
    """Adds `score` to the words that stand before a period at all. p: the share of all words that do."""
    p = F.broadcast(counts.agg((F.sum("n_period") / F.sum(F.col("n_period") + F.col("n_plain"))).alias("p")))  # one row
    letters = F.char_length(F.replace("word", F.lit("."), F.lit("")))
    inner = F.char_length("word") - letters
    ratio = 2 * (F.col("n_period") * F.log(SURE / F.col("p")) + F.col("n_plain") * F.log((1 - SURE) / (1 - F.col("p"))))
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, -F.col("n_plain"))
    # where every word stands before a period, none is told from the others
    return counts.where("n_period > 0").crossJoin(p).withColumn("score", F.when(F.col("p") < 1, F.round(score, 4)).otherwise(0.0)).drop("p")


def abbreviations(docs: DataFrame, text_col: str = "text", least: float = SCORE) -> DataFrame:
    """(word, n_period, n_plain, score) of the abbreviations in a corpus."""
    return scored(words_and_periods(docs, text_col)).where(F.col("score") >= least)


def split(text: Column, found: DataFrame) -> Column:
    """As `chunk.natural`, but no sentence ends at the period of an abbreviation, of a single letter, or between digits. found:
    `abbreviations`, a small table. What `natural` cuts is joined again, so nothing is lost: the parts make up the text."""
    if not is_small(found, MOST):
        raise ValueError(f"more than {MOST} abbreviations")
    known = [r["word"] for r in found.select("word").collect()]
    last = lambda s: F.regexp_extract(ascii_lower(s), r"([\p{L}]+(?:\.[\p{L}]+)*)\.$", 1)

    def add(acc, s):
        cur = acc["cur"]
        word = last(cur)
        held = word.isin(known) if known else F.lit(False)
        joins = (cur != "") & (held | (F.char_length(word) == 1) | (cur.rlike(r"\d\.$") & s.rlike(r"^\d")) | (cur.rlike(r"[\p{L}]\.$") & s.rlike(r"^[\p{L}]")))
        ends = (cur != "") & ~joins
        return F.struct(F.when(ends, F.array_append(acc["out"], cur)).otherwise(acc["out"]).alias("out"), F.when(ends, s).otherwise(F.concat(cur, s)).alias("cur"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))
    return F.aggregate(natural(text), start, add, lambda a: F.when(a["cur"] != "", F.array_append(a["out"], a["cur"])).otherwise(a["out"]))
