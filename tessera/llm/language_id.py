"""Language ID by word-first backoff.

A word that the model knows scores its per-language log frequency; an unseen word
falls back to its character 5-grams, then 4-, 3-, 2- and 1-grams, whichever length
is the first of which the model knows any. A text's score is the sum over its words.

The model is a classifier whose counts are those of all labelled rows and their whole texts; of
more than `most_langs` labels those with most rows are learned. It keeps at most `most_words` words and
`most_grams` n-grams, the most frequent and those alone that the rows hold `least` times: its size,
and what is broadcast, is bounded by those parameters. Every row is then predicted over its whole text.
A caller may give `sample` to learn from about that many rows only (chosen by a hash of the id): languages with few
rows are then learned whole, the others share the rest evenly. No query does.

`und` with score 0 for a null text, a text without a letter, or an untrained model.
Null ids count as not held out, and are not learned from. Ties go to the language
that is first in the alphabet. Other columns are ignored,
or carried unchanged where asked for.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow_schema, batch, held_out, relieve, sampled, table, tune

WORD = re.compile(r"[^\W\d_]+")
COUNTS = "lang string, kind int, gram string, n long"
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} " if n > 1 else word
    return [padded[k : k + n] for k in range(len(padded) - n + 1)]


def shares(totals: dict[str, int], sample: int) -> dict[str, float]:
    """Share of each language's rows to learn from: evenly many of each, and what small languages leave goes to the others."""
    out, left = {}, sample
    for k, lang in enumerate(sorted(totals, key=lambda x: (totals[x], x))):
        take = min(totals[lang], max(1, left // (len(totals) - k)))
        out[lang], left = take / totals[lang], left - take
    return out


def cut_words(words: list[str], owners: np.ndarray, counts: np.ndarray, longest: int):
    """For n = 1 .. longest: (n, owner, n-gram, sum of its words' counts) of all n-grams that occur, as arrays.

    A rank stands for an owner and the n characters from a place on; with the next character it gives that of n + 1."""
    codes = np.frombuffer("".join([f" {w} " for w in words]).encode("utf-32-le"), "<u4")
    alphabet, letters = np.unique(codes, return_inverse=True)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word, left = np.repeat(np.arange(len(words)), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    at, rank = np.arange(len(codes)), owners[word]
    for n in range(1, longest + 1):
        fits = left[at] >= n
        at = at[fits]
        _, first, rank = np.unique(rank[fits] * len(alphabet) + letters[at + n - 1], return_index=True, return_inverse=True)
        total, start = np.bincount(rank, weights=counts[word[at]], minlength=len(first)).astype(np.int64), at[first]
        if n == 1:  # a single character is never the padding
            real = codes[start] != 32
            total, start = total[real], start[real]
        yield n, owners[word[start]], np.ascontiguousarray(codes[start[:, None] + np.arange(n)]).view(f"<U{n}").ravel(), total


def most_frequent(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """The `most` rows of largest `all`, ties by the order; only the last count's ties are sorted."""
    last, room = None, most
    for r in rows.groupBy("all").count().orderBy(F.desc("all")).toLocalIterator():
        last = r["all"]
        if r["count"] >= room:
            break
        room -= r["count"]
    else:
        return rows
    return rows.where(F.col("all") > last).union(rows.where(F.col("all") == last).orderBy(*order).limit(room))


def learn(docs: DataFrame, sample: int | None = None, most_words: int = 150_000, most_grams: int = 60_000, longest: int = 5, least: int = 3, most_langs: int = 1_000) -> dict:
    """Model from the rows' text and lang: {'langs', 'prior', 'words': (words, counts by language), 'grams': the same of n-grams}; prior counts all labelled rows."""
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null and doc_id is not null")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    parts = shares(totals, sample or sum(totals.values()))
    limits = docs.sparkSession.createDataFrame(list(parts.items()), "lang string, share double")
    picked = rows.join(F.broadcast(limits), "lang")
    if sample:
        picked = sampled(picked, "doc_id", F.col("share"), 7)
    schema = arrow_schema(COUNTS)

    def count(batches):
        """Words by language, added up until there are many."""
        found: dict[str, Counter] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
            n_docs = Counter(b.column(1).to_pylist())
            yield batch(schema, list(n_docs), [6] * len(n_docs), [""] * len(n_docs), list(n_docs.values()))
            if sum(map(len, found.values())) > 300_000:
                yield from rows_of(found)
                found.clear()
        yield from rows_of(found)
        relieve()

    def rows_of(found):
        for lang, c in found.items():
            yield batch(schema, pa.repeat(lang, len(c)), pa.repeat(pa.scalar(0, pa.int32()), len(c)), list(c), list(c.values()))

    def cut(batches):
        """n-grams of the words, many at a time."""
        def flush():
            t = pa.Table.from_batches(held)
            owners = pc.index_in(t.column(0), pa.array(langs, pa.string())).to_numpy()
            for n, owner, gram, total in cut_words(t.column(1).to_pylist(), owners.astype(np.int64), t.column(2).to_numpy(), longest):
                yield batch(schema, pa.array(langs, pa.string()).take(pa.array(owner)), pa.repeat(pa.scalar(n, pa.int32()), len(gram)), gram.tolist(), total)

        held, size = [], 0
        for b in batches:
            held, size = [*held, b], size + b.nbytes
            if size > 2 << 20:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()
        relieve()

    def add(rows: DataFrame) -> DataFrame:
        return rows.groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))

    tune(docs.sparkSession)
    words = table(add(picked.select("text", "lang").mapInArrow(count, COUNTS)))
    langs = sorted(r["lang"] for r in words.where("kind = 6").select("lang").collect())
    tasks = 1 + words.count() // 100_000
    grams = add(words.where("kind = 0").select("lang", "gram", "n").repartition(tasks).mapInArrow(cut, COUNTS))
    by = F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")
    each = table(words.where("kind = 0").unionByName(grams).groupBy("kind", "gram").agg(F.sum("n").alias("all"), by).where(F.col("all") >= least))

    def side(rows: DataFrame) -> tuple[list[str], np.ndarray]:
        t = rows.select("gram", F.map_keys("by").alias("langs"), F.map_values("by").alias("ns")).toArrow().combine_chunks()
        counts = np.zeros((t.num_rows, len(langs)), np.int64)
        if t.num_rows:
            names = t.column("langs").chunk(0)
            at = np.repeat(np.arange(t.num_rows), np.diff(names.offsets.to_numpy()))
            counts[at, pc.index_in(names.flatten(), pa.array(langs, pa.string())).to_numpy()] = t.column("ns").chunk(0).flatten().to_numpy()
        return t.column("gram").to_pylist(), counts

    known = side(most_frequent(each.where("kind = 0"), most_words, "gram"))
    return {"langs": langs, "prior": [totals[x] for x in langs], "words": known, "grams": side(most_frequent(each.where("kind > 0"), most_grams, "kind", "gram")), "longest": longest}


class Scorer(dict):
    """word -> row of `table`, the log frequencies by language; unseen words back off once and are kept."""

    def __init__(self, model: dict, most: int = 100_000):
        words, counts = model["words"]
        super().__init__(zip(words, range(len(words))))
        self.model, self.most, self.langs, self.known = model, most, model["langs"], len(words)
        self.parts = dict(zip(model["grams"][0], map(tuple, self._logs(model["grams"][1]).tolist())))
        self.table = np.concatenate([self._logs(counts), np.zeros((1024, len(self.langs)))])
        p = np.array(model["prior"], float)
        self.prior = np.log((p + 1) / (p.sum() + len(p))) if len(p) else p

    def _logs(self, counts: np.ndarray) -> np.ndarray:
        return np.log((counts + 0.5) / (counts.sum(0) + 0.5 * len(counts))) if len(counts) else np.zeros((0, len(self.langs)))

    def row(self, word: str) -> np.ndarray:
        for n in range(self.model["longest"], 0, -1):
            found = [p for g in grams(word, n) if (p := self.parts.get(g))]
            if found:
                return np.array([sum(x) / len(found) for x in zip(*found)])
        return np.zeros(len(self.langs))

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(1024, n // 4), len(self.langs)))])
        self.table[n] = self.row(word)
        self[word] = n
        return n

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text else []
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        if len(self) > self.known + self.most:
            for w in list(islice(self, self.known, None)):
                del self[w]
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))  # may grow the table
        s = self.prior + self.table[rows].sum(0)
        p = np.exp(s - s.max())
        return self.langs[int(s.argmax())], float(p.max() / p.sum())


def predict(docs: DataFrame, model: dict, mod: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) and the columns to carry for every row, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    result = arrow_schema(RESULT)

    def run(batches):
        words = Scorer(shared.value)
        for b in batches:
            langs, scores = zip(*map(words.predict, b.column(2).to_pylist())) if b.num_rows else ((), ())
            extra = [b.schema.get_field_index(c) for c in carry]
            schema = pa.schema([*result, *(b.schema.field(k) for k in extra)])
            yield batch(schema, b.column(0), b.column(1), langs, scores, *(b.column(k) for k in extra))
        del words
        relieve()

    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id"), mod, 0).alias("held_out"), "text", *(c for c in carry if c != "text"))
    out = StructType([*StructType.fromDDL(RESULT), *(docs.schema[c] for c in carry)])
    return rows.mapInArrow(run, out)


def identify(docs: DataFrame, mod: int = 5, carry: tuple[str, ...] = (), **limits) -> DataFrame:
    """Learn from the rows that are not held out, predict all."""
    return predict(docs, learn(docs.where(~held_out(F.col("doc_id"), mod, 0)), **limits), mod, carry)
