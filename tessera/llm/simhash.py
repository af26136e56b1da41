"""SimHash near-dedup: byte-position inverted index with count filtering.

A fingerprint is eight positional bytes. Two fingerprints at `distance` 4 or fewer
bits differ in at most four bytes, so at least four positions match: the guaranteed
minimum. Any four of eight positions hold one of 20 fixed triples (a Turan system),
so the index keeps one posting per triple of positional bytes. Each posting list is
tallied in numpy blocks: shared bytes per pair, pairs under the minimum go, the
rest are verified by popcount; a list gives out a spanning forest, never its pairs.
Lists above `block` members are cut into blocks and every two blocks meet once, so
no list is held by one task and no link is lost.

Only distinct fingerprints are indexed: copies, empty texts and ties cost nothing.
Null text is empty (fingerprint zero). Rows with a null doc_id link like any other, but
never name a component; one of such rows alone has a null name. Repeated ids are fine:
fingerprints are the nodes, so rows of one id and different texts are not taken for one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch, relieve, table, tune

PRINTS = "doc_id long, fp long"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, width: int = 4) -> int:
    """Unsigned 64-bit SimHash of one text."""
    import xxhash

    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-1].tolist()]
    ends = (ends - 1).tolist()
    f = xxhash.xxh64_intdigest
    if len(words) < width:
        h = np.array([f(joined, 42)], dtype=np.uint64)
    else:
        h = np.fromiter((f(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :])), np.uint64, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(ones * 2 > len(h)).tolist()))


def fingerprints(docs: DataFrame, width: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp as signed long) and the columns to carry for every row."""
    schema = pa.schema([*arrow_schema(PRINTS), *((c, pa.int64()) for c in carry)])

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t or b"", width) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield batch(schema, b.column(0), fps.view(np.int64), *b.columns[2:])
        relieve()

    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), *(F.col(c).cast("long") for c in carry))
    return rows.mapInArrow(run, ", ".join([PRINTS, *(f"{c} long" for c in carry)]))


def triples() -> list[tuple[int, int, int]]:
    """20 triples of positions; any four of the eight positions hold at least one."""
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    out = []
    for t in combinations(range(8), 3):
        n = [sum(group[p] == g for p in t) for g in range(3)]
        if 3 in n or any(n[g] == 2 and n[(g + 1) % 3] == 1 for g in range(3)):
            out.append(t)
    return out


def forest(fps: np.ndarray, reps: np.ndarray, distance: int, least: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Edges (rep, smaller rep) that span the links among these fingerprints."""
    n = len(fps)
    label = np.arange(n)
    rows, cols = [], []
    octets = fps.astype("<u8").view(np.uint8).reshape(-1, 8)
    for a in range(0, n, block):
        for b in range(0, a + 1, block):
            tally = np.zeros((len(fps[a : a + block]), len(fps[b : b + block])), np.uint8)
            for p in range(8):
                tally += octets[a : a + block, p][:, None] == octets[b : b + block, p][None, :]
            i, j = np.nonzero(tally >= least)
            i, j = i + a, j + b
            near = (i > j) & (np.bitwise_count(fps[i] ^ fps[j]) <= distance)
            rows.append(i[near])
            cols.append(j[near])
    i, j = np.concatenate(rows), np.concatenate(cols)
    while len(i):  # smallest label wins; labels only fall
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    best = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(best, label, reps)
    root = best[label]
    moved = root != reps
    return reps[moved], root[moved]


def links(nodes: DataFrame, distance: int = 4, block: int = 256) -> DataFrame:
    """Edges (a, b), a > b, that span the graph of links; nodes: (fp), one row per fingerprint."""
    least = 8 - distance
    octet = lambda p: f"(shiftright(fp, {8 * p}) & 255)"
    keys = [f"{k}L * 16777216L + {octet(a)} * 65536L + {octet(b)} * 256L + {octet(c)}" for k, (a, b, c) in enumerate(triples())]
    postings = nodes.select("fp", F.explode(F.array(*map(F.expr, keys))).alias("key"))
    sizes = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    lists = (postings.join(sizes, "key")
             .withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
             .groupBy("key", "blocks", "block").agg(F.collect_list("fp").alias("members")))
    # every two blocks of a list meet in one row; a list of one block meets itself
    meets = (lists.select("key", "block", "members", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other"))
             .groupBy("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.flatten(F.collect_list("members")).alias("members"))
             .select("members"))
    schema = arrow_schema("a long, b long")

    def run(batches):
        for b in batches:
            got = [forest(x.view(np.uint64), x, distance, least) for x in (np.array(m.values) for m in b.column(0)) if len(x) > 1]
            if got:
                yield batch(schema, *map(np.concatenate, zip(*got)))
        relieve()

    return meets.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with a smaller one: alternating large and small stars until nothing moves.

    Both sides of each join are written tables: a star's centre may be a neighbour of many, and plain
    exchanges are what adaptive execution splits where one key holds too many rows."""
    e, seen = table(edges.select("a", "b")), None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = tuple(state)
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = table(both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        least = table(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = table(small.union(least.select("a", F.col("m").alias("b"))).distinct())


def best_of_component(prints: DataFrame, place, distance: int) -> DataFrame:
    """(fp, best) for every fingerprint: the smallest `place` among the rows of its component."""
    nodes = table(prints.groupBy("fp").agg(F.min(place).alias("own")))
    found = table(components(links(nodes.select("fp"), distance)))
    rooted = table(nodes.join(found, nodes.fp == found.node, "left").select("fp", F.coalesce("component", "fp").alias("root"), "own"))
    best = table(rooted.groupBy("root").agg(F.min("own").alias("best")))
    return table(rooted.join(best, "root").select("fp", "best"))


def near_groups(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    prints = table(fingerprints(docs, width))
    named = best_of_component(prints, F.col("doc_id"), distance)
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best").alias("component_id"))


def surplus(rows: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """(uid) of all rows of a numbered table but one of each component: that with the smallest doc_id stays, null
    counting as larger than all, of several the first in the table. Rows are told apart by uid, not by doc_id."""
    prints = table(fingerprints(rows, width, ("uid",)))
    named = best_of_component(prints, F.struct(F.col("doc_id").isNull(), "doc_id", "uid"), distance)
    return prints.join(named, "fp").where(F.col("uid") != F.col("best.uid")).select("uid")
