"""Approximate cosine search on a stored proximity graph per shard of vectors.

Vectors are dealt into shards of bounded size by a hash of their id. A shard is one row: its ids,
unit vectors, and levels of a navigable graph. Every vector is on the lowest level, one in
`thin` of each level's on the next. A node's links are its nearest nodes, without those that a nearer link
already leads to, and the links back. A search goes down the levels greedily and ends with a beam of
`beam` nodes on the lowest; the shards' hits are merged. All queries of a block advance together
in matrix steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector import asked_blocks, found_rows, kind_of

SHARD = 16_384
STORED = "shard long, n int, size int, ids binary, vectors binary, levels array<binary>, starts array<int>"


def nearest(x: np.ndarray, m: int, rows: int = 512) -> np.ndarray:
    """The m nearest others of each unit vector, nearest first; one block of products at a time."""
    m = min(m, len(x) - 1)
    out = np.empty((len(x), m), np.int32)
    for a in range(0, len(x), rows):
        s = x[a : a + rows] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        near = np.argpartition(-s, m - 1, axis=1)[:, :m]
        out[a : a + rows] = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
    return out


def links(x: np.ndarray, m: int) -> np.ndarray:
    """Neighbours of each node, -1 where there are fewer than 2 m: up to m that no nearer link of the node is nearer to than the node itself, and links back."""
    n = len(x)
    out = np.full((n, 2 * m), -1, np.int32)
    if n < 2:
        return out
    near = nearest(x, 4 * m)
    taken = np.zeros(near.shape, bool)
    own = np.einsum("nd,ncd->nc", x, x[near]) if near.size * x.shape[1] < 1 << 24 else np.stack([np.einsum("nd,nd->n", x, x[near[:, c]]) for c in range(near.shape[1])], 1)
    for c in range(near.shape[1]):
        free = taken.sum(1) < m
        for p in range(c):
            both = np.flatnonzero(taken[:, p] & free)
            if len(both):
                free[both] = np.einsum("nd,nd->n", x[near[both, p]], x[near[both, c]]) <= own[both, c]
        taken[:, c] = free
    # the nearest fill what variety has left free
    taken |= (np.cumsum(~taken, 1) <= (m - taken.sum(1))[:, None]) & ~taken
    a, c = np.nonzero(taken)
    b = near[a, c]
    rank = np.cumsum(taken, 1)[a, c]
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((np.concatenate([rank, rank + m]), src))  # own links first, then links back, near ones first
    src, dst = src[order], dst[order]
    pair = src.astype(np.int64) * n + dst
    _, first = np.unique(pair, return_index=True)
    first.sort()
    src, dst = src[first], dst[first]
    place = np.arange(len(src)) - np.searchsorted(src, src)
    fits = place < 2 * m
    out[src[fits], place[fits]] = dst[fits]
    return out


class Graph:
    def __init__(self, x: np.ndarray, levels: list[np.ndarray], starts: list[np.ndarray]):
        """x: unit vectors; levels: links by node, lowest first; starts: the nodes of each level, in the numbers of the one below."""
        self.x, self.levels, self.starts = x, levels, starts

    @classmethod
    def build(cls, x: np.ndarray, m: int = 16, thin: int = 16, seed: int = 1) -> Graph:
        rng, levels, starts, rows = np.random.default_rng(seed), [], [], x
        while True:
            levels.append(links(rows, m))
            if len(rows) <= 2 * thin:
                return cls(x, levels, starts)
            starts.append(np.sort(rng.choice(len(rows), len(rows) // thin, replace=False)).astype(np.int32))
            rows = rows[starts[-1]]

    def search(self, q: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(nodes, cosines) of the best k of each query, -1 where there are fewer, and the number of distances computed."""
        nodes = [np.arange(len(self.x))]
        for s in self.starts:
            nodes.append(nodes[-1][s])
        top = len(self.levels) - 1
        cost = len(q) * len(nodes[top])
        s = q @ self.x[nodes[top]].T
        width = min(beam if top == 0 else 4, s.shape[1])
        entry = np.argpartition(-s, width - 1, axis=1)[:, :width]
        for level in range(top, -1, -1):
            entry, score, n = self._beam(q, level, nodes[level], entry, beam if level == 0 else 4)
            cost += n
            if level:
                entry = np.where(entry >= 0, self.starts[level - 1][entry], -1)
        order = np.argsort(-score, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(entry, order, 1), np.take_along_axis(score, order, 1), cost

    def _beam(self, q, level: int, nodes: np.ndarray, entry: np.ndarray, beam: int):
        """The `beam` best nodes that greedy steps from `entry` reach, with their cosines; -1 and -inf fill up."""
        link, n, cost = self.levels[level], len(nodes), 0
        width = min(beam, n)
        best, score, done = np.full((len(q), width), -1), np.full((len(q), width), -np.inf), np.ones((len(q), width), bool)
        seen = np.zeros((len(q), n), bool)
        fresh, rows = entry, np.arange(len(q))
        while len(rows):
            new = fresh >= 0
            r, c = np.nonzero(new)
            # a node may be named twice in a row: the first time counts
            pair = rows[r].astype(np.int64) * n + fresh[r, c]
            _, first = np.unique(pair, return_index=True)
            r, c = r[first], c[first]
            open_ = ~seen[rows[r], fresh[r, c]]
            r, c = r[open_], c[open_]
            seen[rows[r], fresh[r, c]] = True
            cost += len(r)
            got = np.full(fresh.shape, -np.inf)
            got[r, c] = np.einsum("nd,nd->n", q[rows[r]], self.x[nodes[fresh[r, c]]])
            both = np.concatenate([score[rows], got], 1)
            keep = np.argpartition(-both, width - 1, axis=1)[:, :width]
            score[rows] = np.take_along_axis(both, keep, 1)
            best[rows] = np.take_along_axis(np.concatenate([best[rows], fresh], 1), keep, 1)
            done[rows] = np.take_along_axis(np.concatenate([done[rows], np.isinf(got)], 1), keep, 1)
            # the best node that has not been opened yet, of each query that has one
            ahead = np.where(done | np.isinf(score), -np.inf, score)
            rows = np.flatnonzero(~np.isinf(ahead).all(1))
            at = ahead[rows].argmax(1)
            done[rows, at] = True
            fresh = link[best[rows, at]]
        return np.where(np.isinf(score), -1, best), score, cost


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def build(vectors: DataFrame, id_col: str, n: int, shard: int = SHARD, m: int = 16) -> DataFrame:
    """Graph rows of (id_col, embedding), n rows. Null and zero vectors are in no graph, as no exact search finds them."""
    shards = max(1, -(-n // shard))
    schema = pa.schema([("shard", pa.int64()), ("n", pa.int32()), ("size", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("levels", pa.list_(pa.binary())), ("starts", pa.list_(pa.int32()))])

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("id")
        x = t.column("embedding").combine_chunks()
        x = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)
        live = np.linalg.norm(x, axis=1) > 0
        x = x[live].astype(np.float32)
        ids = "\n".join(np.array(t.column("id").to_pylist(), dtype=object)[live].tolist()).encode()
        g = Graph.build(_unit(x), m) if len(x) else Graph(x, [], [])
        flat = [*[len(s) for s in g.starts], *np.concatenate(g.starts).tolist()] if g.starts else []
        return pa.table([[t.column("shard")[0].as_py()], [len(x)], [x.shape[1]], [ids], [x.tobytes()], [[v.tobytes() for v in g.levels]], [flat]], schema=schema)

    rows = vectors.where(F.col("embedding").isNotNull()).select(F.pmod(F.xxhash64(id_col), F.lit(shards)).alias("shard"), F.col(id_col).cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return rows.groupBy("shard").applyInArrow(run, STORED)


def _load(row: dict, m: int) -> tuple[np.ndarray, np.ndarray, Graph]:
    """(ids, vectors as they came, graph)."""
    x = np.frombuffer(row["vectors"], np.float32).reshape(row["n"], -1)
    levels = [np.frombuffer(v, np.int32).reshape(-1, 2 * m) for v in row["levels"]]
    many, starts, at = len(levels) - 1, [], max(0, len(levels) - 1)
    for k in range(many):
        starts.append(np.array(row["starts"][at : at + row["starts"][k]], np.int32))
        at += row["starts"][k]
    return np.array(row["ids"].decode().split("\n"), dtype=object), x, Graph(_unit(x.astype(float)), levels, starts)


def search(graphs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", beam: int = 64, m: int = 16, keep: str = "seg") -> DataFrame:
    """(query_id, keep, id_col, distance, cost) of the k best of each query and shard, unmerged; cost: distances that the query
    block took in the shard, spread over its rows. graphs: rows of `build` with a column `keep` that is passed on."""
    out, kind = None, kind_of(queries.schema["query_id"])
    for ids, q in asked_blocks(queries):
        shared = graphs.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches, shared=shared):
            ids, q = shared.value
            for b in batches:
                for row in b.to_pylist():
                    if not row["n"] or not len(q):
                        continue
                    names, x, g = _load(row, m)
                    for a in range(0, len(q), 256):
                        node, _, cost = g.search(q[a : a + 256].astype(np.float32), k, max(beam, k))
                        r, c = np.nonzero(node >= 0)
                        v = x[node[r, c]].astype(float)  # the exact distance of what was found
                        distance = np.round(1 - np.einsum("nd,nd->n", q[a + r], v) / np.linalg.norm(v, axis=1), 6) + 0.0
                        yield found_rows(kind, ids[a : a + 256][r], "string", names[node[r, c]], distance, id_col, {keep: [row[keep]] * len(r), "cost": np.full(len(r), cost / max(1, len(r)))})

        part = graphs.mapInArrow(run, f"query_id {kind}, {id_col} string, distance double, {keep} int, cost double")
        out = part if out is None else out.unionByName(part)
    return out


def within(graphs: DataFrame, queries: DataFrame, floors: dict, id_col: str = "doc_id", m: int = 16, keep: str = "seg") -> DataFrame:
    """(query_id, keep, id_col, distance) of all vectors no farther than the query's floor; a query without a floor finds every vector.
    One matrix product per shard and 256 queries names them, as single-precision products are right to 1e-5; distances are exact."""
    out, kind = None, kind_of(queries.schema["query_id"])
    for ids, q in asked_blocks(queries):
        shared = graphs.sparkSession.sparkContext.broadcast((ids, q, np.array([floors.get(i, np.inf) for i in ids], float)))

        def run(batches, shared=shared):
            ids, q, floor = shared.value
            for b in batches:
                for row in b.to_pylist():
                    if not row["n"] or not len(q):
                        continue
                    names, x, g = _load(row, m)
                    for a in range(0, len(q), 256):
                        r, c = np.nonzero(q[a : a + 256].astype(np.float32) @ g.x.T >= (1 - floor[a : a + 256] - 1e-5)[:, None])
                        v = x[c].astype(float)
                        distance = np.round(1 - np.einsum("nd,nd->n", q[a + r], v) / np.linalg.norm(v, axis=1), 6) + 0.0
                        near = distance <= floor[a + r]
                        r, c = r[near], c[near]
                        yield found_rows(kind, ids[a : a + 256][r], "string", names[c], distance[near], id_col, {keep: [row[keep]] * len(r)})

        part = graphs.mapInArrow(run, f"query_id {kind}, {id_col} string, distance double, {keep} int")
        out = part if out is None else out.unionByName(part)
    return out
