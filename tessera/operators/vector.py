"""Exact cosine search: a block of queries against all rows, one matrix product per Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import top

BLOCK = 1024


def kind_of(field) -> str:
    """Ids stay texts, or are longs."""
    return "string" if field.dataType.simpleString() == "string" else "long"


def asked_blocks(queries: DataFrame, block: int = BLOCK):
    """(ids, unit vectors) of the queries (query_id, embedding), `block` at a time; null and zero vectors ask for nothing. At least one pair."""
    rows, held, none = queries.select(F.col("query_id").cast(kind_of(queries.schema["query_id"])), "embedding").where("embedding is not null"), [], True

    def packed(held: list):
        q = np.array([r[1] for r in held], float).reshape(len(held), -1)
        live = np.linalg.norm(q, axis=1) > 0
        return np.array([r[0] for r in held], dtype=object)[live], q[live] / np.linalg.norm(q[live], axis=1, keepdims=True)

    for r in rows.toLocalIterator():
        held.append(r)
        if len(held) == block:
            yield packed(held)
            held, none = [], False
    if held or none:
        yield packed(held)


def found_rows(query_kind: str, queries, kind: str, ids, distance, id_col: str, more: dict | None = None) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64()}
    columns = {"query_id": pa.array(list(queries), types[query_kind]), id_col: pa.array(list(ids), types[kind]), "distance": pa.array(distance, pa.float64())}
    for name, v in (more or {}).items():
        columns[name] = pa.array(v, pa.int32()) if name != "cost" else pa.array(v, pa.float64())
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", where=None, block: int = BLOCK) -> DataFrame:
    """(query_id, vec_id, distance, rank); queries: (query_id, embedding), ids texts or numbers. where: filter on the rows, before the search.

    Each task keeps k rows per query and batch, so what is shuffled does not depend on the table's
    width. Queries are taken in blocks of bounded size. Zero and null vectors are found by no query.
    """
    rows, out = vectors if where is None else vectors.where(where), None
    for ids, q in asked_blocks(queries, block):
        out = _more(out, _block(rows, ids, q, None, k, id_col, kind_of(queries.schema["query_id"])))
    return top(out, k, F.col("distance"), F.col(id_col))


def _more(out, part):
    return part if out is None else out.unionByName(part)


def _block(rows: DataFrame, ids: np.ndarray, q: np.ndarray, probes: list[set] | None, k: int, id_col: str, query_kind: str) -> DataFrame:
    """Hits of unit queries q; probes: the cells that each looks into."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, q, probes))
    kind = kind_of(rows.schema[id_col])

    def run(batches):
        ids, q, probes = shared.value
        for b in batches:
            if not b.num_rows or not len(ids):
                continue
            of = b.column(0).to_numpy(zero_copy_only=False)
            of = of.astype(str) if kind == "string" else of
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            n = np.linalg.norm(v, axis=1)
            cells = b.column(2).to_numpy(zero_copy_only=False)[n > 0] if probes else np.zeros(int((n > 0).sum()), int)
            of, v = of[n > 0], v[n > 0] / n[n > 0, None]
            asking, near_ids, near_d = [], [], []
            for c in np.unique(cells).tolist():
                asked = np.array([i for i in range(len(ids)) if probes is None or c in probes[i]], int)
                mine = cells == c
                if not len(asked):
                    continue
                d, near = np.round(1 - q[asked] @ v[mine].T, 6) + 0.0, of[mine]
                for i, row in zip(asked.tolist(), d):
                    best = np.lexsort((near, row))[:k] if len(row) <= 4 * k else _first(row, near, k)
                    asking += [ids[i]] * len(best)
                    near_ids += near[best].tolist()
                    near_d += row[best].tolist()
            yield found_rows(query_kind, asking, kind, near_ids, near_d, id_col)

    columns = [F.col(id_col).cast(kind), "embedding", *(["cell"] if probes else [])]
    return rows.where(F.col("embedding").isNotNull()).select(*columns).mapInArrow(run, f"query_id {query_kind}, {id_col} {kind}, distance double")


def _first(row: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    near = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1])  # ties at the edge included
    return near[np.lexsort((of[near], row[near]))][:k]


class Cells:
    """An inverted-file index: each vector lies in the cell of its nearest centre, a query looks into its `probes` nearest cells.

    Centres are fitted by k-means on at most `sample` rows (a documented bound); every row is indexed.
    """

    def __init__(self, vectors: DataFrame, n: int = 32, sample: int = 10_000, rounds: int = 8, seed: int = 1):
        rows = vectors.where("embedding is not null").select("embedding")
        share = min(1.0, sample / max(1, rows.count()))
        x = np.array([r[0] for r in rows.where(F.pmod(F.xxhash64("embedding"), F.lit(1 << 50)) < share * float(1 << 50)).limit(2 * sample).collect()], float)
        x = x[np.linalg.norm(x, axis=1) > 0] if len(x) else x
        x = x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else np.zeros((1, 1))
        self.centres = x[np.random.default_rng(seed).permutation(len(x))[:n]]
        for _ in range(rounds):
            of = (x @ self.centres.T).argmax(axis=1)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, of, x)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            self.centres = np.where(size > 0, sums / np.maximum(size, 1e-12), self.centres)

    def assigned(self, vectors: DataFrame) -> DataFrame:
        """vectors with their `cell`; null and zero vectors are in cell 0. Write it partitioned by cell, and a search reads only its cells."""
        shared = vectors.sparkSession.sparkContext.broadcast(self.centres)

        def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                there = s.notna().to_numpy()
                cell = np.zeros(len(s), np.int32)
                if there.any():
                    cell[there] = (np.stack(s[there].to_list()).astype(float) @ shared.value.T).argmax(axis=1)
                yield pd.Series(cell)

        return vectors.withColumn("cell", F.pandas_udf(nearest, "int")("embedding"))

    def search(self, rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", probes: int = 8) -> DataFrame:
        """As the exact `search`, over the probed cells of `assigned` rows."""
        out = None
        for ids, q in asked_blocks(queries):
            near = [set(x) for x in np.argsort(-(q @ self.centres.T), axis=1)[:, :probes].tolist()]
            out = _more(out, _block(rows.where(F.col("cell").isin(sorted(set().union(*near)))), ids, q, near, k, id_col, kind_of(queries.schema["query_id"])))
        return top(out, k, F.col("distance"), F.col(id_col))


def recall(found: DataFrame, exact: DataFrame, id_col: str = "vec_id") -> float:
    """Share of the exact hits that were found."""
    return found.join(exact.select("query_id", id_col), ["query_id", id_col], "left_semi").count() / max(1, exact.count())
