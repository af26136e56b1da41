"""Byte-level BPE encoding and decoding with length-bucketed padded numpy matrices.

Texts are cut in front of every space that follows a non-space: no match of the split
pattern crosses such a cut. Units are encoded once and kept (a bounded cache that
lives as long as the Python worker). New units are split by the pattern; the distinct
pieces go, by length, into padded matrices of token ids: each round every row merges
its leftmost pair of smallest rank, found by a hashed pair table, and is compacted.
A piece above `LONG` bytes is laid over as many rows of a matrix of its own, and merges one pair a round in all of them.

Null text is empty: no ids. An empty table gives an empty result; other columns are
ignored, repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch, relieve, tune

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
NONE = np.int64(1 << 40)
LONG, ROWS = 256, 8192
CUT, ODD_SPACE = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s ")


class PairTable:
    """Open-addressing hash table: (left id, right id) -> id of the merged token; its rank is its id."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(len(left) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.vals = np.full(1 << self.bits, NONE, np.int64)
        key, val = (left.astype(np.int64) << 32) | right, merged.astype(np.int64)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = key[free]  # of several for one slot, the last stays
            mine = free & (self.keys[slot] == key)
            self.vals[slot[mine]] = val[mine]
            key, val, slot = key[~mine], val[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where there is no such pair or an id is negative (padding)."""
        key = (left << 32) | right
        out = np.full(key.shape, NONE, np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = key.ravel()
        slot, flat = self._slot(key[todo]), out.ravel()
        while len(todo):
            there = self.keys[slot]
            hit = there == key[todo]
            flat[todo[hit]] = self.vals[slot[hit]]
            on = ~hit & (there != -1)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(out.shape)


    def one(self, left: int, right: int) -> int:
        """`get` for one pair of ids."""
        key = left << 32 | right
        slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 64 - self.bits
        while (there := int(self.keys[slot])) != key:
            if there == -1:
                return int(NONE)
            slot = slot + 1 & (1 << self.bits) - 1
        return int(self.vals[slot])


class ByteBPE:
    def __init__(self, ranks_file: str, pattern: str):
        import regex

        with open(ranks_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        # white space and classes as the Unicode property names them
        self.find = regex.compile(pattern, flags=regex.V0).findall
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        left, right, merged = [], [], []
        for t, i in self.ranks.items():
            for k in range(1, len(t)):
                a, b = self.ranks.get(t[:k]), self.ranks.get(t[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(i)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int64))

    def merge_rows(self, ids: np.ndarray) -> np.ndarray:
        """Padded matrix (-1: padding) of byte ids to padded matrix of token ids, one merge per row and round."""
        out, live = ids.copy(), np.arange(len(ids))
        pair = self.pairs.get(ids[:, :-1], ids[:, 1:])
        while len(live):
            at = pair.argmin(axis=1)
            rows = np.arange(len(live))
            best = pair[rows, at]
            going = best != NONE
            out[live[~going], : ids.shape[1]] = ids[~going]
            out[live[~going], ids.shape[1] :] = -1
            live, ids, at, best, pair = live[going], ids[going], at[going], best[going], pair[going]
            if not len(live):
                break
            rows = np.arange(len(live))
            ids[rows, at] = best
            width = ids.shape[1]
            shift = np.arange(width - 1)[None, :] > at[:, None]  # drop the right half of each pair
            ids = np.where(shift, ids[:, 1:], ids[:, :-1])
            pair = np.where(shift[:, : width - 2], pair[:, 1:], pair[:, : width - 2]) if width > 2 else np.full((len(live), 1), NONE)
            if width > 2:
                right = np.minimum(at, width - 3)
                fix = at <= width - 3
                pair[rows[fix], right[fix]] = self.pairs.get(ids[rows, right], ids[rows, np.minimum(right + 1, width - 2)])[fix]
                has_left = at > 0
                pair[rows[has_left], at[has_left] - 1] = self.pairs.get(ids[rows, at - 1], ids[rows, np.minimum(at, width - 2)])[has_left]
            else:
                ids = np.concatenate([ids, np.full((len(live), 1), -1)], axis=1)[:, :2]
        return out

    def merge_long(self, piece: bytes, width: int = LONG) -> list[int]:
        """The same merges for one long piece, laid over the rows of one matrix: each round compares the rows' smallest
        pairs, merges the leftmost smallest and compacts its row. The last pair of a row goes on into the next row."""
        flat = self.byte[np.frombuffer(piece, np.uint8)]
        n_rows = -(-len(flat) // width)
        ids, pair = np.full(n_rows * width, -1), np.full(n_rows * width, NONE)
        ids[: len(flat)], pair[: len(flat) - 1] = flat, self.pairs.get(flat[:-1], flat[1:])
        ids, pair = ids.reshape(n_rows, width), pair.reshape(n_rows, width)
        sizes, low = (ids >= 0).sum(axis=1).tolist(), pair.min(axis=1)
        before, after = list(range(-1, n_rows - 1)), [*range(1, n_rows), -1]  # rows that are not empty
        while (best := int(low.min())) != NONE:
            r = int(low.argmin())
            k = int(pair[r].argmin())
            ids[r, k] = best
            at, j = (r, k + 1) if k + 1 < sizes[r] else (after[r], 0)  # the right half goes
            last = sizes[at] - 1
            ids[at, j:last], pair[at, j:last] = ids[at, j + 1 : last + 1].copy(), pair[at, j + 1 : last + 1].copy()
            ids[at, last], pair[at, last], sizes[at] = -1, NONE, last
            if not last and at != r:
                after[r] = after[at]
                if after[at] >= 0:
                    before[after[at]] = r
            p, i = (r, k - 1) if k else (before[r], sizes[before[r]] - 1)
            if p >= 0:
                pair[p, i] = self.pairs.one(int(ids[p, i]), best)
            q, i = (r, k + 1) if k + 1 < sizes[r] else (after[r], 0)
            pair[r, k] = self.pairs.one(best, int(ids[q, i])) if q >= 0 else NONE
            for x in {r, at, max(p, 0)}:
                low[x] = pair[x].min()
        return ids[ids >= 0].tolist()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers."""
        out: list = [None] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(p) > LONG:
                out[k] = np.array(self.merge_long(p), "<u4").tobytes()
            else:
                by_length.setdefault(-(-len(p) // 4) * 4 if len(p) > 8 else len(p), []).append(k)
        for width, ks in by_length.items():
            for a in range(0, len(ks), ROWS):
                part = ks[a : a + ROWS]
                sizes = np.fromiter((len(pieces[k]) for k in part), np.int64, len(part))
                raw = np.frombuffer(b"".join(pieces[k].ljust(width, b"\0") for k in part), np.uint8).reshape(len(part), width)
                ids = np.where(np.arange(width)[None, :] < sizes[:, None], self.byte[raw], -1)
                done = self.merge_rows(ids)
                for k, row, n in zip(part, done.astype("<u4"), (done >= 0).sum(axis=1).tolist()):
                    out[k] = row[:n].tobytes()
        return out


class Encoder:
    """ByteBPE behind a bounded cache of units."""

    def __init__(self, ranks_file: str, pattern: str, most: int = 250_000):
        self.bpe, self.most = ByteBPE(ranks_file, pattern), most
        self.units: dict[str, bytes] = {}
        flat = [self.bpe.tokens.get(i, b"") for i in range(max(self.bpe.tokens) + 1)]
        self.sizes = np.fromiter(map(len, flat), np.int64, len(flat))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(flat), np.uint8)

    def cut(self, text: str) -> list[str]:
        """Units, each but the first with its leading space."""
        if ODD_SPACE.search(text):
            return CUT.split(text)
        parts = text.split(" ")
        return [parts[0], *[" " + p for p in parts[1:]]] if text[:1] != " " else CUT.split(text)

    def learn(self, units: set[str]) -> None:
        if len(self.units) + len(units) > self.most:
            self.units.clear()
        found = [(u, [p.encode() for p in self.bpe.find(u)]) for u in units]
        pieces = list(dict.fromkeys(p for _, ps in found for p in ps))
        ids = dict(zip(pieces, self.bpe.encode_pieces(pieces)))
        for u, ps in found:
            self.units[u] = b"".join(map(ids.__getitem__, ps))

    def encode(self, texts: list[str], group: int = 64) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        out = []
        for k in range(0, len(texts), group):
            cuts = [self.cut(t) for t in texts[k : k + group]]
            new = set().union(*(set(c).difference(self.units) for c in cuts))
            if new:
                if len(self.units) + len(new) > self.most:
                    new = {u for c in cuts for u in c}
                self.learn(new)
            out += [b"".join(map(self.units.__getitem__, c)) for c in cuts]
        return out

    def decode(self, ids: bytes, step: int = 1 << 18) -> bytes:
        """Bytes of these ids, gathered from one flat table."""
        every, out = np.frombuffer(ids, "<u4").astype(np.int64), []
        for k in range(0, len(every), step):
            part = every[k : k + step]
            n = self.sizes[part]
            out.append(self.bytes[np.repeat(self.starts[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes())
        return b"".join(out)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(ranks_file: str, pattern: str) -> Encoder:
    """One per Python worker: Spark reuses workers, so units stay encoded from task to task."""
    if (ranks_file, pattern) not in _ENCODERS:
        _ENCODERS[ranks_file, pattern] = Encoder(ranks_file, pattern)
    return _ENCODERS[ranks_file, pattern]


def encode_ids(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """(doc_id, ids binary) for every row."""
    schema = arrow_schema("doc_id long, ids binary")

    def run(batches):
        bpe = encoder(ranks_file, pattern)
        for b in batches:
            yield batch(schema, b.column(0), bpe.encode([t or "" for t in b.column(1).to_pylist()]))
        relieve()

    tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")


def encode_and_decode(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row."""
    schema, sha = arrow_schema(RESULT), lambda x: hashlib.sha256(x).hexdigest()

    def run(batches):
        bpe = encoder(ranks_file, pattern)
        for b in batches:
            ids = bpe.encode([t or "" for t in b.column(1).to_pylist()])
            yield batch(schema, b.column(0), [len(x) // 4 for x in ids], list(map(sha, ids)), [sha(bpe.decode(x)) for x in ids])
        relieve()

    tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)
