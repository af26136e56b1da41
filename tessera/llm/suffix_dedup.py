"""Substring dedup over bytes by suffix sorting with a difference cover, one bucket at a time.

Suffixes matter up to `width` bytes and never leave their document. Those that start with
the same `width` bytes choose the same smallest 8-byte piece among these bytes, so the hash of
that piece deals them into shards; neighbours of one piece travel as one segment, equal
segments of a slice of text once. Frequent pieces are chosen last (`frequent_pieces`), so no
shard is one phrase's alone.

1. In a shard, suffixes that may recur are put in order blockwise: ranks of a difference-cover
   sample are computed once (by doubling, since a sample position plus the period is one too),
   then one bucket of suffixes at a time is sorted by its first bytes. Long ties are resolved by
   the ranks at the offset at which both suffixes are in the sample: some offset below the
   period always is. So memory is that of one bucket, and a tie costs no scan of its bytes.
2. Neighbours in suffix order that agree in `width` bytes form a class; its owner is the
   smallest document that it starts in. Each slice gets back runs of windows and their owner.
3. A byte goes if a window over it has an owner below its own document. Runs meet in a file
   per chunk in the shared folder, so texts are not shuffled again.

Null text is empty. Null ids are above every id: such a document owns nothing for others, and
loses what others own. Repeated ids count as one owner. Texts below `width` bytes stay whole, very
long ones are cut into slices that overlap. An empty table gives an empty result; other columns
are ignored, bytes need not be valid text.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MB, NO_ID, answers_by_chunk, answers_for, arrow_schema, batch, chunk_bytes, id_array, mix, packed, relieve, text_bytes, unpack_docs

SEGMENTS = "shard long, chunk long, slice int, n int, blob binary"
REPLIES = "chunk long, slice int, shard long, blob binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
PIECE, SLICE, ODD = 8, 4 * MB, np.uint64(0x9E3779B97F4A7C15)


# -- suffix order -----------------------------------------------------------


def difference_cover(period: int) -> np.ndarray:
    """The smallest set of residues, first in order, whose differences are all residues."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            if len({(a - b) % period for a in (0, *rest) for b in (0, *rest)}) == period:
                return np.array([0, *rest])
    raise ValueError("a period is at least 1")


def eight(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a number, in byte order; zeros follow the end."""
    return np.ndarray(len(raw), ">u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,)).astype(np.uint64)


class SuffixOrder:
    """Suffixes of `text` in order of their first `width` bytes; ranks of the sample are made once, buckets sorted as they are asked for."""

    def __init__(self, text: np.ndarray, width: int, period: int = 13):
        if not 8 < period <= 16 or width < period:
            raise ValueError("the period is above 8, at most 16 and at most the width")
        self.width, self.period, self.n = width, period, len(text)
        self.head = np.concatenate([eight(text), np.zeros(period, np.uint64)])
        cover = difference_cover(period)
        inside = np.zeros(period, bool)
        inside[cover] = True
        self.shift = np.array([[next(d for d in range(period) if inside[(r + d) % period] and inside[(q + d) % period]) for q in range(period)] for r in range(period)])
        where = np.flatnonzero(np.resize(inside, self.n))
        self.slot = np.zeros(self.n, np.int32)
        self.slot[where] = np.arange(len(where))
        order = np.lexsort((self.head[where + period - 8], self.head[where]))
        self.rank = np.zeros(len(where), np.int64)
        self.rank[order] = self._classes(where[order])
        depth = period
        while depth < width:
            after = where + depth
            there = after < self.n
            key = self.rank * (len(where) + 1)
            key[there] += self.rank[self.slot[after[there]]] + 1
            self.rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
            depth *= 2

    def _classes(self, at: np.ndarray) -> np.ndarray:
        """Number of each of these sorted suffixes' first `period` bytes."""
        a, b = self.head[at], self.head[at + self.period - 8]
        return np.cumsum(np.concatenate([[0], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(at)])

    def buckets(self, at: np.ndarray, size: int = 1 << 18):
        """For each bucket of the suffixes `at`, in order: (suffixes in order, whether each equals the one before it in `width` bytes)."""
        key = self.head[at]
        sample = np.sort(key[:: max(1, len(at) // (1 << 16))])
        parts = max(1, len(at) // size)
        split = np.unique(sample[np.linspace(0, len(sample) - 1, parts + 1).astype(int)[1:-1]]) if parts > 1 else sample[:0]
        of = np.searchsorted(split, key, side="right")
        for k in range(len(split) + 1):
            own = at[of == k]
            if len(own):
                yield self.sorted(own)

    def sorted(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = at[np.lexsort((self.head[at + self.period - 8], self.head[at]))]
        cls = self._classes(at)
        tied = np.flatnonzero(np.bincount(cls)[cls] > 1)
        if len(tied):
            i, c = at[tied], cls[tied].astype(np.int64) << 32
            residue = i % self.period
            there = [np.flatnonzero(residue == r) for r in range(self.period)]
            place = np.zeros(len(tied), np.int64)  # how many tied suffixes come before each, counted by residue
            for r in range(self.period):
                for q in range(self.period):
                    if len(there[r]) and len(there[q]):
                        d, x, y = self.shift[r, q], there[r], there[q]
                        theirs = np.sort(c[y] | self.rank[self.slot[i[y] + d]])
                        place[x] += np.searchsorted(theirs, c[x] | self.rank[self.slot[i[x] + d]])
            at = at.copy()
            at[tied] = i[np.argsort(place, kind="stable")]
        same = np.zeros(len(at), bool)
        k = np.flatnonzero(cls[1:] == cls[:-1]) + 1
        for d in [*range(0, self.width - 8, 8), self.width - 8]:
            k = k[self.head[at[k] + d] == self.head[at[k - 1] + d]]
        same[k] = True
        return at, same


# -- windows ----------------------------------------------------------------


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def window_hashes(text: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """A hash of the `width` bytes from each start on."""
    head = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
    out = np.zeros(len(start), np.uint64)
    for d in [*range(0, width - 8, 8), width - 8]:
        out *= ODD
        out += head[start + d]
        out ^= out >> np.uint64(29)
    return mix(out)


class Frequent:
    """Which pieces are frequent: a bit table first, exact after."""

    def __init__(self, values: np.ndarray):
        self.values, self.bits = values, np.zeros(1 << 20, bool)
        self.bits[(mix(values) & np.uint64(len(self.bits) - 1)).astype(np.int64)] = True

    def order(self, head: np.ndarray) -> np.ndarray:
        """By what pieces are chosen: hashes, with frequent pieces last."""
        h = mix(head)
        out = h >> np.uint64(1)
        if len(self.values):
            k = np.flatnonzero(self.bits[(h & np.uint64(len(self.bits) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.values, head[k]), len(self.values) - 1)
            out[k[self.values[at] == head[k]]] |= np.uint64(1 << 63)
        return out


def slices(texts: list[bytes], width: int, shards: int, frequent: Frequent):
    """For each slice of a chunk's documents what both ends of the exchange derive: (number, documents' joined bytes, start of
    each segment, its document, its windows, the number of its text; shard and place of each distinct text); None for the rest if it has no window."""
    joined = b"\0".join(texts)
    raw = np.frombuffer(joined, np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    for number, a in enumerate(range(0, max(1, len(raw)), SLICE)):
        part = raw[a : a + SLICE + width - 1]
        if len(part) < width:
            yield number, joined, None
            continue
        low = sliding_min(frequent.order(eight(part)[: len(part) - PIECE + 1]), width - PIECE + 1)
        start, ended = np.arange(a, a + len(low)), np.zeros(len(low) + 1, np.int64)
        here = slice(*np.searchsorted(ends, [a, a + len(low)]))
        np.add.at(ended, ends[here] - a + 1, 1)
        doc = here.start + np.cumsum(ended[:-1])
        inside = start + width <= ends[doc]
        start, doc, low = start[inside], doc[inside], low[inside]
        if not len(start):
            yield number, joined, None
            continue
        first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (start[1:] != start[:-1] + 1)]))  # documents are a byte apart
        size = np.diff(np.append(first, len(start)))
        begin, seg_doc, seg_low = start[first], doc[first], low[first]
        every = [joined[x:y] for x, y in zip(begin.tolist(), (begin + size + width - 1).tolist())]
        lines = list(dict.fromkeys(every))
        of = rep = np.arange(len(every))
        if len(lines) < len(every):
            of = np.fromiter(map(dict(zip(lines, range(len(lines)))).__getitem__, every), np.int64, len(every))
            _, rep = np.unique(of, return_index=True)
        yield number, joined, (begin, seg_doc, size, of, (mix(seg_low[rep]) % np.uint64(shards)).astype(np.int64), lines)


def planes(x: np.ndarray) -> bytes:
    """Numbers by byte planes, which compress better."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def unplaned(raw: bytes, kind: str, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()


def _send(width: int, shards: int, frequent):
    schema = arrow_schema(SEGMENTS)

    def run(batches):
        press, hot = zstandard.ZstdCompressor(level=3), Frequent(frequent.value)
        for b in batches:
            for chunk, blob in zip(b.column("chunk").to_pylist(), b.column("blob").to_pylist()):
                ids, texts = unpack_docs(blob)
                for number, _, got in slices(texts, width, shards, hot):
                    if got is None:
                        continue
                    _, doc, _, of, shard, lines = got
                    low, high = np.full(len(lines), NO_ID), np.full(len(lines), np.iinfo(np.int64).min)
                    np.minimum.at(low, of, ids[doc])
                    np.maximum.at(high, of, ids[doc])
                    size = np.fromiter(map(len, lines), np.int64, len(lines))
                    order = np.argsort(shard, kind="stable")
                    groups = np.split(order, np.flatnonzero(np.diff(shard[order])) + 1)
                    yield batch(schema, shard[[g[0] for g in groups]], [chunk] * len(groups), [number] * len(groups), [len(g) for g in groups],
                                [press.compress(b"".join([planes(np.diff(low[g], prepend=0)), planes(high[g] - low[g]), planes(size[g].astype("<i4")), *map(lines.__getitem__, g.tolist())])) for g in groups])
        relieve()

    return run


# -- shards -----------------------------------------------------------------


def owners(lines: list[bytes], low: np.ndarray, uses: np.ndarray, width: int, period: int = 13) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, first window, windows, owner) of each run of recurring windows of one owner, in order of lines. The lines are
    distinct and no shorter than `width`; low: smallest document of each; uses: whether it has several."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    begin, n = np.cumsum(size) - size, size - width + 1
    line = np.repeat(np.arange(len(lines)), n)
    nth = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
    text = np.frombuffer(b"".join(lines), np.uint8)
    fp = window_hashes(text, begin[line] + nth, width)
    ordered = np.sort(fp)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    twice = twice[np.append(True, twice[1:] != twice[:-1])] if len(twice) else twice
    owner = np.where(uses[line], low[line], NO_ID)
    if len(twice):
        bits = np.zeros(1 << 22, bool)
        bits[(twice & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        k = np.flatnonzero(bits[(fp & np.uint64(len(bits) - 1)).astype(np.int64)])
        k = k[twice[np.minimum(np.searchsorted(twice, fp[k]), len(twice) - 1)] == fp[k]]
        # only lines with such windows are sorted
        live = np.unique(line[k])
        new = np.zeros(len(lines), np.int64)
        new[live] = np.cumsum(size[live]) - size[live]
        order = SuffixOrder(np.frombuffer(b"".join([lines[x] for x in live.tolist()]), np.uint8), width, period)
        at = new[line[k]] + nth[k]
        for suffixes, same in order.buckets(at):
            if same.any():
                w = k[np.searchsorted(at, suffixes)]
                heads = np.flatnonzero(~same)
                many = np.diff(np.append(heads, len(same)))
                least = np.minimum.reduceat(low[line[w]], heads)
                there = np.repeat(many > 1, many)
                owner[w[there]] = np.minimum(owner[w[there]], np.repeat(least, many)[there])
    cut = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (nth[1:] == 0)]))
    length = np.diff(np.append(cut, len(owner)))
    keep = owner[cut] != NO_ID
    cut, length = cut[keep], length[keep]
    return line[cut], nth[cut], length, owner[cut]


def _answer(width: int):
    schema = arrow_schema(REPLIES)

    def run(t: pa.Table) -> pa.Table:
        unpress = zstandard.ZstdDecompressor()
        shard, chunks, parts, counts = t.column("shard")[0].as_py(), t.column("chunk").to_pylist(), t.column("slice").to_pylist(), t.column("n").to_numpy().astype(np.int64)
        index: dict[bytes, int] = {}
        of, low, high = [], [], []
        for n, blob in zip(counts.tolist(), t.column("blob")):
            raw = unpress.decompress(blob.as_py())
            low.append(np.cumsum(unplaned(raw, "<i8", n, 0)))
            high.append(low[-1] + unplaned(raw, "<i8", n, 8 * n))
            ends = 20 * n + np.cumsum(unplaned(raw, "<i4", n, 16 * n).astype(np.int64))
            of += [index.setdefault(raw[a:b], len(index)) for a, b in zip([20 * n, *ends[:-1].tolist()], ends.tolist())]
        of, low, high = np.array(of), np.concatenate(low), np.concatenate(high)
        least, most = np.full(len(index), NO_ID), np.full(len(index), np.iinfo(np.int64).min)
        np.minimum.at(least, of, low)
        np.maximum.at(most, of, high)
        line, first, length, owner = owners(list(index), least, least < most, width)
        # spread over the messages that hold the line, where a document above the owner has it
        runs = np.searchsorted(line, np.arange(len(index) + 1))
        n = np.diff(runs)[of]
        entry = np.repeat(np.arange(len(of)), n)
        k = np.repeat(runs[of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        loses = owner[k] < high[entry]
        entry, k = entry[loses], k[loses]
        message = np.repeat(np.arange(len(counts)), counts)[entry]
        entry = entry - (np.cumsum(counts) - counts)[message]
        press, out = zstandard.ZstdCompressor(level=3), ([], [], [], [])
        cuts = np.searchsorted(message, np.arange(len(counts) + 1))
        for m in np.unique(message).tolist():
            a, b = cuts[m], cuts[m + 1]
            data = np.stack([np.diff(entry[a:b], prepend=0), first[k[a:b]], length[k[a:b]], np.diff(owner[k[a:b]], prepend=0)]).astype("<i8")
            for col, v in zip(out, (chunks[m], parts[m], shard, press.compress(data.tobytes()))):
                col.append(v)
        relieve()
        return pa.Table.from_batches([batch(schema, *out)])

    return run


def removed_runs(ids: np.ndarray, got, answers: list[tuple[int, bytes]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the bytes that go, in a chunk's joined documents, by the answers for one slice; runs may overlap."""
    begin, doc, _, of, shard, lines = got
    order = np.argsort(shard, kind="stable")  # as it was sent
    opening = np.searchsorted(shard[order], np.arange(int(shard.max()) + 2))
    texts, unpress = [], zstandard.ZstdDecompressor()
    for s, blob in answers:
        entry, first, length, owner = np.frombuffer(unpress.decompress(blob), "<i8").reshape(4, -1)
        texts.append(np.stack([order[opening[s] + np.cumsum(entry)], first, length, np.cumsum(owner)]))
    text, first, length, owner = np.concatenate(texts, 1)
    by = np.argsort(text, kind="stable")
    runs = np.searchsorted(text[by], np.arange(len(lines) + 1))
    n = np.diff(runs)[of]  # of each segment
    k = by[np.repeat(runs[of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    loses = owner[k] < np.repeat(ids[doc], n)
    a = (np.repeat(begin, n) + first[k])[loses]
    return a, a + length[k][loses] + width - 1


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs that overlap or touch, as one."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.concatenate([[True], begin[1:] > end[:-1]])[: len(begin)]
    return begin[new], end[np.append(new[1:], True)[: len(end)]] if len(end) else end


def _apply(width: int, shards: int, frequent, folder: str):
    schema = arrow_schema(RESULT)

    def run(batches):
        hot = Frequent(frequent.value)
        for b in batches:
            for chunk, blob in zip(b.column("chunk").to_pylist(), b.column("blob").to_pylist()):
                ids, texts = unpack_docs(blob)
                answers = answers_for(folder, chunk)
                found = [removed_runs(ids, got, answers[number], width) for number, _, got in slices(texts, width, shards, hot) if number in answers] if answers else []
                begin, end = merged(*(np.concatenate(x) for x in zip(*found))) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                size = np.fromiter(map(len, texts), np.int64, len(texts))
                start = np.cumsum(size + 1) - size - 1
                first = np.searchsorted(begin, np.append(start, start[-1:] + size[-1:] + 1))
                n_removed = np.concatenate([[0], np.cumsum(end - begin)])[first]
                shas = []
                for text, s, x, y in zip(texts, start.tolist(), first[:-1].tolist(), first[1:].tolist()):
                    if x == y:
                        shas.append(hashlib.sha256(text).hexdigest())
                        continue
                    kept, at, view = hashlib.sha256(), 0, memoryview(text)
                    for p, q in zip((begin[x:y] - s).tolist(), (end[x:y] - s).tolist()):
                        kept.update(view[at:p])
                        at = q
                    kept.update(view[at:])
                    shas.append(kept.hexdigest())
                yield batch(schema, id_array(ids), size, np.diff(n_removed), np.diff(first), shas)
        relieve()

    return run


def frequent_pieces(corpus: DataFrame, total: int, limit: int, share: int = 64, least: int = 8) -> np.ndarray:
    """Pieces that occur over `limit` times, by a sample of one chunk in `share`, sorted. They only tell which pieces are chosen
    last, never what recurs, so a sample will do; there are at most 100,000 of them whatever the input."""
    schema = arrow_schema("piece long, n long")
    share = int(max(1, min(share, total // (16 * chunk_bytes(total)))))

    def count(batches):
        for b in batches:
            for blob in b.column(0).to_pylist():
                raw = np.frombuffer(b"\0".join(unpack_docs(blob)[1]), np.uint8)
                for a in range(0, len(raw), SLICE):
                    head, n = np.unique(eight(raw[a : a + SLICE]), return_counts=True)
                    yield batch(schema, head[n >= least].view(np.int64), n[n >= least])
        relieve()

    picked = corpus.where(F.pmod(F.xxhash64("chunk"), F.lit(share)) == 0).select("blob")
    often = picked.mapInArrow(count, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).where(F.col("n") > max(limit, total // 100_000) / share)
    return np.sort(np.array([r[0] for r in often.select("piece").collect()], np.int64).view(np.uint64))


def remove_repeats(docs: DataFrame, width: int = 50, shard_bytes: int = 8 * MB) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    if width < 16:
        raise ValueError("the width is at least 16 bytes")
    spark, total = docs.sparkSession, text_bytes(docs)
    shards = int(max(64, 3 * total // shard_bytes))  # a byte travels in about three segments
    corpus = packed(docs, total).select("chunk", "blob")
    frequent = spark.sparkContext.broadcast(frequent_pieces(corpus, total, shard_bytes // 128))
    replies = corpus.mapInArrow(_send(width, shards, frequent), SEGMENTS).groupBy("shard").applyInArrow(_answer(width), REPLIES)
    return corpus.mapInArrow(_apply(width, shards, frequent, answers_by_chunk(replies)), RESULT)
