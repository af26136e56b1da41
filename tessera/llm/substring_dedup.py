"""Substring dedup with repeated-phrase automata.

A window is `width` consecutive words of one document. Every window belongs to the
shard that its minimiser names (the smallest hash among its 3-word pieces), and
consecutive windows of one minimiser travel as one segment, once per chunk. Minimisers
that a sample of chunks shows to be frequent deal their windows by the window's own hash
instead, so no shard is a frequent phrase's alone (`hot_minimisers`).

1. In a shard, windows that occur more than once are confirmed word by word. What goes
   back to a chunk is, per window, its owner: the smallest document id it starts in.
2. A chunk joins its recurring windows to passages, compiles these into Aho-Corasick
   automata of bounded size (keys are the passages' bytes between spaces), and streams all
   its documents through them: every occurrence that an automaton finds is one, no other.
   A word goes if a window over it has an owner below its own document.

Null text has no words. Null ids are above every id: such a document owns nothing for
others, and loses what others own. Repeated ids count as one owner. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import batched, chain, compress, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MB, NO_ID, answers_by_chunk, answers_for, arrow_schema, batch, chunk_bytes, hashes, id_array, mix, number, packed, text_bytes, unpack_docs, words_of

SEGMENTS = "shard long, chunk long, n int, blob binary"
REPLIES = "chunk long, shard long, blob binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
PIECE, ODD = 3, np.uint64(0x9E3779B97F4A7C15)


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` entries."""
    n = len(h) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        out = out * ODD + h[k : k + n] if n > 0 else out
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def word_windows(texts: list[bytes], width: int):
    """(words, bounds of texts, hashes of words, start and document of each window, its minimiser); None for the last four if there is no window."""
    every, bounds = words_of(texts)
    if len(every) < width:
        return every, bounds, None, None, None, None
    h = hashes(every)
    low = sliding_min(rolling(h, PIECE), width - PIECE + 1)
    start = np.arange(len(low))
    doc = np.searchsorted(bounds, start, side="right") - 1
    inside = start + width <= bounds[doc + 1]
    return every, bounds, h if inside.any() else None, start[inside], doc[inside], low[inside]


def segments(texts: list[bytes], width: int, shards: int, hot: np.ndarray):
    """What both ends of the exchange derive from a chunk: words, windows, distinct segments and their shards. hot: sorted minimisers."""
    every, bounds, h, start, doc, low = word_windows(texts, width)
    if h is None:
        return every, bounds, None
    full = rolling(h, width)
    if len(hot):
        known = hot[np.minimum(np.searchsorted(hot, low), len(hot) - 1)] == low
        low = np.where(known, full[start], low)
    first = np.ones(len(start), bool)
    first[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, len(start)))  # windows of each segment
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(full[start] + np.uint64(1) * (np.arange(len(start)) - np.repeat(at, size)).astype(np.uint64)), dtype=np.uint64)])
    key = mix(sums[at + size] - sums[at] + size.astype(np.uint64) * ODD)
    _, rep, of = np.unique(key, return_index=True, return_inverse=True)
    # equal keys are confirmed byte by byte; a segment unlike its representative stands for itself
    joined = b" ".join(every)
    place = np.concatenate([[0], np.cumsum(np.fromiter(map(len, every), np.int64, len(every)) + 1)])
    begin, end = place[start[at]], place[start[at] + size + width - 1] - 1
    rep_of = rep[of]
    twice = np.flatnonzero(rep_of != np.arange(len(at)))
    for k, r, x, y, z, w in zip(*(v.tolist() for v in (twice, rep_of[twice], begin[twice], end[twice], begin[rep_of[twice]], end[rep_of[twice]]))):
        if joined[x:y] != joined[z:w]:
            rep_of[k] = k
    reps, of = np.unique(rep_of, return_inverse=True)
    shard = (mix(low[at[reps]]) % np.uint64(shards)).astype(np.int64)
    return every, bounds, (start, doc, at, size, of, reps, shard, [joined, begin[reps], end[reps]])


def _send(width: int, shards: int, hot):
    schema = arrow_schema(SEGMENTS)

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for chunk, blob in zip(b.column("chunk").to_pylist(), b.column("blob").to_pylist()):
                ids, texts = unpack_docs(blob)
                _, _, got = segments(texts, width, shards, hot.value)
                if got is None:
                    continue
                start, doc, at, size, of, reps, shard, (joined, begin, end) = got
                seg_doc = ids[doc[at]]
                low = np.full(len(reps), NO_ID)
                high = np.full(len(reps), np.iinfo(np.int64).min)
                np.minimum.at(low, of, seg_doc)
                np.maximum.at(high, of, seg_doc)
                lines = np.array([joined[x:y] for x, y in zip(begin.tolist(), end.tolist())], dtype=object)
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.diff(shard[order])) + 1
                groups = np.split(order, cuts)
                yield batch(schema, shard[[g[0] for g in groups]], [chunk] * len(groups), [len(g) for g in groups],
                            [press.compress(np.diff(low[g], prepend=0).tobytes() + (high[g] - low[g]).tobytes() + b"\n".join(lines[g])) for g in groups])

    return run


def _by_key(sorted_of: np.ndarray, values: np.ndarray, f) -> np.ndarray:
    return f.reduceat(values, np.flatnonzero(np.append(True, sorted_of[1:] != sorted_of[:-1])))


def _windows(words: list[bytes], texts: list[bytes], width: int):
    """(bounds of texts, place, text and hash of every window)."""
    bounds = np.concatenate([[0], np.cumsum(np.fromiter((x.count(b" ") for x in texts), np.int64, len(texts)) + 1)])
    fp = rolling(hashes(words, 7), width)
    pos = np.arange(len(fp))
    text = np.searchsorted(bounds, pos, side="right") - 1
    inside = pos + width <= bounds[text + 1]
    return bounds, pos[inside], text[inside], fp[inside]


def confirmed(lines: list[bytes], low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, window within it, owner) of every occurrence of a recurring window; low, high: smallest and largest document of each line."""
    index: dict[bytes, int] = {}
    of = np.fromiter((index.setdefault(x, len(index)) for x in lines), np.int64, len(lines))
    owner_of_text = np.full(len(index), NO_ID)
    np.minimum.at(owner_of_text, of, low)
    copies = np.bincount(of, minlength=len(index))
    uses = np.bincount(of, weights=1 + (low < high), minlength=len(index))  # a line may stand for several documents of its chunk
    none = np.zeros(0, np.int64)
    # by hash first: most texts hold no recurring window and go no further
    bounds, pos, text, fp = _windows(b" ".join(index).split(), list(index), width)
    if not len(pos):
        return none, none, none
    _, w_of = np.unique(fp, return_inverse=True)
    live = np.unique(text[np.bincount(w_of, weights=uses[text])[w_of] > 1])
    if not len(live):
        return none, none, none
    every = list(index)
    every = [every[k] for k in live.tolist()]
    new = np.full(len(index), -1)
    new[live] = np.arange(len(live))
    line_of = np.flatnonzero(new[of] >= 0)  # lines that take part
    of, owner_of_text, copies, uses = new[of][line_of], owner_of_text[live], copies[live], uses[live]
    flat, _ = number(b" ".join(every).split())
    bounds, pos, text, fp = _windows(b" ".join(every).split(), every, width)
    _, rep, w_of = np.unique(fp, return_index=True, return_inverse=True)
    recurs = np.bincount(w_of, weights=uses[text])[w_of] > 1
    # confirm: the words of each recurring window against the first window of that hash
    same = np.ones(len(pos), bool)
    for k in range(width):
        same &= flat[pos + k] == flat[pos[rep[w_of]] + k]
    w_of = w_of.copy()
    w_of[~same] = len(rep) + np.arange((~same).sum())
    recurs |= ~same
    groups = int(w_of.max()) + 1
    at = np.flatnonzero(recurs)
    owner = np.full(groups, NO_ID)
    np.minimum.at(owner, w_of[at], owner_of_text[text[at]])
    # occurrences by text, spread over the lines that hold the text
    by_text = np.argsort(of, kind="stable")
    begin = np.searchsorted(of[by_text], text[at])
    n = copies[text[at]]
    line = by_text[np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    return line_of[line], np.repeat(pos[at] - bounds[text[at]], n), np.repeat(owner[w_of[at]], n)


def _answer(width: int):
    schema = arrow_schema(REPLIES)

    def run(t: pa.Table) -> pa.Table:
        unpress = zstandard.ZstdDecompressor()
        shard, chunks, counts = t.column("shard")[0].as_py(), t.column("chunk").to_pylist(), t.column("n").to_numpy().astype(np.int64)
        lines, low, high = [], [], []
        for n, blob in zip(counts.tolist(), t.column("blob")):
            raw = unpress.decompress(blob.as_py())
            low.append(np.cumsum(np.frombuffer(raw, np.int64, n)))
            high.append(low[-1] + np.frombuffer(raw, np.int64, n, 8 * n))
            lines += raw[16 * n :].split(b"\n")
        low, high = np.concatenate(low), np.concatenate(high)
        line, window, owner = confirmed(lines, low, high, width)
        wanted = owner < high[line]  # some document of that chunk loses the window
        line, window, owner = line[wanted], window[wanted], owner[wanted]
        at = np.repeat(np.arange(len(counts)), counts)[line]
        order = np.argsort(at, kind="stable")
        at, line, window, owner = at[order], line[order] - (np.cumsum(counts) - counts)[at[order]], window[order], owner[order]
        press, out = zstandard.ZstdCompressor(level=1), ([], [], [])
        for k in np.unique(at).tolist():
            a, b = np.searchsorted(at, [k, k + 1])
            for col, v in zip(out, (chunks[k], shard, press.compress(line[a:b].astype("<i8").tobytes() + window[a:b].astype("<i8").tobytes() + owner[a:b].astype("<i8").tobytes()))):
                col.append(v)
        return pa.Table.from_batches([batch(schema, *out)])

    return run


class Passages:
    """Recurring passages of a chunk in automata of at most `most` bytes of keys each."""

    def __init__(self, width: int, most: int = MB):
        self.width, self.most, self.number = width, most, {}
        self.owners: list[np.ndarray] = []

    def add(self, words: list[bytes], owners: np.ndarray) -> None:
        """owners: of each window of these words."""
        key = b" ".join(words)
        if key not in self.number:
            self.number[key] = len(self.owners)
            self.owners.append(owners)

    def locate(self, texts: list[bytes]):
        """(texts, ends, numbers) of all occurrences that the automata find, some at a time, words joined by one space; ends: of their last bytes."""
        import ahocorasick

        keys = list(self.number.items())
        texts = [t.decode("latin-1") for t in texts]  # a byte a sign, so that automata see bytes
        while keys:
            auto, size = ahocorasick.Automaton(), 0
            while keys and size < self.most:
                key, n = keys.pop()
                auto.add_word(f" {key.decode('latin-1')} ", n)
                size += len(key)
            auto.make_automaton()
            held = chain.from_iterable(zip(repeat(k), *zip(*found)) for k, t in enumerate(texts) for found in batched(auto.iter(f" {t} "), 1 << 16))
            for part in batched(held, 1 << 18):  # a passage of equal words is found at every word
                text, end, number = np.array(part, dtype=np.int64).T
                yield text, end - 2, number


def _apply(width: int, shards: int, hot, folder: str):
    schema = arrow_schema(RESULT)

    def passages(every: list[bytes], got, answers: list[tuple[int, bytes]]) -> Passages:
        """From the answers about this chunk's segments."""
        unpress, out = zstandard.ZstdDecompressor(), Passages(width)
        start, doc, at, size, of, reps, shard, _ = got
        order = np.argsort(shard, kind="stable")  # as it was sent
        first = np.searchsorted(shard[order], np.arange(shards + 1))
        base = np.cumsum(size[reps]) - size[reps]
        owner = np.full(int(size[reps].sum()), NO_ID)
        for s, b in answers:
            line, window, own = np.frombuffer(unpress.decompress(b), "<i8").reshape(3, -1)
            owner[base[order[first[s] + line]] + window] = own
        own = owner[np.repeat(base[of], size) + np.arange(len(start)) - np.repeat(at, size)]  # of each window
        hit = np.flatnonzero(own != NO_ID)
        if len(hit):
            breaks = np.flatnonzero((np.diff(hit) != 1) | (np.diff(doc[hit]) != 0)) + 1
            for run in np.split(hit, breaks):
                x = int(start[run[0]])
                out.add(every[x : x + len(run) + width - 1], own[run])
        return out

    def covered(known: Passages, ids: np.ndarray, every: list[bytes], bounds: np.ndarray, joined: list[bytes]) -> np.ndarray:
        """Whether each word goes. A find brings the runs of windows of one owner in its passage, never the windows one by one."""
        cut = [np.flatnonzero(np.append(True, o[1:] != o[:-1])) for o in known.owners]
        n_runs = np.fromiter(map(len, cut), np.int64, len(cut))
        opening = np.cumsum(n_runs) - n_runs
        run_first = np.concatenate(cut)
        run_end = np.concatenate([np.append(c[1:], len(o)) for c, o in zip(cut, known.owners)])
        run_owner = np.concatenate([o[c] for c, o in zip(cut, known.owners)])
        n_words = np.fromiter(map(len, known.owners), np.int64, len(cut)) + width - 1
        begins = np.cumsum(np.fromiter(map(len, every), np.int64, len(every)) + 1)  # of the words after each, in one row of all words
        opens = np.concatenate([[0], begins])[bounds[:-1]]
        out = np.zeros(len(every) + 1, np.int64)
        for text, end, number in known.locate(joined):
            last = np.searchsorted(begins, opens[text] + end, side="right")  # the word that holds the byte
            n = n_runs[number]
            run = np.repeat(opening[number], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            lost = run_owner[run] < np.repeat(ids[text], n)
            at = np.repeat(last + 1 - n_words[number], n)
            np.add.at(out, (at + run_first[run])[lost], 1)
            np.subtract.at(out, (at + run_end[run] + width - 1)[lost], 1)
        return np.cumsum(out[:-1]) > 0

    def run(batches):
        for b in batches:
            for chunk, blob in zip(b.column("chunk").to_pylist(), b.column("blob").to_pylist()):
                ids, texts = unpack_docs(blob)
                answers = answers_for(folder, chunk).get(0)
                every, bounds, got = segments(texts, width, shards, hot.value) if answers else (*words_of(texts), None)
                joined = [b" ".join(every[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                known = passages(every, got, answers) if got is not None else None
                gone = covered(known, ids, every, bounds, joined) if known and known.owners else np.zeros(len(every), bool)
                removed = np.concatenate([[0], np.cumsum(gone)])
                n_removed = removed[bounds[1:]] - removed[bounds[:-1]]
                shas = []
                for a, b, r, whole in zip(bounds[:-1].tolist(), bounds[1:].tolist(), n_removed.tolist(), joined):
                    shas.append(hashlib.sha256(b" ".join(compress(every[a:b], (~gone[a:b]).tolist())) if r else whole).hexdigest())
                yield batch(schema, id_array(ids), np.diff(bounds), n_removed, shas)

    return run


def hot_minimisers(corpus: DataFrame, total: int, width: int, shard_bytes: int, share: int = 64, least: int = 8) -> np.ndarray:
    """Minimisers whose segments, by a sample of one chunk in `share`, fill over half a shard. They only tell how windows
    are dealt, so a sample will do; there are at most 100,000 of them whatever the input."""
    spark, schema = corpus.sparkSession, arrow_schema("low long, bytes long")
    share = int(max(1, min(share, total // (16 * chunk_bytes(total)))))

    def count(batches):
        for b in batches:
            for blob in b.column(0).to_pylist():
                _, _, h, start, doc, low = word_windows(unpack_docs(blob)[1], width)
                if h is not None:
                    first = np.append(True, (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]))
                    at = np.flatnonzero(first)
                    size = 7 * (np.diff(np.append(at, len(low))) + width - 1)
                    lows, of = np.unique(low[at], return_inverse=True)
                    n = np.bincount(of)
                    often = n >= least
                    yield batch(schema, lows[often].view(np.int64), np.bincount(of, weights=size).astype(np.int64)[often])

    limit = max(shard_bytes // 2, total // 30_000) / share
    picked = corpus.where(F.pmod(F.xxhash64("chunk"), F.lit(share)) == 0).select("blob")
    rows = picked.mapInArrow(count, "low long, bytes long").groupBy("low").agg(F.sum("bytes").alias("b")).where(F.col("b") > limit).select("low").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def remove_repeats(docs: DataFrame, width: int = 13, shard_bytes: int = 8 * MB) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row."""
    total = text_bytes(docs)
    shards = int(max(12, total // shard_bytes))
    corpus = packed(docs, total)
    hot = docs.sparkSession.sparkContext.broadcast(hot_minimisers(corpus, total, width, shard_bytes))
    replies = corpus.select("chunk", "blob").mapInArrow(_send(width, shards, hot), SEGMENTS).groupBy("shard").applyInArrow(_answer(width), REPLIES)
    folder = answers_by_chunk(replies.withColumn("slice", F.lit(0)))
    return corpus.select("chunk", "blob").mapInArrow(_apply(width, shards, hot, folder), RESULT)
