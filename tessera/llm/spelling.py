"""Spelling variants grouped by letter-parity bands.

Words are counted over all texts, and words that differ by one edit are found without
comparing all pairs. Each letter has a bit of its own, set if the word holds it an odd
number of times; the bits are dealt into three bands. One edit flips at most two bits, so
near words agree in a band at least, and their lengths differ by one at most:

1. every word goes to the groups (band, value of the band, length) it can meet others in;
2. a group of more than `limit` words is split by three sub-bands of the two other bands,
   of which near words again share one, and what is still larger is dealt into blocks of
   which every two meet in a task of their own: no task holds more than two blocks;
3. a task joins words of equal sub-bands, and of equal thirds of the rest, in bounded pieces, drops pairs that differ in more
   than two bits, and verifies the rest letter by letter. A pair counts only in the first
   band, sub-band and third that its words share, so once. What leaves the task is one row a word:
   its near words so far and the most frequent of them, never a pair.

Null text has no words; a null id is empty text in the hash. Repeated rows count as often as
they are there. Ties go to the smaller word by code points. An empty table gives an
empty result; other columns are ignored. Words of any length are whole.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MB, arrow_schema, batch, mix, table, tune

COUNTS = "word string, n long"
GROUPED = "key long, sub long, part long, word string, n long"
FOUND = "word string, n_near long, best_n long, best string"
#: Words are Latin-1 bytes inside tasks, a byte a code point: a-z and U+00C0 to U+00FF stay, A-Z become a-z, all else parts words.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 192 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
BANDS, WIDTH, ODD = 3, 30, np.uint64(0x9E3779B97F4A7C15)
#: (band, bit) of each letter: letters in turn, so that each band holds frequent and rare ones.
BIT_OF = {b: (i % BANDS, i // BANDS) for i, b in enumerate([*range(97, 123), *range(192, 256)])}


def word_counts(docs: DataFrame, least: int, every: int = 199, flush: int = 200_000) -> DataFrame:
    """(word, n) per task, summed up to `flush` words at a time; every: one occurrence in so many loses a letter, by crc32 of id and word; 0: none."""
    schema = arrow_schema(COUNTS)

    def put(counts):
        return batch(schema, pa.array([w.decode("latin-1") for w in counts], pa.string()), np.fromiter(counts.values(), np.int64, len(counts)))

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for w, n in Counter(text.encode("latin-1", "replace").translate(LETTERS).split()).items():
                    if every:
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                        if h % every == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                    if len(w) >= least:
                        counts[w] += n
                if len(counts) >= flush:
                    yield put(counts)
                    counts.clear()
        yield put(counts)

    tune(docs.sparkSession)
    return docs.where(F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(run, COUNTS).groupBy("word").agg(F.sum("n").alias("n"))


def masks(words: list[bytes]) -> np.ndarray:
    """Parity of every letter, a column a band."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer(b"".join(words), np.uint8)
    band, bit = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for b, (x, y) in BIT_OF.items():
        band[b], bit[b] = x, 1 << y
    out = np.zeros((len(words), BANDS), np.int64)
    full = size > 0
    starts = (np.cumsum(size) - size)[full]
    for x in range(BANDS):
        if len(letters):
            out[full, x] = np.bitwise_xor.reduceat(np.where(band[letters] == x, bit[letters], 0), starts)
    return out


def sub_bands(mask: np.ndarray, band: int) -> np.ndarray:
    """Values of the three sub-bands of the two bands that are not `band`; a column each."""
    a, b = mask[:, (band + 1) % BANDS], mask[:, (band + 2) % BANDS]
    own = [sum(1 << y for y in range(s, WIDTH, BANDS)) for s in range(BANDS)]
    return np.stack([(a & o) | (b & o) << WIDTH for o in own], 1)


def _keys(words: list[bytes]) -> np.ndarray:
    """Group keys of each word: band, its value, and the length of the shorter of two words that meet."""
    mask, size = masks(words), np.minimum(np.fromiter(map(len, words), np.int64, len(words)), 1 << 28)
    return np.concatenate([np.stack([(mask[:, x] << 30 | size - d) << 2 | x for d in (0, 1)], 1) for x in range(BANDS)], 1)


def _bytes(column: pa.Array) -> list[bytes]:
    return [w.encode("latin-1") for w in column.to_pylist()]


def _spread(subs: bool):
    """Rows (key, sub, part, word, n) of each word: its groups, or the sub-bands of the one in its `key`."""
    schema = arrow_schema(GROUPED)

    def run(batches):
        for b in batches:
            words = _bytes(b.column("word"))
            if not words:
                continue
            if subs:
                key, mask = b.column("key").to_numpy(), masks(words)
                sub = np.zeros((len(words), BANDS), np.int64)
                for x in range(BANDS):
                    sub[key & 3 == x] = sub_bands(mask[key & 3 == x], x) << 2
                sub, key = sub + np.arange(BANDS), np.repeat(key, BANDS)
            else:
                key, sub = _keys(words).ravel(), np.zeros(0)
            times = len(key) // len(words)
            at = np.repeat(np.arange(len(words)), times)
            yield batch(schema, key, sub.ravel() if subs else np.full(len(key), -1), np.zeros(len(key), np.int64), b.column("word").take(pa.array(at)), b.column("n").take(pa.array(at)))

    return run


def thirds(sub: np.ndarray, s: int) -> np.ndarray:
    """Of the sub-bands of a row but number s, three parts; words that differ in two bits of them agree in a part."""
    rest = sub[:, (s + 1) % BANDS] | sub[:, (s + 2) % BANDS]
    own = [sum(1 << y for y in range(WIDTH) if y // BANDS % BANDS == t) for t in range(BANDS)]
    return np.stack([rest & (o | o << WIDTH) for o in own], 1)


def pairs_of(key: np.ndarray, least: np.ndarray, most: int = 1 << 20):
    """Index pairs (i, j), i < j, of equal key in this sorted array, in pieces of about `most`; i is one of `least`."""
    later = np.where(least, np.searchsorted(key, key, side="right") - np.arange(len(key)) - 1, 0)
    cuts = np.searchsorted(np.cumsum(later), np.arange(most, later.sum() + most, most)) + 1
    a = 0
    for b in np.minimum(cuts, len(key)).tolist():
        n = later[a:b]
        if n.sum():
            left = np.repeat(np.arange(a, b), n)
            yield left, left + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a = b


def one_edit(letters: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the words x and y are one edit apart; y has as many letters as x or one more, and differs. letters: zeros after the end, one at least."""
    out, width = np.zeros(len(x), bool), letters.shape[1] - 1
    step = max(1, 16 * MB // (width + 1))
    for k in range(0, len(x), step):
        a, b, short = letters[x[k : k + step], :width], letters[y[k : k + step]], size[x[k : k + step]]
        longer = size[y[k : k + step]] > short
        same = a == b[:, :width]
        out[k : k + step] = ~longer & ((~same).sum(1) == 1)
        if longer.any():
            head = np.cumprod(same[longer], 1, dtype=np.int8).sum(1, dtype=np.int64)
            tail = np.cumprod((a[longer] == b[longer, 1:])[:, ::-1], 1, dtype=np.int8).sum(1, dtype=np.int64) - (width - short[longer])
            out[k + np.flatnonzero(longer)] = head + tail >= short[longer]
    return out


def near_in_groups(words: list[bytes], n: np.ndarray, key: np.ndarray, sub: np.ndarray, part: np.ndarray):
    """(row, near words, n of the most frequent, its row) for the pairs that belong to the groups (key, sub, part) of these rows."""
    band, short = key & 3, key >> 2 & (1 << 30) - 1
    order = np.lexsort((part, sub, key))
    new = (np.diff(key[order]) != 0) | (np.diff(sub[order]) != 0) | (np.diff(part[order]) != 0)
    group = np.zeros(len(words), np.int64)
    group[order] = np.cumsum(np.append(False, new))
    blocks, low, high = part >> 40, part >> 20 & (1 << 20) - 1, part & (1 << 20) - 1
    side = np.zeros(len(words), bool)
    for k in np.flatnonzero(blocks).tolist():
        side[k] = zlib.crc32(words[k]) % int(blocks[k]) == high[k]
    crossed = low != high
    size, mask = np.fromiter(map(len, words), np.int64, len(words)), masks(words)
    subs = np.zeros((len(words), BANDS), np.int64)
    for c in range(BANDS):
        subs[band == c] = sub_bands(mask[band == c], c)
    flat = np.stack([mask[:, 0] | mask[:, 1] << WIDTH, mask[:, 2]], 1).view(np.uint64)
    left, right = [], []
    kind = np.ceil(np.log2(np.maximum(short, 16))).astype(int)  # words of like length in one matrix: it is no larger than twice the words
    for c in np.unique(kind).tolist():
        of_kind = np.flatnonzero(kind == c)
        width = int(short[of_kind].max()) + 2
        letters = np.frombuffer(b"".join(words[k].ljust(width, b"\0") for k in of_kind.tolist()), np.uint8).reshape(len(of_kind), width)
        place = np.zeros(len(words), np.int64)
        place[of_kind] = np.arange(len(of_kind))
        for s in range(BANDS):
            rows = of_kind[(sub[of_kind] < 0) | (sub[of_kind] & 3 == s)]
            parts = thirds(subs[rows], s)
            for t in range(BANDS):
                # equal hashes stand beside each other, words of the shorter length first: the longer ones do not pair among themselves
                hashed = mix(mix(group[rows].astype(np.uint64) * ODD + subs[rows, s].astype(np.uint64)) + parts[:, t].astype(np.uint64)) >> np.uint64(1)
                longer = size[rows] > short[rows]
                by = np.lexsort((longer, hashed))
                r, third = rows[by], parts[by]
                one, two = flat[r, 0], flat[r, 1]
                for x, y in pairs_of(hashed[by], ~longer[by]):
                    ok = np.bitwise_count(one[x] ^ one[y]) + np.bitwise_count(two[x] ^ two[y]) <= 2
                    x, y = x[ok], y[ok]
                    for t2 in range(t):  # pairs that share an earlier part, sub-band or band are found there
                        ok = third[x, t2] != third[y, t2]
                        x, y = x[ok], y[ok]
                    i, j = r[x], r[y]
                    ok = (group[i] == group[j]) & (~crossed[i] | (side[i] != side[j]))
                    for s2 in range(s):
                        ok &= subs[i, s2] != subs[j, s2]
                    for c2 in range(BANDS):
                        ok &= (band[i] <= c2) | (mask[i, c2] != mask[j, c2])
                    i, j = i[ok], j[ok]
                    ok = one_edit(letters, size[of_kind], place[i], place[j])
                    left.append(i[ok])
                    right.append(j[ok])
    none = np.zeros(0, np.int64)
    x, y = np.concatenate([none, *left, *right]), np.concatenate([none, *right, *left])
    seen, of = np.unique(y, return_inverse=True)
    rank = np.argsort(np.array([words[k] for k in seen.tolist()], dtype=object), kind="stable")
    rank[rank.copy()] = np.arange(len(rank))
    order = np.lexsort((rank[of], -n[y], x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else none
    return x[first], np.diff(np.append(first, len(x))), n[y[first]], y[first]


def _near(t: pa.Table) -> pa.Table:
    at, near, best_n, best = near_in_groups(_bytes(t.column("word")), *(t.column(c).to_numpy() for c in ("n", "key", "sub", "part")))
    names = t.column("word").combine_chunks()
    return pa.Table.from_batches([batch(arrow_schema(FOUND), names.take(pa.array(at)), near, best_n, names.take(pa.array(best)))])


def near_words(words: DataFrame, limit: int = 20_000) -> DataFrame:
    """(word, n_near, best_n, best) of every word that has a word one edit away; words: a written table (word, n)."""
    rows = words.mapInArrow(_spread(False), GROUPED)
    often = rows.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > limit).select("key")
    often = table(often)  # few: each stands for over `limit` rows
    calm = rows.join(often, "key", "left_anti")
    split = rows.join(often, "key", "left_semi").select("key", "word", "n").mapInArrow(_spread(True), GROUPED)
    full = table(split.groupBy("key", "sub").agg(F.count("*").alias("m")).where(F.col("m") > limit).select("key", "sub", F.ceil(F.col("m") / (limit / 2)).alias("blocks")))
    # block i meets block j, i <= j, in part (blocks, i, j); pairs within i are found in (i, i) alone
    own, other = F.crc32(F.encode("word", "ISO-8859-1")) % F.col("blocks"), F.col("other")
    dealt = split.join(full, ["key", "sub"]).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    part = F.shiftleft(F.col("blocks"), 40) + F.shiftleft(F.least(own, other), 20) + F.greatest(own, other)
    dealt = dealt.select("key", "sub", part.alias("part"), "word", "n")
    groups = calm.unionByName(split.join(full, ["key", "sub"], "left_anti")).unionByName(dealt)
    # whole groups together in tasks of some 100,000 rows; none has more than `limit`
    tasks = max(64, words.count() * 2 * BANDS // 100_000)
    found = groups.groupBy(F.pmod(F.xxhash64("key", "sub", "part"), F.lit(tasks)).alias("task")).applyInArrow(lambda t: _near(t), FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("a"), F.col("best").alias("b")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("x")).select("word", "n_near", (-F.col("x.a")).alias("best_n"), F.col("x.b").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words in (word, form), forms followed to the last by doubling: as many joins as the logarithm of the longest chain."""
    links = table(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = table(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = step.select("word", "root")
        if step.where("moved").isEmpty():
            return links


def variants(docs: DataFrame, letters: int = 6, least: int = 5, ratio: int = 5, every: int = 199, limit: int = 20_000) -> DataFrame:
    """(word, form, root, n, n_near, form_n): words of `letters` or more, `least` or more times; a form is `ratio` times as frequent as its variant."""
    words = table(word_counts(docs, letters, every).where(F.col("n") >= least))
    near = words.join(near_words(words, limit), "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    linked = table(near.select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")))
    last = roots(linked.where("form IS NOT NULL"))
    return linked.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
