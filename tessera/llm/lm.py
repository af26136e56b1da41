"""LM scoring with a hashed maximum-entropy model.

P(word | history) = P(class | history) P(word | class). The classes are the leaves of a tree of
`depth` two-way softmaxes (class-factored): a word's path takes three bits from its last letters,
three from its first ones and the rest from the whole word, so unknown words have one too. Each
two-way softmax adds a hashed weight for each of three features with the tree node: the word before
(bigram), the one before it (skip) and both together (trigram), to the node's own log odds. P(word |
class) is add-one over the class's training counts, with one share for unknown words; all of it sums
to one over known words and the unknown.

The corpus is cut into words once, into chunks of numbered words. Word counts come from all
training rows through an exchange by word hash, once per chunk, and the answers go back to the
chunks that asked, so no vocabulary is ever held whole.

Training: each round sums, over all training tokens, the gradient's two halves for every weight:
how often the feature's decision went right, and how often the model of the round before expected
it to. One step then moves each weight by the difference of the two log odds. Sums do not depend
on how rows lie in tasks. They meet in a tree of groups of at most `FAN` rows. Weights number
2^18 to 2^22 with the input (`weights`): what is broadcast or collected is bounded by 16 MB each.

Null text is empty (the end token alone). Null ids count as training rows. With no
training rows every word is unknown. An empty table gives an empty result; other columns
are ignored, repeated rows count each.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MB, NO_ID, arrow_schema, batch, chunk_bytes, hashes, id_array, ids_of, mix, number, relieve, table, text_bytes, tune, words_of
from .simhash import LOWER

CHUNKS = "chunk long, docs binary, tokens binary, words binary, keys binary, paths binary, counts binary"
ASKS = "shard long, chunk long, n int, blob binary"
REPLIES = "chunk long, shard long, blob binary"
SUMS = "block int, task int, blob binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
END = b"\n"  # no word is it; number 0 of every chunk
FAN, STEP, BLOCK, FLUSH = 64, 4096, 1 << 16, 32


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def paths_of(words: list[bytes], key: np.ndarray, depth: int) -> np.ndarray:
    """Leaf of each word: bits of its last two letters, its first two, and its hash."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    two = lambda a, b, seed: mix((flat[a] | flat[b] << np.uint64(8)) + np.uint64(seed)) & np.uint64(7)
    last = two(start + np.maximum(size - 2, 0), start + size - 1, 5)
    first = two(start, start + np.minimum(1, size - 1), 9)
    leaf = last << np.uint64(9) | first << np.uint64(6) | key & np.uint64(63)
    return (leaf >> np.uint64(12 - depth)).astype(np.uint16)


def make_chunk(chunk: int, ids: np.ndarray, texts: list[bytes], depth: int, mod: int, rest: int) -> tuple:
    """A row of CHUNKS."""
    held = np.fromiter((i != NO_ID and zlib.crc32(str(i).encode()) % mod == rest for i in ids.tolist()), bool, len(ids))
    every, bounds = words_of(texts)
    flat, words = number(every)
    words = [END, *words]
    ends = bounds[1:] + np.arange(len(ids))  # each document is followed by END
    tokens = np.zeros(len(every) + len(ids), np.int32)
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[inner] = flat + 1
    sizes = np.diff(bounds) + 1
    counts = np.bincount(tokens[np.repeat(~held, sizes)], minlength=len(words))
    key = hashes(words, 1)
    return (chunk, _pack(ids.astype("<i8"), sizes.astype("<i8"), held.astype("<i8")), _pack(tokens.astype("<i4")),
            zstandard.ZstdCompressor(level=1).compress(b" ".join(words)), key.astype("<u8").tobytes(), _pack(paths_of(words, key, depth).astype("<u2")), _pack(counts.astype("<i8")))


class Chunk:
    """Numbered tokens of a chunk in a row."""

    def __init__(self, docs: bytes, tokens: bytes, keys: bytes, paths: bytes):
        self.ids, self.sizes, held = _unpack(docs, "<i8").reshape(3, -1)
        self.held, self.tokens = held.astype(bool), _unpack(tokens, "<i4")
        self.keys, self.paths = np.frombuffer(keys, "<u8"), _unpack(paths, "<u2").astype(np.int32)

    def features(self, bits: int) -> list[np.ndarray]:
        """For each token its bigram, skip and trigram feature, as `bits` bits."""
        first = np.cumsum(self.sizes) - self.sizes
        place = np.arange(len(self.tokens)) - np.repeat(first, self.sizes)
        every, end = self.keys[self.tokens], self.keys[0]
        one = np.where(place >= 1, np.roll(every, 1), end)
        two = np.where(place >= 2, np.roll(every, 2), end)
        shift = np.uint64(64 - bits)
        return [(x >> shift).astype(np.int32) for x in (mix(one + np.uint64(11)), mix(two + np.uint64(22)), mix(one * np.uint64(3) + mix(two)))]


class Model:
    """Weights, and the log odds of each node that no feature moves."""

    def __init__(self, weights: np.ndarray | None, bits: int, n_class: np.ndarray):
        leaves = len(n_class)
        self.bits, self.depth, self.weights = bits, leaves.bit_length() - 1, weights
        tree = np.concatenate([np.zeros(leaves), n_class + 1.0])
        for k in range(leaves - 1, 0, -1):
            tree[k] = tree[2 * k] + tree[2 * k + 1]
        self.bias = np.zeros(leaves, np.float32)
        self.bias[1:] = np.log(tree[3::2] / tree[2::2])
        self.node_hash = (mix(np.arange(leaves, dtype=np.uint64) + np.uint64(77)) >> np.uint64(64 - bits)).astype(np.int32)
        self.top, self.down = 1 << np.arange(self.depth, dtype=np.int32), np.arange(self.depth, 0, -1, dtype=np.int32)

    def decisions(self, paths: np.ndarray, features: list[np.ndarray]):
        """(weights used by each feature, log odds, decision taken) of tokens x levels."""
        path = paths[:, None]
        node = self.top | path >> self.down
        rows = [f[:, None] ^ self.node_hash.take(node) for f in features]
        odds = self.bias.take(node)
        if self.weights is not None:
            for r in rows:
                odds += self.weights.take(r)
        return rows, odds, path >> (self.down - 1) & 1

    def log10(self, paths: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
        """log10 P(leaf | history) of each token."""
        out = np.empty(len(paths))
        for k in range(0, len(paths), STEP):
            _, odds, bit = self.decisions(paths[k : k + STEP], [f[k : k + STEP] for f in features])
            out[k : k + STEP] = -np.log1p(np.exp(np.where(bit == 1, -odds, odds))).sum(axis=1)
        return out / np.log(10)


def chunks(docs: DataFrame, total: int, depth: int, mod: int, rest: int) -> DataFrame:
    """The corpus in numbered words, as a written table."""
    limit, schema = chunk_bytes(total), arrow_schema(CHUNKS)

    def run(batches):
        from pyspark import TaskContext

        part, seq, ids, texts, size = TaskContext.get().partitionId() << 32, 0, [], [], 0
        for b in batches:
            for i, t in zip(ids_of(b.column(0)).tolist(), b.column(1).to_pylist()):
                ids.append(i)
                texts.append((t or b"").translate(LOWER))
                size += len(texts[-1]) + 64
                if size >= limit:
                    yield batch(schema, *([x] for x in make_chunk(part + seq, np.array(ids), texts, depth, mod, rest)))
                    seq, ids, texts, size = seq + 1, [], [], 0
        if ids:
            yield batch(schema, *([x] for x in make_chunk(part + seq, np.array(ids), texts, depth, mod, rest)))
        relieve()

    tune(docs.sparkSession)
    return table(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, CHUNKS))


def _by_shard(keys: np.ndarray, shards: int) -> list[np.ndarray]:
    """Numbers of the words of each shard that has any, by shard."""
    shard = (keys % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(shard[order])) + 1)


def _ask(shards: int):
    schema = arrow_schema(ASKS)

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for chunk, words, keys, counts in zip(*(c.to_pylist() for c in b.columns)):
                words = np.array(zstandard.ZstdDecompressor().decompress(words).split(b" "), dtype=object)
                keys, counts = np.frombuffer(keys, "<u8"), _unpack(counts, "<i8")
                groups = _by_shard(keys, shards)
                yield batch(schema, [int(keys[g[0]] % np.uint64(shards)) for g in groups], [chunk] * len(groups), [len(g) for g in groups],
                            [press.compress(counts[g].tobytes() + b" ".join(words[g])) for g in groups])

    return run


def _count(depth: int):
    """Totals of a shard's words, sent to the chunks that asked; and in a row of chunk -1 each class's (tokens, words)."""
    schema = arrow_schema(REPLIES)

    def run(t: pa.Table) -> pa.Table:
        unpress = zstandard.ZstdDecompressor()
        totals: dict[bytes, int] = {}
        asked = []
        for n, blob in zip(t.column("n").to_pylist(), t.column("blob").to_pylist()):
            raw = unpress.decompress(blob)
            words = raw[8 * n :].split(b" ")
            asked.append(words)
            for w, c in zip(words, np.frombuffer(raw, "<i8", n).tolist()):
                totals[w] = totals.get(w, 0) + c
        shard, out = t.column("shard")[0].as_py(), []
        for chunk, words in zip(t.column("chunk").to_pylist(), asked):
            out.append((chunk, shard, _pack(np.fromiter(map(totals.__getitem__, words), "<i8", len(words)))))
        known = [w for w, n in totals.items() if n]
        if known:
            leaf = paths_of(known, hashes(known, 1), depth)
            n = np.bincount(leaf, weights=[totals[w] for w in known], minlength=1 << depth).astype("<i8")
            out.append((-1, shard, _pack(n, np.bincount(leaf, minlength=1 << depth).astype("<i8"))))
        return pa.Table.from_batches([batch(schema, *zip(*out))])

    return run


def summed(rows: DataFrame, tasks: int, kind: str) -> dict[int, np.ndarray]:
    """Sum of each block over (block, task, blob of `kind`); no group has over FAN rows. Blocks are few: their sums come to the driver."""
    schema = arrow_schema(SUMS)

    def add(t: pa.Table) -> pa.Table:
        total = 0
        for x in t.column("blob").to_pylist():
            total = total + _unpack(x, kind)
        return pa.Table.from_batches([batch(schema, [t.column("block")[0].as_py()], [t.column("task")[0].as_py()], [_pack(total)])])

    while True:
        tasks = -(-tasks // FAN)
        rows = rows.withColumn("task", (F.col("task") / FAN).cast("int")).groupBy("block", "task").applyInArrow(add, SUMS)
        if tasks <= 1:
            return {r["block"]: _unpack(r["blob"], kind) for r in rows.toLocalIterator()}


def class_counts(replies: DataFrame, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, words) of each class, from all shards."""
    schema = arrow_schema(SUMS)

    def run(batches):
        from pyspark import TaskContext

        total = np.zeros(2 << depth, np.int64)
        for b in batches:
            for blob in b.column(0).to_pylist():
                total += _unpack(blob, "<i8")
        yield batch(schema, [0], [TaskContext.get().partitionId()], [_pack(total)])

    rows = replies.where("chunk = -1").select("blob")
    got = summed(rows.mapInArrow(run, SUMS), rows.rdd.getNumPartitions(), "<i8")
    n, v = got.get(0, np.zeros(2 << depth, np.int64)).reshape(2, -1)
    return n, v


def train(corpus: DataFrame, n_class: np.ndarray, bits: int, rounds: int, rate: float, smooth: float) -> Model:
    spark, size = corpus.sparkSession, 1 << bits
    schema = arrow_schema(SUMS)
    model, seen = Model(None, bits, n_class), None
    tasks = corpus.rdd.getNumPartitions()

    for _ in range(rounds):
        shared, first = spark.sparkContext.broadcast(model), seen is None

        def run(batches, shared=shared, first=first):
            from pyspark import TaskContext

            model, task, used, steps = shared.value, TaskContext.get().partitionId(), False, 0
            expected, few, observed = np.zeros(size), np.zeros(size, np.float32), np.zeros(size if first else 0, np.int64)  # of the latter: went right << 32 | all
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    c = Chunk(*row)
                    at = np.flatnonzero(np.repeat(~c.held, c.sizes))
                    features, paths = [f[at] for f in c.features(bits)], c.paths[c.tokens[at]]
                    used = used or len(at) > 0
                    for k in range(0, len(at), STEP):
                        rows, odds, bit = model.decisions(paths[k : k + STEP], [f[k : k + STEP] for f in features])
                        p, one = (1 / (1 + np.exp(-odds))).ravel(), (bit.astype(np.int64) << 32 | 1).ravel()
                        for r in rows:
                            np.add.at(few, r.ravel(), p)
                            if first:
                                np.add.at(observed, r.ravel(), one)
                        steps += 1
                        if steps % FLUSH == 0:  # a single-precision sum stays so small that no probability is lost in it
                            expected += few
                            few[:] = 0
            expected += few
            if used:
                for x, name in ((expected, 0), (observed, 1)):
                    for k in range(0, len(x), BLOCK):
                        part = x[k : k + BLOCK]
                        if name == 0:  # of a task's whole sum three digits are enough, and half the bytes
                            part = (part.astype(np.float32).view(np.uint32) + np.uint32(0x8000) & np.uint32(0xFFFF0000)).view(np.float32)
                        yield batch(schema, [2 * (k // BLOCK) + name], [task], [_pack(part.astype("<f8") if name == 0 else _split(part))])
            relieve()

        rows = corpus.select("docs", "tokens", "keys", "paths").mapInArrow(run, SUMS)
        got = summed(rows, tasks, "<f8")
        if not got:
            return model
        n = range(-(-size // BLOCK))
        if first:
            seen = np.concatenate([got[2 * k + 1].reshape(2, -1) for k in n], axis=1)
        expected = np.minimum(np.concatenate([got[2 * k] for k in n]), seen[1])
        odds = lambda x: np.log((x + smooth) / (seen[1] - x + smooth))
        step = (rate * (odds(seen[0]) - odds(expected))).astype(np.float32)
        model = Model(step if first else model.weights + step, bits, n_class)
    return model


def _split(both: np.ndarray) -> np.ndarray:
    """(went right, all) from one number of each."""
    return np.concatenate([both >> 32, both & 0xFFFFFFFF]).astype("<f8")


def weights(total: int) -> int:
    """Bits of the number of weights: it grows with the bytes of text, up to a table of 16 MB."""
    return int(min(22, max(18, int(total // 16).bit_length())))


def fit(docs: DataFrame, mod: int = 7, rest: int = 2, depth: int = 12, rounds: int = 2, rate: float = 0.4, smooth: float = 2.0, bits: int | None = None):
    """(corpus, replies, shards, model, tokens and words by class)."""
    spark, total = docs.sparkSession, text_bytes(docs)
    corpus = chunks(docs, total, depth, mod, rest)
    shards = int(max(12, total // (16 * MB)))
    asks = corpus.select("chunk", "words", "keys", "counts").mapInArrow(_ask(shards), ASKS)
    replies = table(asks.groupBy("shard").applyInArrow(_count(depth), REPLIES))
    n_class, v_class = class_counts(replies, depth)
    # a task's sums are as large as the table of weights: fewer tasks send fewer of them
    few = max(2 * spark.sparkContext.defaultParallelism, total // (256 * MB))
    model = train(corpus.coalesce(int(few)), n_class, bits or weights(total), rounds, rate, smooth)
    return corpus, replies, shards, model, n_class, v_class


def score(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; rows with crc32(id) mod `mod` = `rest` are held out."""
    corpus, replies, shards, model, n_class, v_class = fit(docs, **how)
    shared, schema = docs.sparkSession.sparkContext.broadcast((model, n_class, v_class)), arrow_schema(RESULT)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model, n_class, v_class = shared.value
        n, v = int(n_class.sum()), int(v_class.sum())
        answers = dict(zip(right.column("shard").to_pylist(), right.column("blob").to_pylist()))
        out = []
        for row in zip(*(left.column(c).to_pylist() for c in ("docs", "tokens", "keys", "paths"))):
            c = Chunk(*row)
            count = np.empty(len(c.keys), np.int64)
            for g in _by_shard(c.keys, shards):
                count[g] = _unpack(answers[int(c.keys[g[0]] % np.uint64(shards))], "<i8")
            base = np.log10((count + 1) / (n + v + 1))
            within = np.log10((count + 1) / (n_class[c.paths] + v_class[c.paths] + 1))
            each = within[c.tokens] + model.log10(c.paths[c.tokens], c.features(model.bits))
            at = np.cumsum(c.sizes) - c.sizes
            out.append(batch(schema, id_array(c.ids), c.held, c.sizes, np.add.reduceat((count > 0)[c.tokens].astype(np.int64), at), np.full(len(at), n),
                             np.add.reduceat(base[c.tokens], at), np.add.reduceat(each, at)))
        return pa.Table.from_batches(out, schema=schema)

    return (corpus.select("chunk", "docs", "tokens", "keys", "paths").groupBy("chunk")
            .cogroup(replies.where("chunk >= 0").select("chunk", "shard", "blob").groupBy("chunk")).applyInArrow(run, RESULT))
