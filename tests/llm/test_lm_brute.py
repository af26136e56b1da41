"""The whole of LM scoring against loops over single tokens and tree levels."""

import math
import zlib
from collections import Counter

import numpy as np
import xxhash

from tessera.llm import lm

M = (1 << 64) - 1


def mix(x):
    x &= M
    x ^= x >> 31
    x = x * 0x7FB5D329728EA185 & M
    x ^= x >> 27
    x = x * 0x81DADEF4BC2DD44D & M
    return x ^ x >> 33


def plain(rows, depth=12, rounds=2, rate=0.4, smooth=2.0, bits=18):
    end = "\n"
    docs = []
    for i, text in rows:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        docs.append((i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, [*words, end.encode()]))
    counts = Counter(w for _, held, ws in docs if not held for w in ws)
    total, known = sum(counts.values()), len(counts)
    key = lambda w: xxhash.xxh64_intdigest(w, 1)

    def leaf(w):
        two = lambda a, b, seed: mix((a | b << 8) + seed) & 7
        x = two(w[max(len(w) - 2, 0)], w[-1], 5) << 9 | two(w[0], w[min(1, len(w) - 1)], 9) << 6 | key(w) & 63
        return x >> 12 - depth

    n, v = Counter(), Counter()
    for w, c in counts.items():
        n[leaf(w)] += c
        v[leaf(w)] += 1
    tree = [0.0] * (2 << depth)
    for k in range(1 << depth):
        tree[(1 << depth) + k] = n[k] + 1.0
    for k in range((1 << depth) - 1, 0, -1):
        tree[k] = tree[2 * k] + tree[2 * k + 1]
    weights: dict = {}

    def steps(ws, at):
        """(weights, log odds, decision) of every level."""
        one, two = (key(ws[at - 1]) if at else key(end.encode())), (key(ws[at - 2]) if at > 1 else key(end.encode()))
        features = [x >> 64 - bits for x in (mix(one + 11), mix(two + 22), mix(one * 3 + mix(two)))]
        node = 1
        for level in range(depth):
            bit = leaf(ws[at]) >> depth - 1 - level & 1
            used = [f ^ (mix(node + 77) >> 64 - bits) for f in features]
            yield used, math.log(tree[2 * node + 1] / tree[2 * node]) + sum(weights.get(u, 0.0) for u in used), bit
            node = 2 * node + bit

    for _ in range(rounds):
        right, every, expected = Counter(), Counter(), Counter()
        for ws in (ws for _, held, ws in docs if not held):
            for at in range(len(ws)):
                for used, odds, bit in steps(ws, at):
                    for u in used:
                        right[u] += bit
                        every[u] += 1
                        expected[u] += 1 / (1 + math.exp(-odds))
        odds = lambda x, u: math.log((x + smooth) / (every[u] - x + smooth))
        moved = {u: weights.get(u, 0.0) + rate * (odds(right[u], u) - odds(min(expected[u], every[u]), u)) for u in every}
        weights = moved
    out = {}
    for i, held, ws in docs:
        base = sum(math.log10((counts[w] + 1) / (total + known + 1)) for w in ws)
        score = 0.0
        for at, w in enumerate(ws):
            score += math.log10((counts[w] + 1) / (n[leaf(w)] + v[leaf(w)] + 1))
            score -= sum(math.log10(1 + math.exp(-odds if bit else odds)) for _, odds, bit in steps(ws, at))
        out[i] = (held, len(ws), sum(counts[w] > 0 for w in ws), total, base, score)
    return out


def test_score_is_the_models(spark):
    rng = np.random.default_rng(2)
    words = ["the", "a", "Cat", "dog", "ran", "sat", "on", "mat", "é", "x", "running", "cats"]
    rows = [(k, " ".join(words[int(min(rng.exponential(3), 11))] for _ in range(int(rng.integers(1, 25))))) for k in range(30)] + [(100, None), (101, ""), (None, "the cat sat"), (103, "unseen words here the end")]
    want = plain(rows)
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bits=18).collect()
    assert len(got) == len(rows) and any(r["held_out"] for r in got)
    for r in got:
        held, n, known, total, base, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert abs(r["base_score"] - base) < 1e-6 and abs(r["score"] - score) < 0.01 * abs(score), (r, score)
