"""Spelling variants, Yinyang clustering and suffix dedup against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import spelling, suffix_dedup, yinyang

EXTRA = ", lang string, key long, sub long, part long, word string, n long, cluster int, slice int, shard long, chunk long"


def frame(spark, rows):
    """Rows (doc_id, text) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "w", 4, 5, 6, 7, 8) for r in rows], "doc_id long, text string" + EXTRA).repartition(3)


# -- spelling ---------------------------------------------------------------


def plain_variants(rows, letters=6, least=5):
    counts = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w
            if len(w) >= letters:
                counts[w] += 1
    counts = {w: n for w, n in counts.items() if n >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out = {}
    for w, n in counts.items():
        others = [v for v in counts if v != w and near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form = best if best and counts[best] >= 5 * n else None
        out[w] = [form, w, n, len(others), counts[form] if form else None]
    for w in out:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return {w: tuple(v) for w, v in out.items()}


@pytest.fixture(scope="module")
def spelled():
    rng = np.random.default_rng(3)
    letters = list("abcdeilmnorstéßñ")
    base = ["".join(rng.choice(letters, 7)) for _ in range(12)]
    words = [b for b in base for _ in range(150)]
    for _ in range(250):
        b = list(base[rng.integers(12)])
        k = rng.integers(len(b))
        b[k : k + rng.integers(2)] = list(rng.choice(letters, rng.integers(3)))
        words += ["".join(b)] * int(rng.integers(4, 40))
    words += ["aaaaaa", "aaaaaaa", "aaaaaaaa"] * 6 + ["ColorÉ", "colorÉs", "x" * 3000, "x" * 3001, "x" * 2999 + "y"] * 6 + ["short"] * 50
    rng.shuffle(words)
    rows = [(k, " 1,".join(words[k::40])) for k in range(40)] + [(None, "aaaaaa. Aaaaaa"), (7, None), (8, ""), (9, "€你 ’ 12")]
    return rows + [rows[3]]


def test_spelling(spark, spelled):
    want = plain_variants(spelled)
    assert sum(v[0] is not None for v in want.values()) > 20 and any(v[0] != v[1] and v[0] for v in want.values())
    docs = frame(spark, spelled)
    for limit in (20_000, 12, 3):  # smaller ones split groups by sub-bands, then into blocks
        got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(docs, limit=limit).collect()}
        assert got == want
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, [(1, None), (2, "a b")])).count() == 0


def test_one_edit_flips_two_bits():
    """What the bands rest on."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        w = bytes(rng.choice(list(range(97, 123)) + list(range(192, 256)), 9).astype(np.uint8))
        k, c = int(rng.integers(9)), bytes([int(rng.integers(97, 123))])
        for v in (w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]):
            m = spelling.masks([w, v])
            assert sum(int(x).bit_count() for x in (m[0] ^ m[1])) <= 2 and (m[0] == m[1]).any()


def test_pairs_in_pieces():
    key, least = np.array([1, 1, 3, 3, 3, 3, 9]), np.array([True, False, True, True, False, False, True])
    got = [p for x, y in spelling.pairs_of(key, least, most=2) for p in zip(x.tolist(), y.tolist())]
    assert sorted(got) == [(0, 1), (2, 3), (2, 4), (2, 5), (3, 4), (3, 5)]


# -- clustering -------------------------------------------------------------


def lloyd(rows, k, rounds):
    x = np.array([[int(np.floor(64 * float(c))) for c in v] for _, v in rows], dtype=object)
    order = sorted(range(len(rows)), key=lambda r: (hashlib.sha256(f"1:{'' if rows[r][0] is None else rows[r][0]}".encode()).hexdigest(), rows[r][0] or 0, x[r].tolist()))
    c = [x[r] for r in order[:k]]
    for at in range(rounds + 1):
        dist = [[int(((v - m) ** 2).sum()) for m in c] for v in x]
        of = [min(range(len(c)), key=lambda j: (d[j], j)) for d in dist]
        if at < rounds:
            c = [np.array([sum(col) // len(col) for col in zip(*(x[r] for r in range(len(x)) if of[r] == j))], dtype=object) if j in of else c[j] for j in range(len(c))]
    near = [d[j] for d, j in zip(dist, of)]
    return [(rows[r][0], of[r], near[r], sum(n for n, j in zip(near, of) if j == of[r]), sum(near), hashlib.sha256(",".join(map(str, c[of[r]])).encode()).hexdigest()) for r in range(len(rows))]


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, point int").repartition(3)


@pytest.mark.parametrize("kind", ["clusters", "few values", "large"])
def test_yinyang(spark, kind):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(20, 64))
    x = {"clusters": middle[rng.integers(20, size=300)] + rng.normal(size=(300, 64)) * 0.1, "few values": rng.integers(0, 2, (300, 64)) * rng.integers(0, 2, (300, 1)), "large": rng.normal(size=(120, 64)) * 2.0**18}[kind].astype(np.float32)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    rows += [rows[5], rows[5], (None, rows[9][1])]
    bad = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [float("nan")] + [0.0] * 63), (905, [float("inf")] + [0.0] * 63), (906, [None] + [0.0] * 63)]
    got = yinyang.clustered(vectors(spark, rows + bad)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(lloyd(rows, 16, 3), key=str)


def test_yinyang_skips_distances(spark):
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(16, 64))[rng.integers(16, size=2000)] + rng.normal(size=(2000, 64)) * 0.05).astype(np.float32)
    state, _ = yinyang.assigned(vectors(spark, list(enumerate(x.tolist()))))
    assert state.groupBy().avg("scanned").first()[0] < 0.6 * 64  # without bounds: 16 in each of 4 rounds


def test_yinyang_small(spark):
    assert yinyang.clustered(vectors(spark, [])).count() == 0
    rows = [(3, [0.5] * 64), (1, [0.25] * 64)]
    assert sorted(map(tuple, yinyang.clustered(vectors(spark, rows)).collect())) == sorted(lloyd(rows, 16, 3))
    with pytest.raises(Exception, match="too large"):
        yinyang.clustered(vectors(spark, [(1, [1e9] * 64)])).count()


# -- suffixes ---------------------------------------------------------------


def plain_removal(rows, width=50):
    owner = {}
    for i, t in rows:
        if i is not None:
            for k in range(len(t) - width + 1):
                owner[t[k : k + width]] = min(owner.get(t[k : k + width], i), i)
    out = []
    for i, t in rows:
        gone = np.zeros(len(t) + 2, bool)
        for k in range(len(t) - width + 1):
            o = owner.get(t[k : k + width])
            if o is not None and (i is None or o < i):
                gone[k + 1 : k + width + 1] = True
        kept = bytes(b for b, g in zip(t, gone[1:].tolist()) if not g)
        out.append((i, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def repeated():
    rng = np.random.default_rng(8)
    text = lambda n, signs="abcdefgh é": "".join(rng.choice(list(signs), n))
    line, passage = "Please read the terms of use before you go on. Thank you!\n", text(300)
    rows = [(k, text(int(rng.integers(0, 200))) + (line if k % 3 else "") + text(60) + (passage[int(rng.integers(100)) : 300 - int(rng.integers(100))] if k % 4 == 0 else "")) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(6)] + [(200 + k, rows[7][1][: 90 + k] + "~" + rows[7][1][90 + k :]) for k in range(9)]
    rows += [(300, "a" * 20), (301, "a" * 900), (302, "a" * 2500), (303, "ab" * 700), (299, "ba" * 500), (304, line * 30), (305, text(40, "xy") * 40)]
    rows += [(306, None), (307, ""), (308, "a" * 49), (309, line[:49]), (None, passage), (None, rows[1][1]), (12, rows[1][1]), (1, rows[1][1])]
    return rows


@pytest.mark.parametrize("limits", [None, (1000, 400)])
def test_suffixes(spark, repeated, monkeypatch, limits):
    if limits:  # slices and frequent pieces
        monkeypatch.setattr(suffix_dedup, "SLICE", limits[0])
        pieces = suffix_dedup.frequent_pieces
        monkeypatch.setattr(suffix_dedup, "frequent_pieces", lambda corpus, total, limit: pieces(corpus, 1, 8))
    want = plain_removal([(i, (t or "").encode()) for i, t in repeated])
    got = suffix_dedup.remove_repeats(frame(spark, repeated))
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(9)
    assert suffix_dedup.difference_cover(13).tolist() == [0, 1, 3, 9]
    for width, signs, bucket in ((16, "ab", 40), (50, "ab", 1 << 20), (100, "abcdef", 100)):
        t = "".join(rng.choice(list(signs), 700))
        t = t + t[:400] + "a" * 200 + t[100:300] * 3
        at = np.sort(rng.choice(len(t) - width + 1, 900, replace=False))
        got, same = (np.concatenate(x) for x in zip(*suffix_dedup.SuffixOrder(np.frombuffer(t.encode(), np.uint8), width).buckets(at, bucket)))
        heads = [t[k : k + width] for k in got.tolist()]
        assert sorted(got.tolist()) == at.tolist() and heads == sorted(heads)
        assert same.tolist() == [k > 0 and heads[k] == heads[k - 1] for k in range(len(heads))]
