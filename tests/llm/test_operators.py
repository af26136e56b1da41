import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from tessera.llm import bpe, common, decontaminate, exact_dedup, language_id, lm, shards, simhash, substring_dedup, token_files, warc

PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
TEXTS = [PASSAGE, "Intro words " + PASSAGE + " and a tail", "", None, "x", " ", "x", "à 你好 <|endoftext|> 's  don't\n\n\tÉté", "abc " * 3000, PASSAGE + " more", "z" * 700 + "   12 34", "the of and in " * 5]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, chunk string, rep string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k * 3 + 1, t, "en" if k % 2 else "de", "s", 1, 5, "c", None) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


PAIRS = [(k * 3 + 1, t or "") for k, t in enumerate(TEXTS)]


def test_exact(spark, docs, empty):
    got = by_id(exact_dedup.exact_groups(docs, limit=64))  # a tiny limit splits prefixes
    for i, t in PAIRS:
        same = [j for j, u in PAIRS if u == t]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (max(same), len(same), i == max(same), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_groups(empty).count() == 0
    twice = exact_dedup.exact_groups(docs.unionByName(docs))
    assert twice.where("kept").count() == len({t for _, t in PAIRS})


def plain_fingerprint(text):
    """Bit by bit, from the definition."""
    import re

    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()))
    pieces = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64(p, seed=42).intdigest() for p in pieces]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hs) * 2 > len(hs)) if hs else 0


def test_simhash(docs, empty):
    got = by_id(simhash.near_groups(docs))
    prints = {i: plain_fingerprint(t) for i, t in PAIRS}
    group = {i: i for i in prints}
    for _ in prints:
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{prints[i]:016x}", group[i]) for i in prints}
    assert simhash.near_groups(empty).count() == 0
    assert len(simhash.triples()) == 20


def test_forest_blocks():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 1, dtype=np.uint64)[0]
    fps = np.unique([base ^ np.uint64(1 << int(k)) for k in rng.integers(0, 60, 50)])
    a, b = simhash.forest(fps, np.arange(len(fps)), 4, 4, block=8)
    assert len(a) == len(fps) - 1 and set(b.tolist()) == {0}


def test_substring(docs, empty):
    got = by_id(substring_dedup.remove_repeats(docs))
    words = {i: t.encode().split() for i, t in PAIRS}
    owner = {}
    for i, ws in sorted(words.items(), reverse=True):
        for k in range(len(ws) - 12):
            owner[tuple(ws[k : k + 13])] = i
    for i, ws in words.items():
        gone = {k + j for k in range(len(ws) - 12) if owner[tuple(ws[k : k + 13])] < i for j in range(13)}
        kept = b" ".join(w for k, w in enumerate(ws) if k not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(ws), len(gone), hashlib.sha256(kept).hexdigest())
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_substring_periodic(spark):
    """Texts of equal or alternating words, of different lengths: every word but the smallest document's recurs; finds are kept as runs."""
    rows = [(k, "a " * (4000 - 60 * k)) for k in range(12)] + [(50 + k, "b c " * (900 + 7 * k) + "d") for k in range(4)] + [(90, "c b " * 20 + "e")]
    got = by_id(substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)))
    words = {i: t.split() for i, t in rows}
    owner = {}
    for i, ws in sorted(words.items(), reverse=True):
        owner |= {tuple(ws[k : k + 13]): i for k in range(len(ws) - 12)}
    for i, ws in words.items():
        gone = {k + j for k in range(len(ws) - 12) if owner[tuple(ws[k : k + 13])] < i for j in range(13)}
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(ws), len(gone))
        assert got[i]["kept_sha256"] == hashlib.sha256(" ".join(w for k, w in enumerate(ws) if k not in gone).encode()).hexdigest()


def test_substring_hot(spark, monkeypatch):
    """A frequent phrase, split by window hash: the same answer as brute force, in more than one shard."""
    rng = np.random.default_rng(7)
    phrase = "one two three"
    texts = [" ".join(w for _ in range(12) for w in (*(f"w{k}" for k in rng.integers(40, size=6)), phrase)) for _ in range(60)] + [" ".join([PASSAGE] * 3), PASSAGE]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    corpus = substring_dedup.packed(docs, 10_000)
    hot = substring_dedup.hot_minimisers(corpus, 10_000, 13, 1_000)
    assert 0 < len(hot) < 200
    monkeypatch.setattr(substring_dedup, "hot_minimisers", lambda *a: hot)
    got = by_id(substring_dedup.remove_repeats(docs))
    words = {i: t.encode().split() for i, t in enumerate(texts)}
    owner = {}
    for i, ws in sorted(words.items(), reverse=True):
        owner |= {tuple(ws[k : k + 13]): i for k in range(len(ws) - 12)}
    for i, ws in words.items():
        gone = {k + j for k in range(len(ws) - 12) if owner[tuple(ws[k : k + 13])] < i for j in range(13)}
        kept = b" ".join(w for k, w in enumerate(ws) if k not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(ws), len(gone), hashlib.sha256(kept).hexdigest())


def test_bpe(docs, empty):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.encode_and_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
    for i, t in PAIRS:
        ids = np.array(enc.encode_ordinary(t), "<u4").tobytes()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert bpe.encode_and_decode(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok, start = Tokenizer.from_file(path), 0
    got = by_id(token_files.write_and_read(docs, path, shard_bytes=4096))
    for i, t in PAIRS:
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.write_and_read(empty, path).count() == 0


def test_language(docs, empty, spark):
    rows = [(k, "the cat and the dog of house" if k % 2 else "der hund und die katze", "en" if k % 2 else "de") for k in range(60)] + [(100, "12 ??", "en"), (101, None, "en")]
    got = by_id(language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:60]) and got[100]["lang_pred"] == got[101]["lang_pred"] == "und"
    assert language_id.identify(empty).count() == 0


def test_lm(docs, empty):
    got = by_id(lm.score(docs, bits=10, depth=5))
    tokens = {i: [w for w in t.encode().translate(simhash.LOWER).split()] + [b"\n"] for i, t in PAIRS}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    count = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert np.isclose(r["base_score"], sum(np.log10((count[w] + 1) / (n + v + 1)) for w in ws)) and r["score"] < 0
    assert lm.score(empty, bits=10, depth=5).count() == 0


def test_leaks(spark, docs, empty):
    items = spark.createDataFrame([(1, PASSAGE), (2, "entirely other words that no document holds at all anywhere"), (3, None)], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()) == [(1, 1), (4, 1), (28, 1)]
    assert decontaminate.leaks(empty, items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.lcs(list("abcde"), list("axbxe")) == 3


def _model(spark, texts, **how):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    return lm.fit(frame, **how)


def test_lm_trigrams(spark):
    """A word that the two before it tell only together."""
    rng = np.random.default_rng(2)
    texts = [" ".join(w for a, b in rng.integers(2, size=(200, 2)) for w in (f"l{a}", f"r{b}", ("aa", "zz")[a ^ b])) for _ in range(60)]
    model = _model(spark, texts, rounds=6)[3]
    row = lm.make_chunk(0, np.arange(60), [t.encode() for t in texts], 12, 7, 2)
    c = lm.Chunk(row[1], row[2], row[4], row[5])
    told = np.flatnonzero(np.repeat(c.held, c.sizes) & (c.tokens != 0) & (np.arange(len(c.tokens)) % 601 % 3 == 2))
    p = model.log10(c.paths[c.tokens[told]], [f[told] for f in c.features(model.bits)])
    assert len(told) > 200 and p.mean() / np.log10(2) > -0.5  # a coin has -1


def test_lm_sums_to_one(spark):
    """Over all known words and the unknown one of each class, after any history."""
    texts = ["the cat sat on the mat and the dog ran", "a dog and a cat ran on the mat", "some other words"] * 4
    _, _, _, model, n_class, v_class = _model(spark, texts, depth=6, bits=9)
    words = sorted({w for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 7 != 2 for w in t.encode().split()} | {lm.END})
    count = Counter(w for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 7 != 2 for w in [*t.encode().split(), lm.END])
    assert n_class.sum() == sum(count.values()) and v_class.sum() == len(words)
    row = lm.make_chunk(0, np.arange(1), [texts[0].encode()], 6, 7, 2)
    c = lm.Chunk(row[1], row[2], row[4], row[5])
    leaf = lm.paths_of(words, lm.hashes(words, 1), 6).astype(np.int32)
    within = np.array([count[w] + 1 for w in words]) / (n_class[leaf] + v_class[leaf] + 1)
    for k in range(len(c.tokens)):
        after = lambda n: [np.full(n, f[k], np.int32) for f in c.features(model.bits)]  # noqa: E731, B023
        known = (10 ** model.log10(leaf, after(len(leaf))) * within).sum()
        every = np.arange(64, dtype=np.int32)
        unknown = (10 ** model.log10(every, after(64)) / (n_class + v_class + 1)).sum()
        assert np.isclose(known + unknown, 1, atol=1e-5)


def test_lm_held_out_gain(spark):
    """Better than the unigram base on documents not learned from, and the same however the rows lie."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = [lm.score(docs.repartition(n)).where("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first() for n in (4, 64)]
    per = [(r["sum(score)"] / r["sum(n_tokens)"], r["sum(base_score)"] / r["sum(n_tokens)"]) for r in got]
    assert per[0][0] > per[0][1] + 0.05 and abs(per[0][0] - per[1][0]) < 0.002


@pytest.mark.parametrize("copies", [0, 60])
def test_leaks_paraphrased(spark, copies):
    """Paraphrases that swap an item's rarest words, with and without many copies of it, against LCS brute force."""
    rng = np.random.default_rng(4)
    common, texts = [f"c{k}" for k in range(400)], {}
    items = {q: [w for k in range(12) for w in (f"r{q}x{k}", common[rng.integers(400)])] for q in range(3)}

    def write(words=()):
        texts[len(texts)] = " ".join([*(f"f{k}" for k in rng.integers(4000, size=20)), *rng.choice(common, 4), *words, *(f"f{k}" for k in rng.integers(4000, size=20))])

    for _ in range(400):
        write()
    for _ in range(copies):
        write(items[0])
    for q, ws in items.items():
        for _ in range(8):
            gone = set((2 * rng.choice(12, 6, replace=False)).tolist())
            write([f"n{rng.integers(10**6)}" if k in gone else w for k, w in enumerate(ws)])
    want = {(d, q) for d, t in texts.items() for q, ws in items.items() if decontaminate.lcs(ws, t.split()) >= 0.75 * len(ws)}
    found = decontaminate.leaks(spark.createDataFrame(list(texts.items()), "doc_id long, text string"),
                                spark.createDataFrame([(q, " ".join(ws)) for q, ws in items.items()], "item_id long, text string"))
    assert len(want) >= 24 + copies and {(r["doc_id"], r["item_id"]) for r in found.collect()} == want


def test_leaks_of_long_items(spark):
    """A leak of 64 words across a cut, and one of an item's last 64."""
    words = [f"w{k}" for k in range(150)]
    docs = spark.createDataFrame([(1, " ".join(words[32:96])), (2, " ".join(words[-64:])), (3, " ".join(words[48:112])), (4, " ".join(words[10:40]))], "doc_id long, text string")
    found = decontaminate.leaks(docs, spark.createDataFrame([(7, " ".join(words))], "item_id long, text string"))
    assert {r["doc_id"] for r in found.collect()} == {1, 2, 3}


def test_compaction(spark, docs, empty):
    assert shards.compacted(docs).count() == len(TEXTS)
    store = shards.ShardStore(spark, fanout=2)
    assert store.read().count() == 0 and store.append(empty) == 1 and store.read().columns == empty.columns
    assert store.append(docs) == 2 and store.append(docs) == 3 and store.append(empty) == 3 and store.compact() == 4
    assert store.read().count() == 2 * len(TEXTS) and store.read(2).count() == len(TEXTS) and len(store.runs()) == 1
    store.vacuum()
    assert store.read().count() == 2 * len(TEXTS)
    assert shards.compacted(empty).count() == 0
    with pytest.raises(ValueError):
        store.append(docs.drop("lang"))


def test_compaction_tiers(spark):
    """`fanout` runs a merge, tiers by size: 16 equal arrivals become 4 of the next tier, then one of the one after."""
    store = shards.ShardStore(spark, fanout=4, base=200, target=1 << 20)
    rows = spark.range(64).selectExpr("id as doc_id", "array_join(transform(sequence(1, 100), x -> sha2(string(id * 1000 + x), 256)), '') as text")
    store.append_many(rows.withColumn("a", rows.doc_id % 16), "a")
    before = {store.tier(r) for r in store.runs()}
    assert len(before) == 1 and store.compact() == 1 + 5 and len(store.runs()) == 1 and store.tier(store.runs()[0]) > max(before)
    assert store.read().count() == 64


def test_compaction_writers(spark, docs):
    """Appends and a merge by others between a writer's read and its commit: no row is lost."""
    store = shards.ShardStore(spark, fanout=2)
    rival = shards.ShardStore(spark, store.folder, fanout=2)
    commit, rivals = store.log.commit, [lambda: rival.append(docs), lambda: rival.append(docs), rival.compact]

    def late(entries, after):
        if rivals:
            rivals.pop(0)()
        return commit(entries, after)

    store.log.commit = late
    store.append(docs)  # overtaken by both appends and the merge
    assert not rivals and store.read().count() == 3 * len(TEXTS)
    rivals[:] = [lambda: rival.append(docs), rival.compact]
    store.compact()
    assert store.read().count() == 4 * len(TEXTS) and rival.read().count() == 4 * len(TEXTS)


def test_compaction_clashes(spark):
    rows = spark.createDataFrame([(1, "a", 9, "m", "p"), (None, None, None, None, None), (1, "a", 9, "m", "p")], "doc_id long, shard string, manifest_version int, _metadata string, path string")
    got = shards.compacted(rows)
    assert got.columns == [*rows.columns, "shard_1", "manifest_version_1"]
    assert Counter(map(tuple, got.select(rows.columns).collect())) == Counter(map(tuple, rows.collect()))


def test_warc(spark):
    body = "<p>" + "same " * 40
    rows = [(3, "http://b.example.com/x", body), (1, "http://a.example.com:80/y#f", body), (2, None, "short"), (4, "http://z.org/", "short"), (5, "http://z.org/é", None), (6, "http://b.example.com/x", "\r\n\r\n" + body)]
    folder, manifest = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), part_bytes=64, block=1)
    got = by_id(warc.read(spark, folder, manifest), "page_id")
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {i: ("response", None) if i != 3 else ("revisit", 1) for i in range(1, 7)}
    assert all(got[i]["payload_digest"] == hashlib.sha256((t or "").encode()).hexdigest() and got[i]["payload_bytes"] == len((t or "").encode()) for i, _, t in rows)
    assert {r[0] for r in warc.look_up(folder, manifest, "com,example,b)/x")} == {3, 6}
    assert warc.write_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_copies(spark):
    body = "<p>" + "copy " * 40
    rows = [(k, f"http://h.example/{k % 3}", body) for k in range(9, 2, -1)] + [(5, "http://h.example/2", body), (3, "http://h.example/0", body), (None, None, body), (None, "http://n.org", "y" * 200), (7, "http://h.example/1", "z" * 5_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.write_and_read(pages, part_bytes=300).collect())
    n = len(body)
    assert got == Counter([(k, "revisit", 3, n) for k in (4, 5, 5, 6, 7, 8, 9, None)] + [(3, "response", None, n)] * 2 + [(None, "response", None, 200), (7, "response", None, 5_000_000)])
    from pyspark.sql import functions as F

    thin = pages.select("page_id", F.lit("k").alias("key"), F.sha2("html", 256).alias("digest"))
    ways = [sorted(map(str, warc.revisits(thin, len(rows), hot).collect())) for hot in (1, 2_000)]  # joined by digest, broadcast
    assert ways[0] == ways[1] and len(ways[0]) == 7


def test_sums_and_match():
    rng = np.random.default_rng(5)
    rows, which, size = rng.random((50, 3)), rng.integers(50, size=400), rng.integers(1, 9, size=40)
    start = np.cumsum(size) - size
    assert np.allclose(decontaminate.sums(rows, which, start, size), [rows[which[a : a + n]].sum(0) for a, n in zip(start, size)])
    for _ in range(50):
        query, region = rng.integers(12, size=int(rng.integers(2, 20))).tolist(), rng.integers(20, size=80)
        held = np.isin(region, query)
        q, width, step = decontaminate.Query(1, query), len(query) + max(3, len(query) // 4), max(1, len(query) // 8)
        want = (0.0, 0.0)
        for x in range(0, max(1, len(region) - width + step), step):
            part = [w for w in region[x : x + width].tolist() if w in query]
            tail = query[-max(2, len(query) // 4) :]
            if len(part) / len(query) >= 0.3:
                want = max(want, (decontaminate.lcs(query, part) / len(query), decontaminate.lcs(tail, part) / len(tail)))
        assert q.match(region, held, 0.3) == want


def test_null_ids_and_repeats(spark):
    """Every operator over documents: a row for each row, whatever ids are null or repeated; null ids come back null."""
    rows = [(None, PASSAGE), (None, PASSAGE), (None, "other words here"), (5, PASSAGE + " x"), (5, PASSAGE + " x"), (5, "another text"), (7, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    path, merges = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
    for f in (lambda d: token_files.write_and_read(d, path), substring_dedup.remove_repeats, simhash.near_groups, lambda d: bpe.encode_and_decode(d, merges, P.PATTERN),
              lambda d: lm.score(d, bits=9, depth=4), language_id.identify, exact_dedup.exact_groups):
        got = f(docs).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    # null ids own nothing and lose what others own
    removed = sorted((r["doc_id"] or 99, r["n_removed"]) for r in substring_dedup.remove_repeats(docs).collect() if r["n_words"] > 12)
    assert removed == [(5, 0), (5, 0), (99, 15), (99, 15)]
    kept = [r for r in exact_dedup.exact_groups(docs).collect() if r["kept"]]
    assert len(kept) == 5 and {r["keep_id"] for r in kept} == {None, 5, 7}
    items = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (None, None)], "item_id long, text string")
    assert sorted((r["doc_id"] or 99, r["item_id"]) for r in decontaminate.leaks(docs, items).collect()) == [(5, 1), (99, 1)]


def test_language_held_out(spark):
    """Held-out accuracy over whole documents, and unknown words told by their n-grams."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    got = docs.select("doc_id", "lang").join(language_id.identify(docs), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert len(got) > 100 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    model = {"langs": ["de", "en"], "prior": [1, 1], "words": (["haus"], np.array([[9, 0]])), "grams": (["ing", " t", "u"], np.array([[0, 9], [1, 8], [5, 1]])), "longest": 5}
    s = language_id.Scorer(model)
    assert s.predict("Haus")[0] == "de" and s.predict("thinging")[0] == "en" and s.predict("qqu")[0] == "de" and s.predict("12")[0] == "und"


def test_samples(spark):
    """A rare language is learned whole beside a frequent one; shares far under a millionth still find rows."""
    rows = spark.range(3000).selectExpr("id as doc_id", "if(id % 300 = 1, 'rara avis', 'common words') as text", "if(id % 300 = 1, 'xx', 'en') as lang")
    model = language_id.learn(rows, sample=100, least=1)
    assert model["langs"] == ["en", "xx"] and model["prior"] == [2990, 10]
    words, counts = model["words"]
    assert counts[words.index("avis")].tolist() == [0, 10] and 50 <= counts[words.index("common")][0] <= 140
    assert language_id.shares({"a": 3, "b": 1000, "c": 1000}, 103) == {"a": 1.0, "b": 0.05, "c": 0.05}
    found = common.sampled(spark.range(20_000_000), "id", 4e-7, 7).count()
    assert 0 < found < 30


def test_language_counts_all_rows(spark):
    """Counts are those of all rows, however many: words, n-grams and the cuts by frequency as from plain counters."""
    texts = [("en", "The House"), ("de", "das Haus ß"), ("en", "a über-house 7x"), ("xx", "12 34"), ("el", "ΟΔΟΣ 你好")]
    rows = [(k, f"{texts[k % 5][1]} w{chr(97 + k % 23)}{chr(97 + k % 19)}", texts[k % 5][0]) for k in range(25_000)] + [(None, "gone", "en"), (1, None, "en"), (2, "gone", None)]
    want = Counter()
    for i, text, lang in rows:
        if None not in (i, text, lang):
            for w in language_id.WORD.findall(text.lower()):
                want[0, w, lang] += 1
                want.update((n, g, lang) for n in range(1, 6) for g in language_id.grams(w, n))
    total = Counter()
    for (n, g, _), c in want.items():
        total[n, g] += c
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    for most_words, most_grams in ((10_000, 10_000), (50, 333)):
        model = language_id.learn(docs, most_words=most_words, most_grams=most_grams)
        assert model["langs"] == ["de", "el", "en", "xx"] and model["prior"] == [5000, 5000, 10_000, 5000]
        for name, most, kinds in (("words", most_words, {0}), ("grams", most_grams, set(range(1, 6)))):
            best = sorted((k for k in total if k[0] in kinds and total[k] >= 3), key=lambda k: (-total[k], k[0], k[1].encode()))[:most]
            got, counts = model[name]
            assert Counter(got) == Counter(g for _, g in best)
            assert sorted(zip(got, counts.tolist())) == sorted((g, [want[n, g, x] for x in model["langs"]]) for n, g in best)


def test_cut_words():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abé你𝔘"), n)) for n in rng.integers(1, 9, 300)]
    owners, counts, want = rng.integers(0, 3, 300), rng.integers(1, 2**50, 300) // 300, Counter()
    for w, o, c in zip(words, owners.tolist(), counts.tolist()):
        for n in range(1, 6):
            for g in language_id.grams(w, n):
                want[n, o, g] += c
    got = [(n, o, g, c) for n, os, gs, cs in language_id.cut_words(words, owners, counts, 5) for o, g, c in zip(os.tolist(), gs.tolist(), cs.tolist())]
    assert len(got) == len(want) and {k[:3]: k[3] for k in got} == want


def test_long_pieces():
    """One matrix over many rows gives what the library gives."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng, mine = np.random.default_rng(6), bpe.ByteBPE(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for n in (257, 300, 1000, 2500):
        for letters in ("a", "ab", "etaoinshrdlu", "thequickbrownfoxjumpsoverthelazydog"):
            piece = "".join(rng.choice(list(letters), n))
            for width in (2, 7, 256):
                assert mine.merge_long(piece.encode(), width) == enc.encode_ordinary(piece)
