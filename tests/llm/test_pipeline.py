import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline
from tessera.llm import simhash

from test_operators import PASSAGE, SCHEMA, TEXTS

OTHER = "Der Hund und die Katze laufen durch den Garten und schlafen dann im Haus neben dem Ofen"
ROWS = [(k * 3 + 1, t, "en" if k % 2 else "de", "s", 1, 5, "c", None) for k, t in enumerate([*TEXTS, OTHER, OTHER, OTHER + " ein", "12 34 ??", None])]
ITEMS = [(1, PASSAGE), (2, "entirely other words that no document holds at all anywhere"), (3, None)]


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def expected():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = {r[0]: r[1] for r in ROWS if r[1] and any(c.isalpha() for c in r[1])}
    last = {t: i for i, t in sorted(docs.items())}  # of equal texts the largest id
    docs = {i: t for t, i in last.items()}
    prints = {i: simhash.fingerprint(t.encode()) for i, t in docs.items()}
    group = {i: i for i in docs}
    for _ in docs:
        for i in docs:
            for j in docs:
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    out = set()
    for i, t in docs.items():
        if group[i] == i and PASSAGE not in t:
            ids = np.array(enc.encode_ordinary(t), "<u4").tobytes()
            out.add((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return out


def test_pipeline(spark, tmp_path):
    got = corpus_pipeline.run(spark, write(spark, tmp_path, ROWS)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    want = expected()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, [])).count() == 0


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns(spark, tmp_path, k):
    folder = write(spark, tmp_path, ROWS)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.STAGES[k][1](spark, docs, folder).columns == corpus_pipeline.COLUMNS


def test_ids_name_no_row(spark, tmp_path):
    """Null and repeated ids: rows with different texts all stay, of equal texts one does."""
    words = [[f"{a}{b}{c}" for b in "aeiou" for c in "klmnp"] for a in "bdfgh"]
    texts = [" ".join(w) for w in words]
    rows = [(i, t, "en", "s", 1, 5, "c", None) for i, t in [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (2, texts[4]), (2, texts[4]), (None, texts[4]), (1, f"x {PASSAGE}"), (None, PASSAGE)]]
    folder = write(spark, tmp_path, rows)
    got = corpus_pipeline.run(spark, folder).collect()
    want = [(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (2, texts[4])]]
    assert sorted(((r["doc_id"], r["decoded_sha256"]) for r in got), key=str) == sorted(want, key=str)


def test_no_labels(spark, tmp_path):
    """Nothing to learn a language from: documents with letters stay."""
    folder = write(spark, tmp_path, [(k, t, None, "s", 1, 5, "c", None) for k, t in enumerate(["some words", "12 ??", None, "andere Worte"])])
    assert {r["doc_id"] for r in corpus_pipeline.identify_language(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()} == {0, 3}


def test_without(spark):
    from pyspark.sql import functions as F

    from tessera.llm import common

    rows = common.numbered(spark.range(1000).repartition(7).select("id", F.lit("x").alias("text")))
    gone = rows.where("id % 3 = 0 or id < 50").select("uid")
    assert {r["id"] for r in common.without(rows, gone.union(gone)).collect()} == {k for k in range(50, 1000) if k % 3}
    assert common.without(rows, gone.limit(0)).count() == 1000
