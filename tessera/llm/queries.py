"""One query per operator, over its whole table, and the SQL that checks those SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, language_id, lm, shards, simhash, spelling, substring_dedup, suffix_dedup, token_files, warc, yinyang


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op8_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards.compacted(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("text_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(_table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.clustered(_table(spark, sf_dir, "embeddings"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _lloyd_sql(k: int = 16, rounds: int = 3) -> str:
    """Plain rounds over all distances."""
    steps = [f"""p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM p QUALIFY c < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT vec_id, v, c, dist FROM (SELECT p.vec_id, p.v, c.c, list_sum(list_transform(range(1, 65), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))) AS dist FROM p, c{r} c)
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, c) = 1)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS v
        FROM (SELECT c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY c, i) GROUP BY c),
        c{r + 1} AS (SELECT old.c, coalesce(m.v, old.v) AS v FROM c{r} old LEFT JOIN m{r} m ON m.c = old.c)""")
    return f"""WITH {", ".join(steps)}
        SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.dist AS BIGINT) AS distance, CAST(sum(a.dist) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.dist) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(list_transform(c.v, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c"""


QUERIES = {f.__name__: f for f in (op1_token_files, op2_substring_dedup, op3_decontaminate, op4_simhash, op5_byte_bpe, op6_lm_score, op7_language_id, op8_compaction, op9_exact_dedup, op10_warc, op11_spelling_variants, op12_yinyang, op13_suffix_dedup, pipeline)}

ORACLE_SQL = {
    "op2_substring_dedup": r"""
        WITH words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k, len(w) AS n
                       FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)),
        v AS (SELECT doc_id, k, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS win FROM words),
        o AS (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY win) AS owner FROM v WHERE k + 12 <= n),
        gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS k FROM o WHERE owner < doc_id),
        kept AS (SELECT words.doc_id, count(*) AS n, count(gone.k) AS r, string_agg(word, ' ' ORDER BY words.k) FILTER (gone.k IS NULL) AS t
                 FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.k = words.k GROUP BY words.doc_id)
        SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op8_compaction": """
        SELECT doc_id, lang, source, n_chars, CAST(octet_length(encode(text)) AS BIGINT) AS text_bytes, sha256(text) AS text_sha256 FROM documents""",
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op11_spelling_variants": r"""
        WITH RECURSIVE runs AS (SELECT CAST(doc_id AS VARCHAR) AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
        each AS (SELECT id, w, count(*) AS n FROM runs GROUP BY id, w),
        parts AS MATERIALIZED (SELECT DISTINCT w, hex(encode(w)) AS x FROM each),
        heads AS (SELECT DISTINCT id, hex(encode(id || ':')) AS x FROM each),
        -- crc32, a bit at a time: the register after the id, then what a word makes of it, a sum without carry of both
        start AS (SELECT id, list_reduce(list_prepend(4294967295, list_transform(range(0, 4 * len(x)), lambda k: CAST(((ascii(x[2 * (k // 8) + 2 - (k % 8) // 4]) - CASE WHEN x[2 * (k // 8) + 2 - (k % 8) // 4] >= 'A' THEN 55 ELSE 48 END) >> (k % 4)) & 1 AS BIGINT))),
                  lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))) AS c FROM heads),
        bits AS MATERIALIZED (SELECT w, list_transform(range(0, 4 * len(x)), lambda k: CAST(((ascii(x[2 * (k // 8) + 2 - (k % 8) // 4]) - CASE WHEN x[2 * (k // 8) + 2 - (k % 8) // 4] >= 'A' THEN 55 ELSE 48 END) >> (k % 4)) & 1 AS BIGINT)) AS b FROM parts),
        hashed AS (SELECT e.w, e.n, xor(list_reduce(list_prepend(s.c, bits.b), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) AS h
                   FROM each e JOIN start s ON s.id = e.id JOIN bits ON bits.w = e.w),
        cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM hashed),
        words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
        near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
                 UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
        best AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, other_n FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) = 1),
        forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 5 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 5 * w.n THEN b.other_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
        walk AS (SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN forms f ON f.word = walk.next)
        SELECT f.word, f.form, walk.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM forms f JOIN walk ON walk.word = f.word AND walk.next IS NULL""",
    "op12_yinyang": _lloyd_sql(),
    "op13_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
        w AS (SELECT doc_id, k, substr(x, 2 * k + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS k FROM d)),
        o AS (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY s) AS owner FROM w),
        l AS (SELECT doc_id, k, k - lag(k, 1, -100) OVER (PARTITION BY doc_id ORDER BY k) > 50 AS new FROM o WHERE owner < doc_id),
        r AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS b FROM (SELECT doc_id, k, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM l) GROUP BY doc_id, run),
        g AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS p, a AS q, b - a AS gone, 1 AS span FROM r
              UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(d.n), 0, 0 FROM d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id)
        SELECT d.doc_id, d.n AS n_bytes, CAST(sum(gone) AS BIGINT) AS n_removed, CAST(sum(span) AS BIGINT) AS n_spans, sha256(unhex(string_agg(substr(d.x, 2 * g.p + 1, 2 * (g.q - g.p)), '' ORDER BY g.p))) AS kept_sha256
        FROM d JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id, d.n""",
    "op10_warc": """
        WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f""",
}
