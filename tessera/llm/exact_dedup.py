"""Exact dedup by distributed MSD radix partitioning.

1. Each scan task groups its own texts by successive bytes, so that copies within
   an Arrow batch become one representative; a hot text leaves a batch once.
2. The driver extends, byte depth by byte depth, only those prefixes whose
   representatives are still too large for one task (`limit`); it never sees more
   prefixes than total / limit.
3. Representatives are dealt by leaf prefix and each task goes on with the
   following bytes until its groups are singletons or ended: members of a group
   are then equal byte by byte; no digest decides equality.
4. Members take their group's answer by a join on their representative's number;
   where only the rows that stay are wanted (`survivors`), the tasks of 3 return them.

Null text counts as empty. Null doc_id is below every id. Of fully repeated rows
one stays. An empty table gives an empty result; other columns are ignored, or carried where asked for.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import MB, arrow_schema, batch, relieve, table, tune

LOCAL = "uid long, doc_id long, rep long, text_sha256 string, n long, text binary"
GROUPS = "rep long, keep_id long, keep_uid long, group_size long"


def radix_groups(texts: list[bytes], digit: int = 8) -> list[list[int]]:
    """Positions of equal texts. Splits by `digit` bytes, twice as many at each further depth."""
    done, open_ = [], [(list(range(len(texts))), 0, digit)] if texts else []
    while open_:
        members, at, width = open_.pop()
        if len(members) == 1:
            done.append(members)
            continue
        parts: dict[bytes, list[int]] = {}
        for m in members:
            parts.setdefault(texts[m][at : at + width], []).append(m)
        for key, group in parts.items():
            if len(group) == 1 or len(key) < width:  # a short digit: these texts ended here
                done.append(group)
            else:
                open_.append((group, at + width, width * 2))
    return done


def _top(group: list[int], ids: list, uids) -> int:
    """Of these rows that with the largest id, null lowest, then the largest uid."""
    return max(group, key=lambda k: (ids[k] is not None, ids[k] or 0, uids[k]))


def _local(members: bool, carry: tuple[str, ...]):
    """Each batch's groups of equal texts: their top row with text and carried columns, and with `members` the others without."""

    def run(batches):
        from pyspark import TaskContext

        schema, uid = arrow_schema(LOCAL), TaskContext.get().partitionId() << 33
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or b"" for t in b.column(1).to_pylist()]
            uids = range(uid, uid + len(ids))
            rep, size, sha = list(uids), [1] * len(ids), [None] * len(ids)
            for group in radix_groups(texts):
                top = _top(group, ids, uids)
                digest = hashlib.sha256(texts[top]).hexdigest() if members else None
                for k in group:
                    rep[k], size[k], sha[k] = uid + top, len(group) if k == top else None, digest
                    if k != top:
                        texts[k] = None
            out = batch(schema, list(uids), b.column(0), rep, sha, size, texts)
            out = pa.RecordBatch.from_arrays([*out.columns, *b.columns[2:]], names=[*schema.names, *carry])
            uid += len(ids)
            yield out if members else out.filter(out.column("text").is_valid())
        relieve()

    return run


def _grouped(t: pa.Table) -> pa.Table:
    reps, ids, texts, n = (t.column(c).to_pylist() for c in ("rep", "doc_id", "text", "n"))
    out: list[list] = [[], [], [], []]
    for group in radix_groups(texts):
        best = _top(group, ids, reps)
        size = sum(n[k] for k in group)
        for k in group:
            for col, v in zip(out, (reps[k], ids[best], reps[best], size)):
                col.append(v)
    return pa.Table.from_batches([batch(arrow_schema(GROUPS), *out)])


def _tops(t: pa.Table) -> pa.Table:
    """The top row of each group of equal texts."""
    reps, ids, texts = (t.column(c).to_pylist() for c in ("rep", "doc_id", "text"))
    return t.take([_top(group, ids, reps) for group in radix_groups(texts)])


def leaves(reps: DataFrame, total: int, limit: int):
    """Column with each text's leaf prefix: the shortest of the depths whose texts together fit `limit`, or the text's end."""
    leaf, depth, heavy = None, 1, None
    branches = []
    while total > limit:
        prefix = F.expr(f"substring(text, 1, {depth})")
        level = reps if heavy is None else reps.where(branches[-1][1])
        rows = (level.groupBy(prefix.alias("p")).agg(F.sum(F.octet_length("text") + F.lit(200)).alias("b"), F.max(F.octet_length("text")).alias("longest"))
                .where((F.col("b") > limit) & (F.col("longest") > depth)).select("p").collect())
        heavy = [bytes(r[0]) for r in rows]
        branches.append((prefix, prefix.isin([F.lit(bytearray(h)) for h in heavy]) if heavy else F.lit(False)))
        if not heavy:
            break
        depth *= 2
    for prefix, is_heavy in branches:
        leaf = F.when(~is_heavy, prefix) if leaf is None else leaf.when(~is_heavy, prefix)
    return leaf.otherwise(F.col("text")) if leaf is not None else F.expr("X''")


def _locals(docs: DataFrame, members: bool, carry: tuple[str, ...] = ()) -> DataFrame:
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), *carry)
    return table(rows.mapInArrow(_local(members, carry), StructType([*StructType.fromDDL(LOCAL), *(docs.schema[c] for c in carry)])))


def _dealt(reps: DataFrame, limit: int):
    """The representatives grouped by the bucket of their leaf prefix."""
    total = int(reps.agg(F.sum(F.octet_length("text") + F.lit(200))).first()[0] or 0)
    limit = max(limit, total // 4_000)
    buckets = max(1, -(-total // limit))
    return reps.withColumn("bucket", F.pmod(F.xxhash64(leaves(reps, total, limit)), F.lit(buckets))).groupBy("bucket")


def exact_groups(docs: DataFrame, limit: int = 2 * MB) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row; the largest doc_id of equal texts stays."""
    local = _locals(docs, True)
    groups = _dealt(local.where(F.col("uid") == F.col("rep")).select("rep", "doc_id", "n", "text"), limit).applyInArrow(_grouped, GROUPS)
    return (local.select("uid", "doc_id", "rep", "text_sha256").join(groups, "rep")
            .select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256"))


def survivors(docs: DataFrame, carry: tuple[str, ...] = (), limit: int = 2 * MB) -> DataFrame:
    """(doc_id, text, carried columns) of the row of each group of equal texts that `exact_groups` keeps.

    Ids name no row here: rows with a null or repeated doc_id and different texts all stay. Null text comes back empty.
    Texts are shuffled once, and only one of a batch's copies."""
    local = _locals(docs, False, carry).select("rep", "doc_id", "text", *carry)
    out = StructType([local.schema["rep"], local.schema["doc_id"], local.schema["text"], *(docs.schema[c] for c in carry)])
    kept = _dealt(local, limit).applyInArrow(lambda t: _tops(t.select(out.names)), out)
    return kept.select("doc_id", F.col("text").cast("string"), *carry)
