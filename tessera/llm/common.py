"""What the operators of this subpackage share: shared folders, written tables, packed corpora.

A *packed corpus* is a written table with one row per chunk of a few megabytes of
text: (chunk, n_docs, blob).  Operators that must send something about each chunk
away and get an answer back key both by `chunk`, so a passage or word that many
documents share travels once per chunk, never once per document.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .storage import place_file, read_if_there

#: Null ids count as larger than every id.
NO_ID = np.iinfo(np.int64).max
MB = 1 << 20


#: Folders that this driver has made, for `scratch`.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors share; unset, one of this machine's where all executors run on it, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    _MADE.append(f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}")
    return _MADE[-1]


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end the shared folders made in its body, whose frames must not be used any longer."""
    before = len(_MADE)
    try:
        yield
    finally:
        for folder in _MADE[before:]:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        del _MADE[before:]


def tune(spark: SparkSession, rows: int = 2000) -> None:
    """Batches bounded in rows and in bytes, from Parquet and to Python, so that long texts fit a JVM and a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 * MB))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")


def table(df: DataFrame, where: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = where or shared_dir(spark)
    (df.write.option("parquet.page.size.row.check.min", 4).option("parquet.block.size.row.check.min", 4)
       .option("parquet.block.size", 16 * MB).option("compression", "zstd").parquet(path))
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a written table that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def relieve() -> None:
    """Give freed memory of this Python worker back: it lives on and waits beside the next stage's."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


# -- rows by number ---------------------------------------------------------

PART = 33


def numbered(df: DataFrame) -> DataFrame:
    """df as a written table with a `uid` of its own for each row: the writing task's number, then the row's."""
    tune(df.sparkSession)
    return table(df.withColumn("uid", F.monotonically_increasing_id()))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of a numbered table whose uid is not in `gone` (uid), without the uid. Only numbers are shuffled: those
    of one writing task meet in one file of the shared folder, which the readers of that task's rows open."""
    spark = rows.sparkSession
    folder, flags = shared_dir(spark), arrow_schema("part long, n long")
    kept = StructType([f for f in rows.schema if f.name != "uid"])

    def note(t: pa.Table) -> pa.Table:
        part, uids = t.column("part")[0].as_py(), np.unique(t.column("uid").to_numpy())
        place_file(folder, f"gone-{part}", uids.astype("<i8").tobytes())
        return pa.Table.from_batches([batch(flags, [part], [len(uids)])])

    # a group is no larger than one writing task's rows
    table(gone.select(F.shiftright("uid", PART).alias("part"), "uid").groupBy("part").applyInArrow(note, "part long, n long"))

    def keep(batches):
        known: dict[int, np.ndarray] = {}
        for b in batches:
            uids = b.column("uid").to_numpy()
            b = b.select([f.name for f in kept])
            stay = np.ones(len(uids), bool)
            for part in np.unique(uids >> PART).tolist():
                if part not in known:
                    known = {part: np.frombuffer(read_if_there(folder, f"gone-{part}"), "<i8")}
                stay &= ~np.isin(uids, known[part])
            yield b if stay.all() else b.filter(pa.array(stay))

    return rows.mapInArrow(keep, kept)


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """Bytes of text in the whole table (one scan inside the JVM)."""
    return int(df.agg(F.sum(F.octet_length(F.col(col)))).first()[0] or 0)


def sampled(rows: DataFrame, key: str, share, seed: int) -> DataFrame:
    """The rows whose hash of `key` falls into this share (a number or column), in steps fine enough for a few of 10^12 rows."""
    steps = 1 << 50
    return rows.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(steps)) < share * F.lit(float(steps)))


def batch(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a flat DDL string such as 'a long, b binary'."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(","))])


def ids_of(column: pa.Array) -> np.ndarray:
    """Long ids as numpy; null is NO_ID."""
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, type=pa.int64(), mask=ids == NO_ID)


# -- packed corpora ---------------------------------------------------------

PACKED = "chunk long, n_docs int, blob binary"


def pack_docs(ids: np.ndarray, texts: list[bytes]) -> bytes:
    head = np.array([len(ids)], dtype="<i8").tobytes()
    sizes = np.fromiter(map(len, texts), dtype="<i8", count=len(texts)).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, ids.astype("<i8").tobytes(), sizes, *texts]))


def unpack_docs(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ids, sizes = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i8", n, 8 + 8 * n)
    ends = (8 + 16 * n + np.cumsum(sizes)).tolist()
    starts = [8 + 16 * n, *ends[:-1]]
    return ids, [raw[a:b] for a, b in zip(starts, ends)]


def chunk_bytes(total: int) -> int:
    """Bytes of text in a chunk: grows with the corpus so that chunks x shards stays moderate."""
    return int(min(32 * MB, max(2 * MB, total / 4096)))


def packed(docs: DataFrame, total: int) -> DataFrame:
    """The corpus as a written table of chunks. Null text is empty; one long document may be a chunk of its own."""
    limit, schema = chunk_bytes(total), arrow_schema(PACKED)

    def pack(batches):
        from pyspark import TaskContext

        part, seq, ids, texts, size = TaskContext.get().partitionId() << 32, 0, [], [], 0
        for b in batches:
            for i, t in zip(ids_of(b.column(0)).tolist(), b.column(1).to_pylist()):
                ids.append(i)
                texts.append(t or b"")
                size += len(texts[-1]) + 64
                if size >= limit:
                    yield batch(schema, [part + seq], [len(ids)], [pack_docs(np.array(ids, dtype=np.int64), texts)])
                    seq, ids, texts, size = seq + 1, [], [], 0
        if ids:
            yield batch(schema, [part + seq], [len(ids)], [pack_docs(np.array(ids, dtype=np.int64), texts)])

    tune(docs.sparkSession)
    return table(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(pack, PACKED))


def answers_by_chunk(replies: DataFrame) -> str:
    """Answers (chunk, slice, shard, blob) as one file per chunk of a shared folder, so that the chunks themselves need no shuffle: the
    number of entries, then (slice, shard, bytes) of each, then the blobs. The folder."""
    folder = shared_dir(replies.sparkSession)

    def note(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("slice").to_pylist(), t.column("shard").to_pylist(), t.column("blob").to_pylist()))
        head = np.array([[len(rows), 0, 0], *([a, b, len(c)] for a, b, c in rows)], "<i8")
        place_file(folder, f"answers-{t.column('chunk')[0].as_py()}", b"".join([head.tobytes(), *(r[2] for r in rows)]))
        return pa.table({"n": pa.array([len(rows)], pa.int64())})

    table(replies.groupBy("chunk").applyInArrow(note, "n long"))
    return folder


def answers_for(folder: str, chunk: int) -> dict[int, list[tuple[int, bytes]]]:
    """(shard, blob) of a chunk's answers, by slice."""
    raw, out = read_if_there(folder, f"answers-{chunk}"), {}
    if raw:
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        at = 24 * (n + 1)
        for part, shard, size in np.frombuffer(raw, "<i8", 3 * n, 24).reshape(-1, 3).tolist():
            out.setdefault(part, []).append((shard, raw[at : at + size]))
            at += size
    return out


def flat_words(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray, list[bytes]]:
    """(word ids of all texts one after the other, distinct words by id, bounds of texts, all words); words end at ASCII white space."""
    every, bounds = words_of(texts)
    return (*number(every), bounds, every)


def words_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """(all words, bounds of texts)."""
    split = [t.split() for t in texts]
    return list(chain.from_iterable(split)), np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))])


def number(every: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """(id of each word, distinct words by id), ids given in order of first sight."""
    words = list(dict.fromkeys(every))
    index = dict(zip(words, range(len(words))))
    return np.fromiter(map(index.__getitem__, every), np.int64, len(every)), words


def hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(seed)), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def held_out(doc_id, mod: int, rest: int):
    """Column: crc32 of the id as text leaves this remainder; a null id never does."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))
