"""Token-ID output: one binary file per shard, every document its own zstandard frame.

File: magic, SHA-256 of the dictionary, number of documents, place of the index;
frames in ascending doc_id order; index of (doc_id, has id, frame end, ids before it
in the shard).  The dictionary is trained once on serialized id arrays of a bounded
sample (`sample` documents at most; it only affects size), lies beside the shards,
and is named by its hash, so a reader can refuse a wrong one.  A document is read
with the header, its index entry and its own frame.

Tasks write under names of their own; the manifest, a written table, lists the files
of the attempts that succeeded, so lost executors leave strays, never doubles.

Null text is an empty text (the end id alone); a null doc_id sorts last; repeated rows
are all written; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MB, arrow_schema, batch, id_array, ids_of, sampled, shared_dir, table, tune
from .storage import open_file, write_file

#: Shards grow beyond `shard_bytes` rather than in number, so a row for each can be broadcast.
MOST_SHARDS = 200_000
MAGIC = b"TOKSHD01"
HEAD = "<8s32sqq"
HEAD_SIZE = struct.calcsize(HEAD)
ENTRY = np.dtype([("doc_id", "<i8"), ("end", "<i8"), ("before", "<i8")])
MANIFEST = "shard int, file string, n_docs long, n_tokens long, dict_sha256 string"
ROWS = "shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


class CachedTokenizer:
    """A tokenizers file behind a bounded cache of its pieces.

    A text of plain Latin-1 letters, digits and signs is lower-cased and split as the file's
    normaliser and pre-tokenizer would (for these characters both work sign by sign), and each
    distinct piece is encoded once by the library's model. Any other text goes through the
    library's whole pipeline, in units between single spaces: white space ends every piece.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), most
        # white space and '<', which may open a special token, are not plain; nor are signs whose class Latin-1 does not settle
        self.plain = re.compile(r"[\n !-;=-~\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf-\u00ff]*").fullmatch
        letter = "a-z\u00df-\u00f6\u00f8-\u00ff"
        self.split = re.compile(rf"[{letter}]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^ \n{letter}0-9]+").findall
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.chars = [chr(b) if b in printable else chr(next(rest)) for b in range(256)]
        self.pieces: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {"": b""}

    def unit(self, u: str) -> bytes:
        return np.array(self.tok.encode(u, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, p: str) -> bytes:
        s = p if p.isascii() else "".join([self.chars[b] for b in p.encode()])
        return np.array([t.id for t in self.tok.model.tokenize(s)], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        if self.plain(text):
            return self._cached(self.split(text.lower()), self.pieces, self.piece)
        return self._cached(text.replace("\n", " ").split(" "), self.units, self.unit)

    def _cached(self, parts: list[str], known: dict[str, bytes], encode) -> bytes:
        if len(known) >= self.most:
            known.clear()
        for p in set(parts).difference(known):
            known[p] = encode(p)
        return b"".join(map(known.__getitem__, parts))


_TOKENIZERS: dict[str, CachedTokenizer] = {}


def tokenizer(path: str) -> CachedTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = CachedTokenizer(path)
    return _TOKENIZERS[path]


def train(samples: list[bytes], size: int) -> bytes:
    """Dictionary of at most `size` bytes; raw content where there is too little to train on."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _frames(dictionary: bytes):
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=True), zstandard.ZstdDecompressor(dict_data=d)


class Shard:
    """Random access to one file."""

    def __init__(self, uri: str, name: str, dictionary: bytes):
        self.file = open_file(uri, name)
        magic, sha, n, at = struct.unpack(HEAD, self.file.read_at(HEAD_SIZE, 0))
        if magic != MAGIC or sha != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name}: not a token file of this dictionary")
        self.index = np.frombuffer(self.file.read_at(n * ENTRY.itemsize, at), ENTRY)
        self.unpress = _frames(dictionary)[1]

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document: one range read, one frame."""
        a = int(self.index["end"][k - 1]) if k else HEAD_SIZE
        return np.frombuffer(self.unpress.decompress(self.file.read_at(int(self.index["end"][k]) - a, a)), "<u4")

    def find(self, doc_id: int) -> np.ndarray | None:
        k = int(np.searchsorted(self.index["doc_id"], doc_id))
        return self.ids(k) if k < len(self.index) and self.index["doc_id"][k] == doc_id else None


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None, shard_bytes: int = 16 * MB,
          sample: int = 1000, dict_bytes: int = 64 << 10) -> tuple[str, DataFrame]:
    """Write all documents; (folder, manifest)."""
    spark = docs.sparkSession
    folder, end = folder or shared_dir(spark), np.array([end_id], "<u4").tobytes()
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    size = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    total = int(size["b"] or 0)
    shards = max(1, -(-total // max(shard_bytes, total // MOST_SHARDS)))
    share = min(1.0, sample / max(size["n"], 1))
    picked = sampled(rows, "doc_id", share, 11) if share < 1 else rows
    raw_schema = arrow_schema("ids binary")

    def ids_only(batches):
        tok = tokenizer(tokenizer_path)
        for b in batches:
            yield batch(raw_schema, [(tok.encode(t or "") + end)[: 64 << 10] for t in b.column(1).to_pylist()])

    tune(spark)
    dictionary = train([bytes(r[0]) for r in picked.limit(2 * sample).mapInArrow(ids_only, "ids binary").collect()], dict_bytes)
    sha = hashlib.sha256(dictionary).hexdigest()
    write_file(folder, f"dictionary-{sha}", [dictionary])
    schema, shared = arrow_schema(MANIFEST), spark.sparkContext.broadcast(dictionary)

    def put(batches):
        from pyspark import TaskContext

        tok, press = tokenizer(tokenizer_path), _frames(shared.value)[0]
        ids, ends, before, frames, at, tokens = [], [], [], [], HEAD_SIZE, 0
        for b in batches:
            for i, t in zip(ids_of(b.column(0)).tolist(), b.column(1).to_pylist()):
                raw = tok.encode(t or "") + end
                frames.append(press.compress(raw))
                at += len(frames[-1])
                ids.append(i)
                ends.append(at)
                before.append(tokens)
                tokens += len(raw) // 4
        if not ids:
            return
        index = np.empty(len(ids), ENTRY)
        index["doc_id"], index["end"], index["before"] = ids, ends, before
        shard = TaskContext.get().partitionId()
        name = write_file(folder, f"shard-{shard:06d}", [struct.pack(HEAD, MAGIC, hashlib.sha256(shared.value).digest(), len(ids), at), *frames, index.tobytes()])
        yield batch(schema, [shard], [name], [len(ids)], [tokens], [sha])

    ordered = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last())
    return folder, table(ordered.mapInArrow(put, MANIFEST), f"{folder}/manifest")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    schema = arrow_schema(ROWS)
    sha = manifest.select("dict_sha256").first()
    if sha is None:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def get(batches):
        from pyarrow import fs

        from .storage import open_store

        store, path = open_store(folder)
        name = next(x.base_name for x in store.get_file_info(fs.FileSelector(path)) if x.base_name.startswith(f"dictionary-{sha[0]}"))
        dictionary = open_file(folder, name).read()
        for b in batches:
            for shard, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = Shard(folder, file, dictionary)
                ids = [s.ids(k) for k in range(len(s.index))]
                yield batch(schema, [shard] * len(ids), id_array(s.index["doc_id"].copy()), s.index["before"].copy(), list(map(len, ids)), [zlib.crc32(x) for x in ids])

    files = manifest.select("shard", "file")
    n = max(1, manifest.count())
    rows = files.repartition(n, "shard").mapInArrow(get, ROWS)
    # one row per shard, MOST_SHARDS at most: ids in the shards before it
    starts = manifest.select("shard", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(starts), "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, tokenizer_path: str, **how) -> DataFrame:
    folder, manifest = write(docs, tokenizer_path, **how)
    return read(docs.sparkSession, folder, manifest)
