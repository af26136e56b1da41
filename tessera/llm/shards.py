"""Sharding by size-tiered compaction, in DataFrame operations only.

Arrivals are appended as runs: folders of small immutable shards (Parquet files). Runs of
similar size share a tier, by powers of `fanout`; when a tier has `fanout` runs, its oldest
ones are merged, without a shuffle, into a run of files of about `target` bytes, whose own
size gives its tier. After compaction there are fewer than `fanout` runs a tier, so a
manifest holds as many as the logarithm of the data; it names runs, never files.

Every change is one new manifest version, created exclusively (`VersionLog`): a reader sees
the old or the new list, a writer that another one overtook starts again from the other's list,
and a merge whose inputs someone else has merged meanwhile is dropped. Nothing committed is lost.
`vacuum` removes runs that no kept version names.

Rows are kept as they are: nulls, repeats, long texts and further columns included, whatever
their names; what the store adds is named so that it does not clash. An empty arrival adds no
run; an empty or new store reads as no rows.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.manifest import VersionLog
from .common import MB, shared_dir


def free(name: str, taken: list[str]) -> str:
    """name, or name_1, name_2, ... if it is taken (case does not tell names apart)."""
    low, k, out = {c.lower() for c in taken}, 0, name
    while out.lower() in low:
        k += 1
        out = f"{name}_{k}"
    return out


class ShardStore:
    def __init__(self, spark: SparkSession, folder: str | None = None, target: int = 128 * MB, fanout: int = 4, base: int = 1 * MB):
        self.spark, self.folder, self.target, self.fanout, self.base = spark, (folder or shared_dir(spark)).rstrip("/"), target, fanout, base
        self.log = VersionLog(spark, f"{self.folder}/manifest")

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        return self.log.version()

    def runs(self, version: int | None = None) -> list[dict]:
        """{run, bytes} of each run, oldest first."""
        return [e for e in self.log.entries(version) if "run" in e]

    def tier(self, run: dict) -> int:
        return max(0, math.floor(math.log(max(run["bytes"], 1) / self.base, self.fanout)))

    def _schema(self, entries: list[dict]) -> StructType | None:
        return next((StructType.fromJson(e["schema"]) for e in entries if "schema" in e), None)

    def _load(self, names: list[str], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/data/{n}" for n in names)) if names else self.spark.createDataFrame([], schema)

    def _sizes(self, name: str, run) -> list[dict]:
        """Runs under a written folder, without reading their contents; run: column of the name by `path`. One row a run comes to the driver."""
        found = (self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
                 .load(f"{self.folder}/data/{name}").select(run.alias("run"), "length").groupBy("run").agg(F.sum("length").alias("bytes")).orderBy("run"))
        return [r.asDict() for r in found.collect()]

    def _write(self, df: DataFrame, name: str, by: str | None = None) -> None:
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(f"{self.folder}/data/{name}")

    # -- writing
    def append(self, df: DataFrame) -> int:
        """One arrival; the new version."""
        name = f"run-{uuid.uuid4().hex[:12]}"
        self._write(df, name)
        return self._adopt(df.schema, [r for r in self._sizes(name, F.lit(name)) if not df.isEmpty()])

    def append_many(self, df: DataFrame, arrival: str) -> int:
        """Each value of `arrival` becomes one run of small shards, all in one version; the new version."""
        name, schema = f"run-{uuid.uuid4().hex[:12]}", df.drop(arrival).schema
        self._write(df, name, arrival)
        return self._adopt(schema, self._sizes(name, F.concat(F.lit(f"{name}/"), F.regexp_extract("path", rf"/({arrival}=[^/]*)/", 1))) if not df.isEmpty() else [])

    def _adopt(self, schema: StructType, runs: list[dict]) -> int:
        def change(entries: list[dict]) -> list[dict] | None:
            known = self._schema(entries)
            if known is not None and known.simpleString() != schema.simpleString():
                raise ValueError(f"rows of {schema.simpleString()} do not fit a store of {known.simpleString()}")
            return [*entries, *runs] if known is not None and runs else None if known is not None else [{"schema": schema.jsonValue()}, *runs]

        return self.log.update(change)

    def compact(self) -> int:
        """Merge `fanout` runs of a tier at a time until no tier has as many; the newest version."""
        while True:
            version = self.version()
            entries = self.log.entries(version)
            tiers: dict[int, list[dict]] = {}
            for e in entries:
                if "run" in e:
                    tiers.setdefault(self.tier(e), []).append(e)
            due = next((tiers[t][: self.fanout] for t in sorted(tiers) if len(tiers[t]) >= self.fanout), None)
            if due is None:
                return version
            name, old = f"run-{uuid.uuid4().hex[:12]}", {e["run"] for e in due}
            files = max(1, round(sum(e["bytes"] for e in due) / self.target))
            self._write(self._load([e["run"] for e in due], self._schema(entries)).coalesce(files), name)
            merged = self._sizes(name, F.lit(name))

            def change(now: list[dict], old=old, merged=merged) -> list[dict] | None:
                if not old <= {e.get("run") for e in now}:
                    return None  # merged by another writer
                at = next(k for k, e in enumerate(now) if e.get("run") in old)
                return [*now[:at], *merged, *(e for e in now[at:] if e.get("run") not in old)]

            if name not in {e["run"] for e in self.runs(self.log.update(change))}:
                self._delete(name)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/data/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def vacuum(self, keep: int = 1) -> None:
        """Delete the runs that older versions name and the newest `keep` do not; those versions can no longer be read.

        Only runs of committed versions go: what a writer has not committed yet is not touched."""
        newest = self.version()
        live = {e["run"] for v in range(max(1, newest - keep + 1), newest + 1) for e in self.runs(v)}
        for run in sorted({e["run"] for v in range(1, newest - keep + 1) for e in self.runs(v)} - live):
            self._delete(run)

    # -- reading
    def read(self, version: int | None = None, shard: str | None = None) -> DataFrame:
        """All rows of a version; with `shard`, a column of that name (one that is free) says which file each lies in."""
        entries = self.log.entries(version)
        schema = self._schema(entries) or StructType()
        rows = self._load([e["run"] for e in entries if "run" in e], schema)
        return rows.withColumn(free(shard, rows.columns), F.regexp_extract(F.input_file_name(), r"/data/(.*)$", 1)) if shard else rows


def compacted(docs: DataFrame, arrivals: int = 16, target: int = 32 * MB) -> DataFrame:
    """Append all rows in so many arrivals, compact, and read the newest version back, with the version and the row's shard
    in columns `manifest_version` and `shard`, or the next free names."""
    store = ShardStore(docs.sparkSession, target=target)
    name = f"arrival_{uuid.uuid4().hex}"
    store.append_many(docs.withColumn(name, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))), name)
    version = store.compact()
    rows = store.read(version, shard="shard")
    return rows.withColumn(free("manifest_version", rows.columns), F.lit(version))
