"""Versions of a small list, committed one after the other by writers that do not know of each other.

A version is one file. It is written aside and put in place in one step that fails if the name
is taken: of two writers who go on from the same version one gets the next, the other is
refused, reads the winner's list and tries again. A writer that dies leaves a file aside, which
no reader sees and `vacuum` removes. A list names folders of data, never single files, so it
stays small whatever the data.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Stores whose rename is one step and can refuse to replace. Object stores without it would let two writers win.
RENAMES = ("hdfs", "viewfs", "webhdfs", "abfs", "abfss", "ofs")


class VersionLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version; 0 before the first."""
        path, store = self._path()
        names = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
        return max([0, *(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))])

    def entries(self, version: int | None = None) -> list[dict]:
        """A file that is not whole was never a version: the one before it stands, and the next one follows it."""
        version = self.version() if version is None else version
        while version:
            rows = self.spark.read.text(self._path(f"v{version:08d}.json")[0].toString(), wholetext=True).collect()
            lines = rows[0][0].splitlines() if rows else []
            try:
                if json.loads(lines[-1]) == {"end": len(lines) - 1}:
                    return [json.loads(x) for x in lines[:-1]]
            except (IndexError, ValueError):
                pass
            version -= 1
        return []

    def commit(self, entries: list[dict], after: int) -> bool:
        """Make `entries` the version that follows `after`; False if another writer has made that one."""
        lines = [*map(json.dumps, entries), json.dumps({"end": len(entries)})]
        return self._create(f"v{after + 1:08d}.json", "\n".join(lines).encode())

    def _create(self, name: str, data: bytes) -> bool:
        path, store = self._path(name)
        scheme = store.getScheme()
        if scheme != "file" and scheme not in RENAMES:
            raise RuntimeError(f"{scheme} cannot put a file in place in one step that fails if it is there; keep the manifest in one of file, {', '.join(RENAMES)}")
        store.mkdirs(path.getParent())
        if scheme == "file":  # a link is made in one step
            final = path.toUri().getPath()
            aside = os.path.join(os.path.dirname(final), f".{uuid.uuid4().hex}")
            with open(aside, "wb") as f:
                f.write(data)
            try:
                os.link(aside, final)
                return True
            except FileExistsError:
                return False
            finally:
                os.remove(aside)
        aside = self._path(f".{uuid.uuid4().hex}")[0]
        out = store.create(aside, False)
        out.write(data)
        out.close()
        jvm = self.spark._jvm
        try:
            # without OVERWRITE a rename onto a file fails
            options = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, path, options)
            return True
        except Py4JJavaError as e:
            store.delete(aside, False)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise

    def update(self, change: Callable[[list[dict]], list[dict] | None]) -> int:
        """Commit change(newest list), tried again on what a faster writer left; None changes nothing. The version."""
        while True:
            version = self.version()
            entries = change(self.entries(version))
            if entries is None or self.commit(entries, version):
                return version + (entries is not None)

    def vacuum(self, keep: int = 10, older_s: float = 3600.0) -> list[dict]:
        """Remove files aside that dead writers left over `older_s` ago, and all but the newest `keep` versions; the entries of those kept."""
        path, store = self._path()
        newest, before = self.version(), (time.time() - older_s) * 1000
        for s in store.listStatus(path) if store.exists(path) else []:
            name = s.getPath().getName()
            old = name.startswith("v") and name.endswith(".json") and int(name[1:-5]) <= newest - keep
            if old or (name.startswith(".") and not name.endswith(".crc") and s.getModificationTime() < before):
                store.delete(s.getPath(), False)
        return [e for v in range(max(1, newest - keep + 1), newest + 1) for e in self.entries(v)]
