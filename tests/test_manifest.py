import threading

import pytest

from tessera.operators.manifest import VersionLog


def test_versions(spark, tmp_path):
    log = VersionLog(spark, f"file://{tmp_path}/log")
    assert log.version() == 0 and log.entries() == []
    assert log.commit([{"a": 1}], 0) and not log.commit([{"a": 2}], 0)
    assert log.update(lambda e: [*e, {"b": "ü"}]) == 2 and log.entries() == [{"a": 1}, {"b": "ü"}] and log.entries(1) == [{"a": 1}]
    assert log.update(lambda e: None) == 2


@pytest.mark.parametrize("left", ['{"a": 1}\n', "", '{"a": 1}\n{"en'])
def test_dead_writer(spark, tmp_path, left):
    """A file that is not whole was never a version: readers see the one before, writers go on; files aside are cleared away."""
    log = VersionLog(spark, f"file://{tmp_path}/log")
    log.update(lambda e: [{"a": 1}])
    (tmp_path / "log" / "v00000002.json").write_text(left)
    (tmp_path / "log" / ".0123").write_text("aside")
    assert log.entries() == [{"a": 1}]
    assert log.update(lambda e: [*e, {"b": 2}]) == 3 and log.entries() == [{"a": 1}, {"b": 2}]
    log.vacuum(keep=10, older_s=3600)
    assert (tmp_path / "log" / ".0123").exists()  # its writer may be alive
    assert log.vacuum(keep=1, older_s=-5) == [{"a": 1}, {"b": 2}]
    assert [p.name for p in (tmp_path / "log").iterdir()] == ["v00000003.json"]


def test_other_stores(spark, tmp_path):
    """Elsewhere a version is renamed into place, which fails if it is there; a store that cannot is refused."""
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.versions.link./in", f"file://{tmp_path}")
    log = VersionLog(spark, "viewfs://versions/in/log")
    assert log.commit([{"a": 1}], 0) and not log.commit([{"a": 2}], 0) and log.entries() == [{"a": 1}]
    assert sorted(p.name for p in (tmp_path / "log").iterdir() if not p.name.endswith(".crc")) == ["v00000001.json"]
    conf.set("fs.plain.impl", "org.apache.hadoop.fs.RawLocalFileSystem")
    refused = VersionLog(spark, f"file://{tmp_path}/refused")
    refused._path = lambda name="": (log._path(name)[0], type("Store", (), {"getScheme": lambda self: "s3a"})())
    with pytest.raises(RuntimeError, match="one step"):
        refused.commit([], 0)


def test_interleaved(spark, tmp_path):
    """Another writer commits between reading and committing: both changes are kept."""
    log, rival, once = VersionLog(spark, f"file://{tmp_path}/log"), VersionLog(spark, f"file://{tmp_path}/log"), [True]

    def change(entries):
        if once:
            once.clear()
            rival.update(lambda e: [*e, {"by": "rival"}])
        return [*entries, {"by": "me"}]

    assert log.update(change) == 2 and [e["by"] for e in log.entries()] == ["rival", "me"]


def test_many_writers(spark, tmp_path):
    logs = [VersionLog(spark, f"file://{tmp_path}/log") for _ in range(6)]
    threads = [threading.Thread(target=lambda k=k, x=x: x.update(lambda e: [*e, {"k": k}])) for k, x in enumerate(logs)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(e["k"] for e in logs[0].entries()) == list(range(6)) and logs[0].version() == 6
