"""Tables published together: readers see one version whole, whatever fails in between."""

import pytest

from quillspark.sources import files
from quillspark.sources.published import Conflict, Published


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_carry_all_tables(spark, tmp_path):
    p = Published(spark, f"file://{tmp_path}/p")
    a, b = spark.range(3), spark.range(5, 7)
    assert p.versions() == [] and p.tables() == {}
    assert p.publish({"a": a, "b": b}) == 1
    assert p.publish({"a": p.read("a").union(b)}) == 2  # from what is published now
    assert rows(p.read("a")) == [(0,), (1,), (2,), (5,), (6,)] and rows(p.read("a", 1)) == rows(a) and p.tables()["b"] == p.tables(1)["b"]
    assert p.publish({}, without=("b",)) == 3 and set(p.tables()) == {"a"} and rows(p.read("b", 2)) == rows(b)
    with pytest.raises(ValueError):
        p.read("a", 9)
    with pytest.raises(Conflict):
        p.publish({"a": a}, builds_on=2)
    assert p.publish({"a": a}, builds_on=3) == 4
    p.clean(keep=2)
    assert p.versions() == [3, 4] and rows(p.read("a")) == rows(a) and len(rows(p.read("a", 3))) == 5
    assert p.clean(keep=2) == []


@pytest.mark.parametrize("step", range(4))
def test_a_failure_at_every_step_leaves_the_old_version(spark, tmp_path, monkeypatch, step):
    p = Published(spark, f"file://{tmp_path}/p")
    p.publish({"a": spark.range(2), "b": spark.range(3)})
    bad = spark.range(3).selectExpr("raise_error('stop') AS id")
    if step == 0:  # while the first table is written
        new = {"a": bad, "b": spark.range(9)}
    elif step == 1:  # while the second is
        new = {"a": spark.range(9), "b": bad}
    else:
        new = {"a": spark.range(9), "b": spark.range(9)}
    if step == 2:  # before the manifest
        monkeypatch.setattr(Published, "_put", lambda *_: 1 / 0)
    if step == 3:  # in the middle of it
        def half(self, version, tables):
            stream = self._fs.create(self._at(f"log/{version:012d}.json"), False)
            stream.write(bytearray(b'{"version": 2, "tab'))
            stream.close()
            raise OSError("stopped")

        monkeypatch.setattr(Published, "_put", half)
    with pytest.raises(Exception):
        p.publish(new)
    monkeypatch.undo()
    again = Published(spark, p.path)
    assert again.versions() == [1] and len(rows(again.read("a"))) == 2 and len(rows(again.read("b"))) == 3
    version = again.publish({"a": spark.range(4)})
    assert version == (3 if step == 3 else 2) and len(rows(again.read("a"))) == 4 and len(rows(again.read("b"))) == 3
    again.clean(keep=1)
    assert len(rows(again.read("a"))) == 4 and again.versions() == [version]


def test_two_writers_get_two_versions(spark, tmp_path):
    one, two = (Published(spark, f"file://{tmp_path}/p") for _ in range(2))
    put = Published._put
    assert one.publish({"a": spark.range(1)}) == 1
    # another manifest of the number comes first
    assert put(one, 2, one.tables()) and not put(two, 2, {})
    assert two.publish({"b": spark.range(2)}) == 3 and set(two.tables()) == {"a", "b"}


def test_a_stopped_rename_loses_no_table(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    assert files.write_changed(spark.range(3), path, ["id"])
    real, calls = files._renamed, []

    def stops(*a):
        calls.append(a)
        if len(calls) == 2:
            raise OSError("stopped")
        real(*a)

    monkeypatch.setattr(files, "_renamed", stops)
    with pytest.raises(OSError):
        files.write_changed(spark.range(4), path, ["id"])
    monkeypatch.undo()
    assert not files._there(spark, path)  # it stopped between the two names
    assert not files.write_changed(spark.range(3), path, ["id"])  # the old table is back, and the same
    assert files.write_changed(spark.range(4), path, ["id"]) and spark.read.parquet(path).count() == 4
    assert [x.name for x in tmp_path.iterdir() if x.name.startswith("t")] == ["t"]
