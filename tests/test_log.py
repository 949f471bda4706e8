"""Logs that survive a crash at any step and refuse a second writer."""

import pytest

from clausegrid.sources import log as L, sinks as K

SCHEMA = "k long, v string"


class Crash(Exception):
    pass


def rows(spark, low, high):
    return spark.createDataFrame([(k, f"v{k}") for k in range(low, high)], SCHEMA)


def keys(df):
    return sorted(r["k"] for r in df.collect())


def dying(monkeypatch, module, name, at):
    """The call number `at` of a function fails, before it does anything."""
    real, calls = getattr(module, name), [0]

    def call(*a, **b):
        calls[0] += 1
        if calls[0] == at:
            raise Crash
        return real(*a, **b)

    monkeypatch.setattr(module, name, call)


@pytest.mark.parametrize("name, at", [("json_lines", 1), ("_rename", 1), ("_rename", 2), ("_delete", 3), (None, 0)])
def test_replaced_log_after_a_crash(spark, tmp_path, monkeypatch, name, at):
    path = str(tmp_path / "log")
    K.replace_log(rows(spark, 0, 3), path)
    with monkeypatch.context() as m:
        if name:
            dying(m, K, name, at)
            with pytest.raises(Crash):
                K.replace_log(rows(spark, 3, 5), path)
    K.recover_log(spark, path)
    had = keys(spark.read.schema(SCHEMA).json(path))
    assert had in ([0, 1, 2], [0, 1, 2, 3, 4])
    K.replace_log(rows(spark, 5, 6), path)
    assert keys(spark.read.schema(SCHEMA).json(path)) == had + [5]
    assert sorted(x.name for x in tmp_path.iterdir()) == ["log"]


def test_log_moved_aside_is_put_back(spark, tmp_path):
    path = tmp_path / "log"
    K.replace_log(rows(spark, 0, 3), str(path))
    K.json_lines(rows(spark, 0, 5), f"{path}.fresh")
    path.rename(f"{path}.old")
    K.replace_log(rows(spark, 5, 6), str(path))
    assert keys(spark.read.schema(SCHEMA).json(str(path))) == [0, 1, 2, 3, 4, 5]


def test_a_failed_rename_is_an_error(spark, tmp_path):
    with pytest.raises(Exception):
        K._rename(spark, str(tmp_path / "none"), str(tmp_path / "new"))


@pytest.mark.parametrize("name", ["json_lines", "write_bytes"])
def test_committed_log_after_a_crash(spark, tmp_path, monkeypatch, name):
    path = str(tmp_path / "log")
    assert L.append(rows(spark, 0, 3), path, "a")
    with monkeypatch.context() as m:
        dying(m, L, name, 1)
        with pytest.raises(Crash):
            L.append(rows(spark, 3, 5), path, "b")
    assert keys(L.read(spark, path, SCHEMA)) == [0, 1, 2]
    assert L.append(rows(spark, 3, 5), path, "b") and not L.append(rows(spark, 3, 5), path, "b")
    assert keys(L.read(spark, path, SCHEMA)) == [0, 1, 2, 3, 4]
    L.recover(spark, path)
    assert keys(L.read(spark, path, SCHEMA)) == [0, 1, 2, 3, 4] and len(list((tmp_path / "log" / "segments").iterdir())) == 2


@pytest.mark.parametrize("left", ["", '{"segment": "x"', '{"segment": "x", "batch": "b"}'])
def test_half_a_commit_is_given_up_by_recovery_alone(spark, tmp_path, left):
    path = str(tmp_path / "log")
    L.append(rows(spark, 0, 3), path, "a")
    K.write_bytes(spark, f"{path}/commits/{2:012d}", left.encode())
    assert keys(L.read(spark, path, SCHEMA)) == [0, 1, 2]
    with pytest.raises(L.LogConflict):
        L.append(rows(spark, 3, 5), path, "b")
    assert L.recover(spark, path) == 1
    assert L.append(rows(spark, 3, 5), path, "b")
    assert keys(L.read(spark, path, SCHEMA)) == [0, 1, 2, 3, 4] and [c.number for c in L.commits(spark, path)[0]] == [1, 3]


def test_one_of_two_writers_is_refused(spark, tmp_path, monkeypatch):
    path, real = str(tmp_path / "log"), L.json_lines
    L.append(rows(spark, 0, 1), path, "a")

    def slow(df, to):
        real(df, to)
        monkeypatch.setattr(L, "json_lines", real)
        assert L.append(rows(spark, 10, 12), path, "other")  # another writer, while this one is at its segment

    monkeypatch.setattr(L, "json_lines", slow)
    with pytest.raises(L.LogConflict):
        L.append(rows(spark, 1, 3), path, "mine")
    assert keys(L.read(spark, path, SCHEMA)) == [0, 10, 11]
    assert L.append(rows(spark, 1, 3), path, "mine") and keys(L.read(spark, path, SCHEMA)) == [0, 1, 2, 10, 11]


def test_a_log_that_is_not_there(spark, tmp_path):
    assert L.read(spark, str(tmp_path / "no"), SCHEMA).count() == 0 and L.commits(spark, str(tmp_path / "no")) == ([], [])
