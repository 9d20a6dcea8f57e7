from datetime import datetime, timedelta

import pytest

from cairn.operators import history, timeline

T = "update_id long, slug string, file string, subject string, relation string, object string, confidence double, temporal string, source_mtime long, arrived_at timestamp_ntz, at long, state string, step long"
L = "snapshot_no int, snapshot_at timestamp_ntz, slug string, file string, text string, subject string, object string, legacy_name string, valid_until string, loaded_at timestamp_ntz"
D = [datetime(2025, 1, 1) + timedelta(days=30 * i) for i in range(4)]
S = [int((d - datetime(1970, 1, 1)).total_seconds()) for d in D]


def triple(i, rel, obj, mtime, temporal=None, subject=" A ", file="f.md", slug="s"):
    return (i, slug, file, subject, rel, obj, 0.1, temporal, mtime, None, 7, "x", 9)


def found(spark, t, f):
    return sorted(tuple(r) for r in history.found(spark.createDataFrame(t, T), spark.createDataFrame(f, L)).collect())


def test_triples(spark):
    rows = [
        triple(1, "runs-on", "X", 10), triple(1, "runs-on", "X", 10), triple(2, "Runs On", "x ", 20), triple(4, "runs_on", "y", 30), triple(3, "runs_on", "z", 30), triple(5, "runs_on", "y", 40_000_000, "Past"),
        triple(6, "runs_on", None, 50), triple(7, "runs_on", "q", None), triple(8, None, "q", 5, subject=None, file=None, slug=None),
    ]
    got = {tuple(r) for r in history.found(spark.createDataFrame(rows[:-1], T), spark.createDataFrame([], L)).collect()}
    assert got == {("triple", "s", "f.md", "a|runs_on", 10, 30), ("triple", "s", "f.md", "a|runs_on", 30, 40_000_000), ("triple", "s", "f.md", "a|runs_on", 40_000_000, -1)}


@pytest.mark.parametrize("between", [2, 10**9])
def test_facts(spark, monkeypatch, between):
    monkeypatch.setattr(timeline, "BETWEEN", between)
    def row(n, text, until=None, file="f"):
        return (n, D[n], "s", file, text, None, None, None, until, None)

    rows = [
        row(0, "a"), row(1, "a", "2025-01-20T00:00:00Z"), row(1, "a"), row(2, "a", "2025-02-20T01:00:00+01:00"), row(3, "a", "2025-02-20 00:00:00"),
        row(0, "b"), row(2, "b"), row(0, "c", file="g"), row(2, "c", file="g"), row(2, "c", file="g"), row(3, "d", "no time"), row(1, None),
    ]
    assert found(spark, [], rows) == sorted([
        ("fact", "s", "f", "a", S[0], S[2]), ("fact", "s", "f", "a", S[2], -1), ("fact", "s", "f", "b", S[0], S[1]), ("fact", "s", "f", "b", S[2], S[3]), ("fact", "s", "g", "c", S[0], -1), ("fact", "s", "f", "d", S[3], -1),
    ])


def test_null_keys(spark):
    got = [tuple(r) for r in history.found(spark.createDataFrame([triple(8, None, "q", 5, subject=None, file=None, slug=None), triple(9, None, "r", 9, subject=None, file=None, slug=None)], T), spark.createDataFrame([], L)).collect()]
    assert sorted(got, key=lambda r: r[4]) == [("triple", None, None, "|", 5, 9), ("triple", None, None, "|", 9, -1)]


def test_empty(spark):
    assert found(spark, [], []) == []


@pytest.mark.parametrize("between", [7, 10**9])
def test_many_updates_of_one_key_cross_buckets(spark, monkeypatch, between):
    monkeypatch.setattr(timeline, "BETWEEN", between)
    rows = [triple(i, "uses", f"o{i // 3}", i * 200_000) for i in range(60)]
    got = found(spark, rows, [])
    assert len(got) == 20 and [g[4] for g in got] == [i * 600_000 for i in range(20)] and got[-1][5] == -1
