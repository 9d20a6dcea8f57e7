from datetime import datetime

from cairn.operators import orphans

H = "hit_id long, query_id long, recalled_at timestamp_ntz, logged_at timestamp_ntz, slug string, file string, score double, facts array<string>, at long, held int"
M = "mem_id long, batch_no int, slug string, file string, name string, description string, memory_type string, body string, source_mtime long, synced_at timestamp_ntz, target string"
R = "slug string, file string, deleted_at timestamp_ntz"


def day(n):
    return datetime(2024, 1, 1 + n) if n < 30 else datetime(2024, 6, n - 29)


def hit(i, file, when, slug="s"):
    return (i, 1, when and day(when), None, slug, file, None, None, 5, 6)


def mem(i, file, when, body="", slug="s"):
    return (i, 0, slug, file, None, None, None, body, None, day(when), "clash")


def found(spark, h, m, t):
    out = orphans.found(spark.createDataFrame(h, H), spark.createDataFrame(m, M), spark.createDataFrame(t, R))
    return sorted(tuple(r) for r in out.collect())


def test_reasons(spark):
    m = [mem(1, "a.md", 5), mem(2, "b.md", 3, "see [[a]], [[a.md|x]], [[ c#h ]] `[[no]]`\n```\n[[no]]\n```\n[[c]]"), mem(3, "a.md", 35), mem(4, "d.md", 4, None)]
    h = [hit(1, " ./a.md ", 4), hit(1, " ./a.md ", 4), hit(2, "a.md", 5), hit(3, "a.md", 8), hit(4, "a.md", 33), hit(5, "a.md", 36), hit(6, "", 9), hit(7, None, 9), hit(8, "9", 9), hit(9, "a.md", 9, None), hit(10, "a.md", None)]
    t = [("s", "a.md", day(10)), ("s", "a.md", day(10)), ("s", "zz.md", day(1)), (None, None, None)]
    assert found(spark, h, m, t) == sorted([
        ("recall_hits", 1, "a.md", "2024-01", "late"), ("recall_hits", 4, "a.md", "2024-06", "deleted"), ("recall_hits", 8, "9", "2024-01", "missing"), ("recall_hits", 9, "a.md", "2024-01", "missing"), ("memories", 2, "a.md", "2024-01", "late"), ("memories", 2, "c.md", "2024-01", "missing"),
    ])


def test_empty(spark):
    assert found(spark, [], [], []) == []


def test_cascade_ends_in_cycles(spark):
    lost = spark.createDataFrame([("a",)], "record string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "e"), ("x", "y")], "parent string, child string")
    assert {(r.record, r.depth) for r in orphans.cascade(lost, edges).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_report(spark):
    m = [mem(1, "a.md", 1, "[[gone]]"), mem(2, "b.md", 2, "[[a]]"), mem(3, "c.md", 3, "[[d]]"), mem(4, "d.md", 1)]
    h = [hit(1, "b.md", 20), hit(2, "d.md", 20)]
    out = orphans.report(spark.createDataFrame(h, H), spark.createDataFrame(m, M), spark.createDataFrame([], R))
    assert sorted(tuple(r) for r in out.collect()) == [("memories", "2024-01", 1, 1, 1), ("recall_hits", "2024-01", 0, 1, 2)]


def test_report_counts_each_month_of_the_orphan_references(spark):
    m = [mem(1, "t.md", 0), mem(2, "a.md", 1, "[[t]]"), mem(3, "a.md", 35, "[[gone]]"), mem(4, "b.md", 2, "[[t]] [[b]]"), mem(5, "b.md", 36, "[[a]]"), mem(6, "c.md", 3, "[[gone]]"), mem(7, "c.md", 37, "[[gone]]"), mem(8, "c.md", 38, "[[gone]]")]
    h = [hit(1, "b.md", 10)]
    out = orphans.report(spark.createDataFrame(h, H), spark.createDataFrame(m, M), spark.createDataFrame([], R))
    assert sorted(tuple(r) for r in out.collect()) == [("memories", "2024-01", 1, 0, 0), ("memories", "2024-06", 2, 1, 1), ("recall_hits", "2024-01", 0, 1, 2)]


def test_cascade_follows_long_chains_to_their_end(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(9)], "parent string, child string")
    assert orphans.cascade(spark.createDataFrame([("0",)], "record string"), edges).count() == 10
