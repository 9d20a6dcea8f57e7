import pytest

from cairn.plans import registry

#: Two groups of parallel vectors, {1, 2, 20} and {3, 4}, and one alone.
NEAR = [(1, [1.0, 0.0, 0.0], 0), (2, [1.0, 0.1, 0.0], 0), (20, [1.0, 0.0, 0.1], 0), (3, [0.0, 1.0, 0.0], 0), (4, [0.0, 1.0, 0.1], 0), (40, [0.0, 0.0, 1.0], 0)]


def asked(spark, tmp_path, name):
    spark.createDataFrame(NEAR, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    return registry()[0][name](spark, str(tmp_path))


def test_clusters_need_no_member_of_a_query_set(spark, tmp_path):
    got = asked(spark, tmp_path, "clique_clusters").collect()
    assert sorted((r.cluster, r.member) for r in got) == [(1, 1), (1, 2), (1, 20), (3, 3), (3, 4)]


@pytest.mark.parametrize("name", ["vector_dup_pairs", "vector_knn_pairs"])
def test_pairs_need_no_member_of_a_query_set(spark, tmp_path, name):
    assert sorted((r.a, r.b) for r in asked(spark, tmp_path, name).collect()) == [(1, 2), (1, 20), (2, 20), (3, 4)]


def test_shared_entities_of_all_files(spark, tmp_path):
    t = "update_id long, slug string, file string, subject string, relation string, object string, confidence double, temporal string, source_mtime long, arrived_at timestamp_ntz"
    known = [("a.md", "x", "y"), ("b.md", "y", "x"), ("c.md", "x", "z")] + [(f"h{i}.md", "hub", f"own{i}") for i in range(9)]
    spark.createDataFrame([(i, "s", f, a, "uses", b, 0.9, None, 1, None) for i, (f, a, b) in enumerate(known)], t).write.parquet(str(tmp_path / "triples.parquet"))
    spark.createDataFrame([(i + 1, "s", f) for i, (f, _, _) in enumerate(known)], "mem_id long, slug string, file string").write.parquet(str(tmp_path / "memories.parquet"))
    got = registry()[0]["shared_entities"](spark, str(tmp_path)).collect()
    assert sorted((r.file, r.other, r.shared) for r in got) == [("a.md", "b.md", 2), ("a.md", "c.md", 1), ("b.md", "c.md", 1)]
