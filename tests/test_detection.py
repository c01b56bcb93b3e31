"""The detection queries on whole embeddings, against numpy."""

import numpy as np
import pytest

from palaver.operators.detect import leader_clusters
from palaver.plans import queries


@pytest.fixture(scope="module")
def embeddings(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in rng.normal(size=64).astype(np.float32)], k % 2) for k in range(60)]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder), [(k, np.array(v), f"g{label}") for k, v, label in rows]


def cos(a, b):
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def test_pool_is_of_all_coordinates_by_label(spark, embeddings):
    folder, rows = embeddings
    got = {r.grp: r for r in queries()["det_embedding_pool"](spark, folder).collect()}
    assert set(got) == {"g0", "g1"}
    for g, r in got.items():
        mean = np.mean([v for _, v, h in rows if h == g], axis=0)
        assert len(r) == 65 and np.allclose(r[1:], mean / np.linalg.norm(mean), atol=1e-5)


def test_contradiction_is_of_all_coordinates_by_label(spark, embeddings):
    folder, rows = embeddings
    got = {r.grp: r.contradiction for r in queries()["det_contradiction"](spark, folder).collect()}
    for g in ("g0", "g1"):
        own = [v for _, v, h in rows if h == g]
        assert abs(got[g] - (1 - np.mean([max(0.0, cos(own[0], v)) for v in own[1:]]))) < 1e-4


def test_leaders_are_of_all_coordinates_by_label(spark, embeddings):
    folder, rows = embeddings
    want, leaders = {}, {}
    for k, v, g in rows:
        for j, u in leaders.setdefault(g, []):
            if cos(v, u) >= 0.3:
                want[k] = j
                break
        else:
            leaders[g].append((k, v))
            want[k] = k
    got = {r.pos: r.leader for r in queries()["det_leader_cluster"](spark, folder).collect()}
    assert got == want


def test_a_hot_group_of_many_leaders(spark):
    """1,500 leaders of one group and items with no direction."""
    rng = np.random.default_rng(3)
    units = rng.normal(size=(1500, 32))
    rows = [("hot", k, [float(x) for x in v]) for k, v in enumerate(units)]
    rows += [("hot", 1500 + k, [float(2 * x) for x in v]) for k, v in enumerate(units)]
    rows += [("none", 5000, None), ("none", 5001, [0.0] * 32), ("none", 5002, [1.0, None]), (None, 5003, [1.0]), (None, 5004, [2.0])]
    got = {r.o: r.leader for r in leader_clusters(spark.createDataFrame(rows, "g string, o bigint, v array<double>"), "g", "o", "v", 0.999).collect()}
    assert all(got[k] == k % 1500 for k in range(3000))
    assert [got[k] for k in range(5000, 5005)] == [5000, 5001, 5002, 5003, 5003]
