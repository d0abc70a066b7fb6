import math
from decimal import Decimal

import numpy as np
import pytest

from caselight.llm import embedding_whitening, graph_search

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def vectors(spark):
    """Clustered vectors with copies, odd rows and columns whose names clash with helpers."""
    random = np.random.default_rng(3)
    centres = random.normal(size=(8, 12))
    x = (centres[random.integers(0, 8, 400)] + 0.3 * random.normal(size=(400, 12))) * random.uniform(0.5, 2, (400, 1))
    x[300:340] = x[0]  # forty copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1020, [1.0] * 11 + [NAN]), (1040, [1.0] * 11 + [INF]), (1060, [1.0] * 11 + [None]), (1080, [1.0] * 3), (1100, []), (None, [0.5] * 12)]
    table = spark.createDataFrame([(i, v, "c", 1) for i, v in rows + odd], "vec_id long, embedding array<double>, block string, id int")
    return table.repartition(5), x


# ---- operator 13 ----------------------------------------------------------------

def plain_whitening(x, k):
    grid = np.floor(64 * x).astype(np.int64) + 1_000_000
    n, total = len(grid), grid.sum(axis=0)
    centred = grid - total / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    return ((n * grid - total).astype(object) ** 2).sum(axis=1), centred @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


@pytest.mark.parametrize("block_rows", [7, 64, 1000])
def test_whitening_equals_a_plain_one(vectors, block_rows):
    table, x = vectors
    x = np.concatenate([x, np.full((1, 12), 0.5)])  # the row without an id takes part
    deviation, z, explained = plain_whitening(x, 5)
    rows = embedding_whitening.whitened(table, components=5, block_rows=block_rows).collect()
    assert len(rows) == 5 * len(x) and {r["n"] for r in rows} == {len(x)}
    assert max(r["identity_error"] for r in rows) < 1e-9
    for k in range(5):
        own = {r["vec_id"]: r for r in rows if r["component"] == k + 1}
        got = np.array([own[i]["whitened"] for i in [*range(400), None]])
        assert min(np.abs(got - z[:, k]).max(), np.abs(got + z[:, k]).max()) < 1e-8
        assert [own[i]["deviation"] for i in [*range(400), None]] == [Decimal(d) for d in deviation]
        assert math.isclose(own[0]["explained"], explained[k], rel_tol=1e-9)


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert embedding_whitening.whitened(spark.createDataFrame([], schema)).collect() == []
    assert embedding_whitening.whitened(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)
    assert embedding_whitening.whitened(one).collect() == []  # nothing varies
    flat = spark.createDataFrame([(i, [float(i % 4), 3.0]) for i in range(8)] + [(3, [3.0, 3.0])], schema)
    out = embedding_whitening.whitened(flat).collect()
    assert {r["component"] for r in out} == {1} and len(out) == 9 and all(r["explained"] == 1 for r in out)
    assert abs(sum(r["whitened"] for r in out)) < 1e-9


def test_squares_are_exact_beyond_64_bits():
    v = np.array([[2**40, 3], [1, -(2**40)]])
    assert embedding_whitening._squares(v) == [Decimal(2**80 + 9), Decimal(2**80 + 1)]


# ---- operator 11 ----------------------------------------------------------------

def nearest(ids, x, query, k):
    scores = (x[query] * x).sum(axis=1)
    order = sorted((j for j in range(len(ids)) if ids[j] != ids[query]), key=lambda j: (-scores[j], ids[j]))
    return [(ids[j], scores[j]) for j in order[:k]]


def answers(out):
    found = {}
    for r in sorted(out.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


def test_small_shards_are_searched_whole(vectors):
    table, x = vectors
    ids = list(range(400))
    own = graph_search.vectors_of(table)
    assert sorted(r["id"] for r in own.collect()) == ids
    index = graph_search.build_index(own, shard_rows=60)
    assert index.count() > 1
    found = answers(graph_search.search(index, own.where("id % 20 = 0"), k=20, part_queries=7))
    assert sorted(found) == list(range(0, 400, 20))
    for query, got in found.items():
        want = nearest(ids, x, query, 20)
        assert [i for i, _ in got] == [i for i, _ in want]  # copies tie and follow by id
        assert np.allclose([s for _, s in got], [s for _, s in want], rtol=1e-14)


def test_graphs_find_nine_of_ten():
    random = np.random.default_rng(1)
    x = random.normal(size=(3000, 24))
    unit = graph_search._metric(x, float(np.sqrt((x * x).sum(axis=1).max())))
    graph = graph_search.build_graph(unit)
    assert (graph.edges < len(x)).all() and not (graph.edges == np.arange(len(x))[:, None]).any()
    aimed = np.concatenate([x[:100], np.zeros((100, 1))], axis=1).astype(np.float32)
    nodes, _ = graph.walk(aimed, graph_search.SEARCH_BEAM)
    truth = np.argsort(-(x[:100] @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(truth, nodes)]) >= 0.9


def test_pruning_keeps_the_nearest_and_what_it_does_not_cover():
    points = np.array([[0, 0], [1, 0], [1.05, 0], [0, 2], [-3, 0]], np.float32)
    graph = graph_search._Graph(points, np.full((5, 3), -1, np.int64), np.array([0]))
    graph.prune(np.array([0]), np.array([[1, 2, 3, 4, 1, -1]]), 1.2)
    assert graph.edges[0].tolist() == [1, 3, 4]  # 2 is closer to 1 than to 0


def test_search_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    for rows, want in (
        ([], {}), ([(1, None), (2, [0.0, 0.0])], {}), ([(0, [1.0, 0.0])], {}),
        ([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [2.0, 0.0]), (20, [1.0, 0.0])], {0: [(1, 1.0), (20, 1.0)], 20: [(0, 1.0), (1, 1.0)]}),
    ):
        own = graph_search.vectors_of(spark.createDataFrame(rows, schema))
        assert answers(graph_search.search(graph_search.build_index(own), own.where("id % 20 = 0"))) == want
