"""Hand-made graphs with known answers, each also run with every key treated as hot."""

import pytest
from pyspark.sql import functions as F

from hostweave.operators import graph, pagerank, peeling, triangles

# node: in, out, average neighbour degree, triangles, directed clustering, k-core value, core number, PageRank
GRAPHS = {
    "star": (
        [("c", "a"), ("c", "b"), ("c", "d"), ("c", "e")],
        {"c": (0, 4, 1.0, 0, 0, 2, 1, 0.170940)}
        | {n: (1, 0, 4.0, 0, 0, 1, 1, 0.207265) for n in "abde"},
    ),
    "triangle_with_tail": (
        [("1", "2"), ("2", "3"), ("3", "1"), ("3", "4"), ("4", "5")],
        {
            "1": (1, 1, 2.5, 1, 1, 2, 2, 0.169032),
            "2": (1, 1, 2.5, 1, 1, 2, 2, 0.209250),
            "3": (1, 2, 2.0, 1, 1 / 3, 2, 2, 0.243435),
            "4": (1, 1, 2.0, 0, 0, 1, 1, 0.169032),
            "5": (1, 0, 2.0, 0, 0, 1, 1, 0.209250),
        },
    ),
    "reciprocal_triangle": (
        [(a, b) for a in "123" for b in "123" if a != b],
        {n: (2, 2, 4.0, 1, 2, 4, 2, 0.333333) for n in "123"},
    ),
    "self_loops": (
        [(str(a), str(b)) for b in range(1, 6) for a in range(1, b)] + [("1", "1"), ("6", "6"), ("5", "7")],
        {
            "1": (1, 5, 4.833333, 6, 1, 6, 4, 0.063941),
            "2": (1, 3, 4.75, 6, 1, 4, 4, 0.063941),
            "3": (2, 2, 4.75, 6, 1, 4, 4, 0.082056),
            "4": (3, 1, 4.75, 6, 1, 4, 4, 0.116921),
            "5": (4, 1, 3.8, 6, 0.6, 4, 4, 0.216244),
            "6": (1, 1, 2.0, 0, 0, 2, 0, 0.220375),
            "7": (1, 0, 5.0, 0, 0, 1, 1, 0.236521),
        },
    ),
    "mixed": (
        [("1", "2"), ("2", "1"), ("2", "3"), ("3", "1"), ("3", "4"), ("4", "3"), ("4", "1")],
        {
            "1": (3, 1, 3.25, 2, 1, 4, 2, 0.319333),
            "2": (1, 2, 4.0, 1, 1, 3, 2, 0.301127),
            "3": (2, 2, 3.25, 2, 1, 4, 2, 0.231563),
            "4": (1, 2, 4.0, 1, 1, 3, 2, 0.147977),
        },
    ),
}


@pytest.fixture(scope="module")
def edge_list(spark):
    """All graphs at once, one scenario each."""
    rows = [(name, a, b) for name, (pairs, _) in GRAPHS.items() for a, b in pairs]
    return spark.createDataFrame(rows, "scenario string, src string, dst string").cache()


def values(df, column, digits=6):
    rows = df.select("scenario", "id", F.round(F.col(column).cast("double"), digits)).collect()
    return {(r[0], r[1]): r[2] for r in rows}


def expected(position):
    return {
        (name, node): pytest.approx(row[position], abs=2e-6)
        for name, (_, nodes) in GRAPHS.items()
        for node, row in nodes.items()
    }


def test_degrees(edge_list):
    df = graph.degrees(edge_list)
    assert values(df, "indegree") == expected(0)
    assert values(df, "outdegree") == expected(1)


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_avg_neighbor_degree(edge_list, hot_rows):
    df = graph.avg_neighbor_degree(edge_list, hot_rows)
    assert values(df, "average_neighbor_degree") == expected(2)


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_triangles_and_clustering(edge_list, hot_rows):
    df = triangles.triangle_features(edge_list, hot_rows).cache()
    assert values(df, "triangles") == expected(3)
    assert values(df, "clustering_directed") == expected(4)


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_k_core(edge_list, hot_rows):
    assert values(peeling.k_core(edge_list, hot_rows=hot_rows), "kCore") == expected(5)


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_core_number(edge_list, hot_rows):
    assert values(peeling.core_number(edge_list, hot_rows), "core") == expected(6)


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_pagerank_static(edge_list, hot_rows):
    assert values(pagerank.pagerank_static(edge_list, hot_rows=hot_rows), "pagerank") == expected(7)


def test_pagerank_without_scenario(edge_list):
    one = edge_list.where("scenario = 'mixed'").drop("scenario")
    got = {r.id: r.pagerank for r in pagerank.pagerank_static(one).collect()}
    assert got == {n: pytest.approx(v[7], abs=2e-6) for n, v in GRAPHS["mixed"][1].items()}
