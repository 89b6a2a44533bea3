"""Triangle estimates against exact counts."""

import itertools
import random

import pytest

from hostweave.operators import estimates as E
from hostweave.operators.scale import cut


def graph(rng, n, edges, hub=0):
    pairs = [(f"h{rng.randrange(n)}", f"h{rng.randrange(n)}") for _ in range(edges)]
    return pairs + [("hub", f"h{i}") for i in range(hub)]


def exact(pairs):
    edges = {frozenset(p) for p in pairs if p[0] != p[1]}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return sum(len(near[a] & near[b]) for a, b in edges) // 3


def test_all_edges_count_exactly(spark):
    rng = random.Random(1)
    rows = [(s, a, b) for s, n in (("x", 12), ("y", 25)) for a, b in graph(rng, n, 90, n)] + [("z", "a", "a"), ("z", "a", "b")]
    df = cut(spark.createDataFrame(rows, "scenario string, src string, dst string"))
    for hot_rows in (None, 3):
        got = {r.scenario: (r.triangles, r.variance) for r in E.triangle_estimate(df, 1.0, hot_rows=hot_rows).collect()}
        assert got == {s: (exact([r[1:] for r in rows if r[0] == s]), 0.0) for s in "xyz"}


def test_estimate_and_variance(spark):
    """Over many seeds the mean is the exact number, and values spread as the variance says."""
    rng = random.Random(2)
    pairs = graph(rng, 40, 500, 40)
    df = cut(spark.createDataFrame(pairs, "src string, dst string"))
    want = exact(pairs)
    found = [E.triangle_estimate(df, 0.6, seed).first() for seed in range(12)]
    mean = sum(r.triangles for r in found) / len(found)
    variance = sum(r.variance for r in found) / len(found)
    assert abs(mean - want) <= 4 * (variance / len(found)) ** 0.5
    spread = sum((r.triangles - want) ** 2 for r in found) / len(found)
    assert 0.2 * variance <= spread <= 4 * variance


def test_kept_edges(spark):
    pairs = [(f"h{a:02}", f"h{b:02}") for a, b in itertools.permutations(range(60), 2)] + [("h1", "h1")]
    df = spark.createDataFrame(pairs, "src string, dst string")
    kept = E.kept_edges(df, 0.25).collect()
    assert len(kept) == len({(r.src, r.dst) for r in kept}) and all(r.src < r.dst for r in kept)
    assert abs(len(kept) / 1770 - 0.25) < 0.05
    assert E.kept_edges(df, 0.25).collect() == kept or sorted(E.kept_edges(df, 0.25).collect()) == sorted(kept)


def test_no_edges(spark):
    empty = spark.createDataFrame([], "src string, dst string")
    assert [tuple(r) for r in E.triangle_estimate(empty).collect()] == [(0.0, 0.0)]
    with pytest.raises(Exception):
        E.triangle_estimate(spark.createDataFrame([("a",)], "src string")).collect()
