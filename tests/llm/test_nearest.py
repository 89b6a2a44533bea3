import numpy as np
import pytest

from hostweave.llm import nearest as N

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string, list int, v string, ids string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, "s", 2, "v", "i") for i, v in rows], SCHEMA)


def plain(rows, k=5, every=50):
    length = 8
    good = []
    for i, v in dict.fromkeys((i, tuple(np.float32(x) if x is not None else None for x in v)) for i, v in rows if i is not None and v is not None):
        if len(v) == length and None not in v:
            x = np.array(v, float)
            if np.isfinite(x).all() and (x != 0).any():
                good.append((i, x))
    out = {}
    for q, x in good:
        if q % every == 0:
            found = sorted((-float((x * y).sum() / np.sqrt((x * x).sum()) / np.sqrt((y * y).sum())), i) for i, y in good if i != q)
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


def check(spark, rows, recall=1.0):
    found = {}
    for r in N.neighbours(table(spark, rows)).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = plain(rows)
    assert set(found) == {q for q, v in want.items() if v}
    hit = total = 0
    for q, near in want.items():
        got = sorted(found.get(q, []))
        assert [r for r, _, _ in got] == list(range(1, len(got) + 1))
        assert len(got) == len(near)
        scores = dict(near)
        for _, i, s in got:
            if i in scores:
                assert s == pytest.approx(scores[i], abs=1e-12)
        if recall == 1.0:
            # equal but for rounding of equal scores
            assert [round(s, 12) for _, _, s in got] == [round(s, 12) for _, s in near]
        hit += sum(i in scores for _, i, _ in got)
        total += len(near)
    assert hit >= recall * total


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)]
    rows += [(200, None), (250, [0.0] * 8), (300, [float("nan")] + [1.0] * 7), (350, [None] + [1.0] * 7), (400, [1.0] * 7), (450, [float("inf")] * 8), (500, [-0.0] * 8)]
    rows += [(None, [1.0] * 8), rows[0], rows[7], (550, [2.0 * x for x in rows[3][1]]), (600, rows[50][1]), (-50, [1e-30] * 8), (650, [3e38] * 8)]
    check(spark, rows)


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0] * 8) for i in range(60)] + [(100, [1.0] * 7 + [0.5]), (101, [1.0] * 7 + [0.5])]
    found = N.neighbours(table(spark, rows)).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in found if r.query_id == 0] == [1, 2, 3, 4, 5]
    assert [r.vec_id for r in found if r.query_id == 50] == [0, 1, 2, 3, 4]
    assert [r.vec_id for r in found if r.query_id == 100] == [101, 0, 1, 2, 3]


@pytest.mark.parametrize("rows", [[], [(0, None)], [(0, [1.0] * 8)], [(0, [1.0] * 8), (1, [0.5] * 8)], [(1, [1.0] * 8)]])
def test_few_rows(spark, rows):
    check(spark, rows)


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(N, "PART_VECTORS", 40)
    monkeypatch.setattr(N, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 8))
    rows = [(i, (centres[rng.integers(30)] + 0.4 * rng.normal(size=8)).tolist()) for i in range(4000)]
    rows += [(5000 + i, rows[9][1]) for i in range(1500)]
    check(spark, rows, 0.9)


def test_graph_search_finds_nearest_centroids():
    rng = np.random.default_rng(3)
    c = N.unit(rng.normal(size=(700, 16)))
    graph, x = N.Graph.build(c), N.unit(rng.normal(size=(60, 16)))
    ids, _ = graph.search(x)
    best = np.argsort(-(x @ c.T), 1)[:, :10]
    assert np.mean([len(set(a) & set(b[:10])) for a, b in zip(best, ids, strict=True)]) > 9
    assert (np.bincount(graph.lists(x)[0]) <= N.REPLICAS).all()


def test_lists_are_balanced():
    x = N.unit(np.random.default_rng(4).normal(size=(1024, 8)))
    assert len(N.balanced_centroids(x, 16)) == 16
    assert len(N.balanced_centroids(x[:3], 16)) <= 3
