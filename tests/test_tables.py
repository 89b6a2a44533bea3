"""Bins, histograms, roles and scores on hand-made tables."""

import random

import pytest
from pyspark.sql import functions as F

from hostweave.operators import histograms, params, roles, validate
from hostweave.sources.schema import ATTRIBUTES, FEATURES, FLOW_SCHEMA


@pytest.mark.parametrize(("top", "width"), [(15, 1), (19, 1), (20, 1), (199, 1), (200, 2), (1000, 6)])
def test_bin_width(spark, top, width):
    df = spark.createDataFrame([("a", 0, top, 0)], "id string, role int, indegree long, outdegree long")
    row = params.bin_widths(df).first()
    assert (row.in_width, row.out_width) == (width, 1)
    cell = params.degree_hist2d(df).first()
    assert cell.in_lo <= top < cell.in_hi
    assert (cell.out_lo, cell.out_hi, cell.n) == (0, 1, 1)


def test_dense_histogram_has_every_cell(spark):
    df = spark.createDataFrame([("a", 0, 3, 250), ("b", 0, 3, 0)], "id string, role int, indegree long, outdegree long")
    dense = params.degree_hist2d(df, n_bins=30, dense=True)
    assert dense.count() == 900
    assert dense.agg(F.sum("n")).first()[0] == 2
    assert sorted(dense.where("n > 0").collect()) == sorted(params.degree_hist2d(df, n_bins=30).collect())


def sample(spark, values):
    return spark.createDataFrame([("x", float(v)) for v in values], "property string, value double")


def score(spark, a, b):
    return validate.histogram_intersection(sample(spark, a), sample(spark, b)).first().score


def test_histogram_intersection(spark):
    a, b = [0, 0, 1, 1, 2, 5], [0, 1, 1, 3]
    bins = validate.equal_width_histograms(sample(spark, a), sample(spark, b)).orderBy("bin").collect()
    assert [(r.h1, r.h2) for r in bins] == [(5, 3), (1, 1)]
    assert score(spark, a, b) == 1.0
    assert score(spark, b, a) == pytest.approx(4 / 6)
    assert score(spark, a, a) == 1.0
    assert score(spark, [3, 3], [3, 3, 3]) == pytest.approx(2 / 3)
    assert score(spark, [3], [3, 3, 3]) is None


def test_small_values_keep_their_bins(spark):
    def rounded_score(a, b):
        return validate.histogram_intersection(*validate.rounded_to_bins(sample(spark, a), sample(spark, b))).first().score

    # as the PageRank of many hosts: seven decimals of all these are 0
    wide, half = [(i + 0.5) * 1e-10 for i in range(200)], [(i + 0.5) * 0.5e-10 for i in range(200)]
    assert rounded_score(wide, half) == pytest.approx(score(spark, wide, half)) == pytest.approx(0.5, abs=0.02)
    # what only the order of sums parts stays in one bin
    noise = [1e-9 * (1 + i * 1e-16) for i in range(40)]
    assert rounded_score(noise[:20], noise[20:]) == 1.0


@pytest.fixture(scope="module")
def flows(spark):
    """Host c has no role features, one role stays empty, s_tos has nulls."""
    rows = [
        # src, dst, sport, s_tos, bytes, label
        ("a", "b", "80", 0.0, 10, "flow=From-Botnet-V1"),
        ("a", "b", "80", None, 10, "flow=Background"),
        ("a", "a", "0x0303", None, 12, "flow=Background"),
        ("b", "c", "oops", 1.0, 13, "flow=background botnet"),
        ("c", "b", None, 0.0, 14, "flow=From-Botnet-V2"),
    ]
    names = ["src_addr", "dst_addr", "sport", "s_tos", "tot_bytes", "label"]
    df = spark.createDataFrame(rows, "src_addr string, dst_addr string, sport string, s_tos double, tot_bytes long, label string")
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in FLOW_SCHEMA if f.name not in names]
    return df.select("*", *rest)


def test_role_edges_both_ways(spark, flows):
    table = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1)], "node string, role int")
    expected = {(0, 0): 1, (0, 1): 2, (1, 1): 2}
    for hot_rows in (None, 1):
        rows = params.role_edges(flows, table, 3, hot_rows).collect()
        assert {(r.src_role, r.dst_role): r.n for r in rows if r.n} == expected
        assert len(rows) == 9
        assert sum(r.p_joint for r in rows) == pytest.approx(1.0)
        sums = [sum(r.p_trans for r in rows if r.src_role == role) for role in range(3)]
        assert sums == [pytest.approx(1.0), pytest.approx(1.0), 0.0]
    assert {r.role: r.n_nodes for r in params.role_sizes(table, 3).collect()} == {0: 1, 1: 2, 2: 0}


def feature_table(spark, hosts):
    rows = [(h, i, 2 * i, 1.5, 0, 0.0, 1) for i, h in enumerate(hosts)]
    kinds = ["int", "int", "double", "int", "double", "int"]
    return spark.createDataFrame(rows, "id string, " + ", ".join(f"{n} {k}" for n, k in zip(FEATURES, kinds)))


def test_constant_feature_scales_to_zero(spark):
    scaled = roles.zscore(feature_table(spark, "abcd")).collect()
    assert {r.average_neighbor_degree for r in scaled} == {0.0}
    assert sum(r.indegree for r in scaled) == pytest.approx(0.0)
    assert sum(r.indegree**2 for r in scaled) == pytest.approx(4.0)


def test_bot_profile_and_missing_hosts(spark, flows):
    features = feature_table(spark, "xab")
    assert {r.id for r in roles.bot_hosts(flows).collect()} == {"a", "c"}
    assert [r.id for r in roles.missing_bots(flows, features).collect()] == ["c"]
    profile = roles.bot_profile(flows, features).first()
    assert (profile.n_bots, profile.in_min, profile.in_max, profile.out_min) == (2, 1, 1, 2)


def test_scenario_without_bots(spark, flows):
    two = flows.withColumn("scenario", F.when(F.col("src_addr") == "a", "bots").otherwise("quiet"))
    two = two.where("not (scenario = 'quiet' and label like '%Botnet%')")
    features = feature_table(spark, "abc").withColumn("scenario", F.lit("bots"))
    profile = {r.scenario: r for r in roles.bot_profile(two, features).collect()}
    assert profile["bots"].n_bots == 1
    assert profile["quiet"].n_bots == 0
    assert profile["quiet"].in_min is None


def test_equal_distance_takes_the_smaller_role(spark):
    scaled = feature_table(spark, "a").select("id", *[F.lit(0.0).alias(c) for c in FEATURES])
    far, left, right = [[9.0] * 6], [[-1.0] + [0.0] * 5], [[1.0] + [0.0] * 5]
    assert roles.assign_roles(scaled, far + left + right).first().role == 1


def test_kmeans_repeats(spark):
    clump = (F.substring("id", 2, 2).cast("int") % 4) * 100
    features = feature_table(spark, [f"h{i}" for i in range(40)])
    features = features.withColumn("indegree", F.col("indegree") % 3 + clump).withColumn("outdegree", clump)
    first = {r.node: r.role for r in roles.cluster_roles(features, 4, seed=3).collect()}
    assert first == {r.node: r.role for r in roles.cluster_roles(features, 4, seed=3).collect()}
    assert set(first.values()) == {0, 1, 2, 3}
    both = features.withColumn("scenario", F.lit("a")).unionByName(features.withColumn("scenario", F.lit("b")))
    each = roles.cluster_roles(both, 4, seed=3).collect()
    assert {r.node: r.role for r in each if r.scenario == "a"} == first
    assert {r.node: r.role for r in each if r.scenario == "b"} == first


def test_categories_share_all_rows(flows):
    table = histograms.attr_histograms(flows).collect()
    tos = [(r.label, r.n, r.p) for r in sorted(table, key=lambda r: r.bin) if r.attribute == "s_tos"]
    assert tos == [("0.0", 2, 0.4), ("1.0", 1, 0.2)]
    sport = [(r.label, r.n) for r in sorted(table, key=lambda r: r.bin) if r.attribute == "sport"]
    assert sport == [("80", 2), ("0x0303", 1), ("oops", 1)]
    assert "d_tos" not in {r.attribute for r in table}
    assert {r.attribute for r in table} <= {name for name, _ in ATTRIBUTES}


@pytest.mark.parametrize("kind", ["spread", "many_zeros", "two_clumps"])
def test_equal_frequency_bins_like_pandas(spark, kind):
    import pandas as pd

    rng = random.Random(kind)
    draws = {
        "spread": lambda: rng.randrange(10**6),
        "many_zeros": lambda: rng.choice([0, 0, rng.randrange(500)]),
        "two_clumps": lambda: rng.choice([5, 7, rng.randrange(1000)]),
    }
    numbers = [draws[kind]() for _ in range(2503)]
    counts = pd.Series(numbers).value_counts()
    df = spark.createDataFrame(
        [("tot_bytes", str(v), float(v), int(n)) for v, n in counts.items()],
        "attribute string, label string, value double, n long",
    )
    q, expected = 100, None
    while expected is None:
        try:
            expected = pd.qcut(pd.Series(numbers, dtype=float), q).value_counts(sort=False).tolist()
        except ValueError:
            q -= 1
    got = histograms.quantile_histograms(df).orderBy("bin").collect()
    assert [r.n for r in got] == expected
    assert got[0].lo == min(numbers)
    assert got[-1].hi == max(numbers)


def test_histogram_shares_add_up(spark):
    df = spark.createDataFrame(
        [("dur", "1.0", 1.0, 3), ("dur", "2.0", 2.0, 1), ("dur", None, None, 4)],
        "attribute string, label string, value double, n long",
    )
    table = histograms.cumulative(histograms.with_share(histograms.categorical_histograms(df))).orderBy("bin").collect()
    assert [(r.cum_lo, r.cum_hi) for r in table] == [(0.0, 0.375), (0.375, 0.5)]
