"""States of logs that are merged instead of reading the logs again."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostweave.operators import sketches as S
from hostweave.operators.scale import cut
from hostweave.sources.schema import FLOW_COLUMNS

KINDS = ", ".join(f"{name} {kind.simpleString()}" for _, name, kind in FLOW_COLUMNS)


def flows(spark, rows):
    """Flows of (scenario, src_addr, dst_addr, dur, tot_bytes)."""
    names = [name for _, name, _ in FLOW_COLUMNS]
    made = [(r[0], *[dict(zip(("src_addr", "dst_addr", "dur", "tot_bytes"), r[1:], strict=True)).get(n) for n in names]) for r in rows]
    return spark.createDataFrame(made, f"scenario string, {KINDS}")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    found = [(s, f"h{rng.randrange(9000 + 3000 * i)}", f"h{rng.randrange(4000)}", rng.expovariate(1) ** 3, rng.choice([40, 40, 40, 60, rng.randrange(10**6)])) for i, s in enumerate("abc") for _ in range(20_000)]
    return [*found, ("a", None, "x", None, None), ("b", "y", None, float("nan"), 1), ("c", None, None, float("inf"), 2)]


def shares(values, table):
    """Share of the values in each interval."""
    values = np.sort(values)
    out = []
    for r in table:
        low = 0 if r.bin == 1 else np.searchsorted(values, r.lo, "right")
        out.append((np.searchsorted(values, r.hi, "right") - low) / len(values))
    return out


def test_histograms_of_merged_sketches(spark, rows):
    parts = cut(S.attribute_sketches(flows(spark, rows)))
    assert parts.where("attribute = 'd_tos'").count() == 0
    table = S.sketch_histograms(S.merged_attributes(parts)).orderBy("bin").collect()
    for name, column in (("dur", 3), ("tot_bytes", 4)):
        values = np.array([float(r[column]) for r in rows if r[column] is not None and np.isfinite(r[column])])
        own = [r for r in table if r.attribute == name]
        assert own[0].total == len(values) and (own[0].lo, own[-1].hi) == (values.min(), values.max())
        assert [r.bin for r in own] == list(range(1, len(own) + 1)) and all(a.hi == b.lo for a, b in zip(own, own[1:], strict=False))
        for r, exact in zip(own, shares(values, own), strict=True):
            assert abs(r.p - exact) <= 2 * (S.RANK_ERROR + 1 / S.GRID)
        assert abs(sum(r.p for r in own) - 1) < 1e-9
    # all values of dur differ, so nothing keeps it from the most intervals; two fifths of tot_bytes are one value
    assert sum(r.attribute == "dur" for r in table) == 100
    assert 1 < sum(r.attribute == "tot_bytes" for r in table) < 10


def test_merging_sketches_keeps_ranks(spark, rows):
    log = flows(spark, rows)
    by_scenario = S.merged_attributes(S.attribute_sketches(log)).where("attribute = 'dur'")
    whole = S.attribute_sketches(log.drop("scenario")).where("attribute = 'dur'").select("attribute", "n", "least", "most", "sketch")
    values = np.sort([r[3] for r in rows if r[3] is not None and np.isfinite(r[3])])
    for table in (by_scenario, whole):
        got = table.select("n", "least", "most", F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(k / 20) for k in range(1, 20)])).alias("q")).first()
        assert (got.n, got.least, got.most) == (len(values), values[0], values[-1])
        ranks = np.searchsorted(values, got.q, "right") / len(values)
        assert np.abs(ranks - np.arange(1, 20) / 20).max() <= S.RANK_ERROR + 1 / len(values)


def test_host_counts(spark, rows):
    sets = {s: ({r[1] for r in rows if r[0] == s} - {None}, {r[2] for r in rows if r[0] == s} - {None}) for s in "abc"}
    parts = cut(S.host_sketches(flows(spark, rows)))
    before = set()
    changes = {r.scenario: r for r in S.host_changes(parts).collect()}
    for r in S.distinct_hosts(parts).orderBy("scenario").collect():
        sources, targets = sets[r.scenario]
        hosts = sources | targets
        near = lambda got, exact, whole: abs(got - len(exact)) <= S.COUNT_ERROR * len(whole)
        assert near(r.n_hosts, hosts, hosts) and near(r.n_sources, sources, sources) and near(r.n_both, sources & targets, hosts)
        assert r.n_targets == len(targets)  # below 2 ** LG_K it is exact
        c = changes[r.scenario]
        for got, exact in ((c.n_hosts, hosts), (c.n_stayed, hosts & before), (c.n_new, hosts - before), (c.n_gone, before - hosts), (c.n_together, hosts | before)):
            assert near(got, exact, hosts | before)
        before = hosts


def test_states_are_added_without_the_old_logs(spark, rows, tmp_path):
    log = flows(spark, rows)
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    S.add_states(log, one)
    S.add_states(log.where("scenario <> 'c'"), two)
    old = {f: f.stat().st_mtime_ns for f in Path(two).rglob("*.parquet")}
    S.add_states(log.where("scenario = 'c'"), two)
    # what is stored stays as it is, and only the new log is read
    assert {f: f.stat().st_mtime_ns for f in old} == old
    (attributes, hosts), (attributes2, hosts2) = S.read_states(spark, one), S.read_states(spark, two)
    key = lambda df: sorted(map(str, df.select("scenario", "attribute", "n", "least", "most").collect()))
    assert key(attributes) == key(attributes2) and attributes.count() > 3
    assert sorted(map(tuple, S.host_changes(hosts).collect())) == sorted(map(tuple, S.host_changes(hosts2).collect()))
    table = S.sketch_histograms(S.merged_attributes(attributes2)).where("attribute = 'dur'").orderBy("bin").collect()
    values = np.array([r[3] for r in rows if r[3] is not None and np.isfinite(r[3])])
    assert all(abs(r.p - exact) <= 2 * (S.RANK_ERROR + 1 / S.GRID) for r, exact in zip(table, shares(values, table), strict=True))


def test_no_flows(spark):
    empty = flows(spark, [])
    assert S.attribute_sketches(empty).count() == 0
    assert S.sketch_histograms(S.attribute_sketches(empty)).count() == 0
    assert S.host_changes(S.host_sketches(empty)).count() == 0
    nulls = flows(spark, [("a", None, None, None, None)])
    assert [tuple(r) for r in S.distinct_hosts(S.host_sketches(nulls)).collect()] == [("a", 0, 0, 0, 0)]
