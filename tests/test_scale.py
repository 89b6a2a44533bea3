"""Helpers for hot keys and large tables, with limits small enough to reach."""

import random

import pytest
from pyspark.sql import functions as F

from hostweave.operators import scale
from hostweave.operators.scale import Wires, cut, expand, hot_keys, join_small, running_total, skew_join


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows has key 0."""
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.34 else rng.randrange(1, 50), i) for i in range(3000)]
    return spark.createDataFrame(rows, "k int, row int")


def test_skew_join_keeps_every_row(spark, skewed):
    small = spark.range(0, 45).select(F.col("id").cast("int").alias("k"), (F.col("id") * 7).alias("v"))
    hot = hot_keys(skewed.groupBy("k").agg(F.count("*").alias("n")), ["k"], hot_rows=100)
    assert hot.count() >= 1
    for how in ("inner", "left"):
        plain = skewed.join(small, "k", how).select("k", "row", "v")
        salted = skew_join(skewed, small, ["k"], hot, ["row"], how).select("k", "row", "v")
        assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def test_salts_divide_a_hot_key(skewed):
    hot = hot_keys(skewed.groupBy("k").agg(F.count("*").alias("n")), ["k"], hot_rows=100)
    sizes = scale.salted(skewed, ["k"], hot, ["row"]).where("k = 0").groupBy("salt").count().collect()
    assert len(sizes) >= 10
    assert max(r["count"] for r in sizes) < 200


@pytest.mark.parametrize("limit", [200_000, 2])
def test_join_small_with_and_without_broadcast(spark, skewed, monkeypatch, limit):
    monkeypatch.setattr(scale.is_small, "__defaults__", (limit,))
    big = skewed.withColumn("scenario", F.concat(F.lit("s"), F.col("k") % 5))
    small = spark.createDataFrame([(f"s{i}", i * 10) for i in range(5)], "scenario string, v int")
    got = join_small(big, small, ["scenario"]).select("row", "v").collect()
    assert sorted((r.row, r.v) for r in got) == sorted((r.row, int(r.scenario[1:]) * 10) for r in big.collect())


@pytest.mark.parametrize("bucketed", [False, True])
@pytest.mark.parametrize("group", [[], ["g"]])
def test_running_total(spark, bucketed, group):
    rows = [(i % 3, i * 37 % 1000, i % 7) for i in range(1000)]
    df = spark.createDataFrame(rows, "g int, o int, n int").repartition(5)
    bucket = F.floor(F.col("o") / 90) if bucketed else None
    got = {(r.g, r.o): r.before for r in running_total(df, "n", ["o"], group, bucket).collect()}
    expected, sums = {}, {}
    for g, o, n in sorted(rows, key=lambda r: r[1]):
        key = g if group else None
        expected[(g, o)] = sums.get(key, 0)
        sums[key] = sums.get(key, 0) + n
    assert got == expected


def test_expand_numbers_rows_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(scale, "BLOCK_ROWS", 4)
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 4), ("d", 11)], "k string, n long")
    got = sorted((r.k, r.i) for r in expand(df, "n", "i").collect())
    assert got == [("b", 0)] + [("c", i) for i in range(4)] + sorted(("d", i) for i in range(11))


def test_wires_do_not_shuffle_links_again(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = cut(spark.range(5000).selectExpr("id % 300 as id", "id % 77 as nbr"))
        wires = Wires(links)
        state = cut(spark.range(77).selectExpr("id", "id * 2 as v"))
        plan = wires.carry(state, "v")._jdf.queryExecution().executedPlan().toString()
        round_plan = plan.split("InMemoryRelation")[0]
        assert "SortMergeJoin" in round_plan
        assert "Exchange" not in round_plan.split("InMemoryTableScan")[0]
        wires.close()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("hot_rows", [None, 5])
def test_wires_carry_every_link(spark, hot_rows):
    links = cut(spark.range(500).selectExpr("id % 50 as id", "if(id % 3 = 0, 0, id % 11) as nbr"))
    wires = Wires(links, hot_rows)
    state = spark.range(11).selectExpr("id", "id * 2 as v")
    got = sorted((r.id, r.v) for r in wires.carry(state, "v").collect())
    assert got == sorted((r.id, r.nbr * 2) for r in links.collect())
    assert (wires.hot is not None) == (hot_rows is not None)
    wires.close()


def test_running_total_buckets_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(scale, "PARTITION_ROWS", 10)
    rows = spark.range(200).select(F.col("id").alias("v"), F.lit(2).alias("n"))
    found = scale.running_total(rows, "n", ["v"]).orderBy("v").collect()
    assert [r.before for r in found] == [2 * i for i in range(200)]


def test_wires_are_closed_after_a_failure(spark):
    links = spark.createDataFrame([("a", "b")], "id string, nbr string")
    with pytest.raises(ZeroDivisionError):
        with scale.Wires(scale.cut(links)) as wires:
            raise ZeroDivisionError
    assert not wires.links.storageLevel.useMemory and not wires.links.storageLevel.useDisk


def test_only_plain_local_mode_gets_a_temporary_folder(spark):
    class Context:
        master = "local-cluster[2,1,1024]"
        _jsc = spark.sparkContext._jsc

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scale.checkpoint_folder(Session())
