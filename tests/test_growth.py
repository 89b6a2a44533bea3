"""Work and memory that must not grow faster than the input."""

import re

from pyspark.sql import functions as F

from hostweave.functions.columns import scenario_of
from hostweave.operators import distance, peeling, scale, vectors
from hostweave.plans import catalog
from hostweave.sources import flow_csv, flow_log


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scenario_of_searches_no_pattern(spark):
    paths = [
        "file:/a/log.binetflow", "file:/a/log.part.csv", "file:/logs/scenario=A/part-00000-x.c000.csv", "file:/a/b.csv/part-1.csv",
        "file:/a/..b.c/part-0", "part-0.csv", "a//part-0.csv", "file:/a/.hidden", "file:/a/...", "x", "", "/", "a/.../part-7.csv",
        "file:/a/scenario=B.csv", "file:/a.b/c", "file:/a/part-1/b", "/part-1", "file:/a/scenario=", "scenario=a/b.c",
    ]
    table = spark.createDataFrame([(p,) for p in paths], "path string")
    found = {r.path: r.scenario for r in table.select("path", scenario_of(F.col("path")).alias("scenario")).collect()}
    assert found == {p: flow_log.scenario_of(p) for p in paths}
    assert not re.search("regexp|rlike", plan_of(table.select(scenario_of(F.col("path")))).lower())


def test_running_total_gives_no_task_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(scale, "PARTITION_ROWS", 500)
    rows = spark.range(30_000).select("id", (F.col("id") % 7).alias("n"))
    total = scale.running_total(rows, "n", ["id"]).select("id", "before", F.spark_partition_id().alias("task"))
    seen = total.groupBy("task").agg(F.count("*").alias("rows")).agg(F.max("rows"), F.sum("rows")).first()
    assert seen[0] <= 30_000 / 4 / 2 and seen[1] == 30_000
    last = total.where("id = 29999").first()["before"]
    assert last == sum(i % 7 for i in range(29_999))


def test_ordered_csv_has_parts_for_its_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(scale, "PARTITION_ROWS", 500)
    rows = spark.range(10_000).select(F.col("id").cast("string").alias("StartTime"), "id").repartition(3)
    flow_csv.write_flows_csv(rows, str(tmp_path / "csv"))
    files = sorted((tmp_path / "csv").glob("part-*"))
    assert len(files) >= 15
    written = [line for f in files for line in f.read_text().splitlines() if line != "StartTime,id"]
    assert written == [f"{i},{i}" for i in sorted(map(str, range(10_000)))]


def test_core_number_sends_only_what_fell(spark, monkeypatch):
    """A long path falls end by end; the links must not be sent whole round after round."""
    sent = []
    carry = scale.Wires.carry

    def counted(self, state, *values, **more):
        found = carry(self, state, *values, **more)
        sent.append(found.count())
        return found

    monkeypatch.setattr(scale.Wires, "carry", counted)
    path = [(f"p{i:02}", f"p{i + 1:02}") for i in range(16)]
    clique = [(f"c{i}", f"c{j}") for i in range(5) for j in range(i)]
    edge_list = scale.cut(spark.createDataFrame([*path, *clique, ("p00", "c0"), ("p03", "p03")], "src string, dst string"))
    cores = {r["id"]: r["core"] for r in peeling.core_number(edge_list).collect()}
    assert cores == {n: 4 if n[0] == "c" else 1 for n in cores} and len(cores) == 22
    assert sent[0] == 54 and sum(sent[1:]) <= 54


def test_concatenated_logs_have_parts_for_their_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(catalog, "PARTITION_ROWS", 400)
    monkeypatch.setattr(catalog, "fresh", lambda _, name: str(tmp_path / name))
    n = F.col("id")
    numbers = {"l_orderkey": n, "l_partkey": n % 50, "l_suppkey": n % 9, "l_linenumber": (n % 4).cast("int"), "l_quantity": n % 50 + 0.0}
    numbers |= {"l_extendedprice": n * 1.5, "l_discount": n % 3 / 10, "l_tax": n % 2 / 10}
    words = {"l_returnflag": F.lit("A"), "l_linestatus": F.lit("F"), "l_shipdate": F.lit("1995-01-01").cast("timestamp")}
    spark.range(2_000).select(*[c.alias(k) for k, c in (numbers | words).items()]).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = catalog.flow_csv_concatenated(spark, str(tmp_path))
    assert len(list((tmp_path / "parts").glob("part-*"))) == 20
    expected = catalog.flows(spark, str(tmp_path))
    assert found.exceptAll(expected).count() == expected.exceptAll(found).count() == 0


def _ring_with_hub(spark):
    """150 hosts in a ring, all linked with a hub: 300 edges, so three words of bits."""
    ring = [(f"r{i:03}", f"r{(i + 1) % 150:03}") for i in range(150)]
    return scale.cut(spark.createDataFrame(ring + [(f"r{i:03}", "hub") for i in range(150)], "src string, dst string"))


def _rows_sent(monkeypatch):
    sent = []
    carry = vectors.Grid.carry

    def counted(self, state, vec):
        found = scale.cut(carry(self, state, vec))
        sent.append(found.count())
        return found

    monkeypatch.setattr(vectors.Grid, "carry", counted)
    return sent


def test_harmonic_sends_vectors_not_a_row_for_each_link_and_word(spark, monkeypatch):
    sent = _rows_sent(monkeypatch)
    found = {r["id"]: r["harmonic"] for r in distance.harmonic_exact(_ring_with_hub(spark)).collect()}
    assert found == {n: 150.0 if n == "hub" else 3 + 147 / 2 for n in found} and len(found) == 151
    # 600 links and three words; a host gets one vector from each cell it has links in, and no hop is made to find nothing
    assert len(sent) == 2 and max(sent) <= 151 * 4


def test_betweenness_sends_vectors_not_a_row_for_each_link_and_pivot(spark, monkeypatch):
    sent = _rows_sent(monkeypatch)
    pairs = [(f"r{i:03}", "hub") for i in range(150)] + [("hub", f"s{i}") for i in range(10)]
    edge_list = scale.cut(spark.createDataFrame(pairs, "src string, dst string"))
    found = {r["id"]: round(r["betweenness"], 9) for r in distance.betweenness(edge_list).collect()}
    assert found == {n: round(1500 / 160 / 159, 9) if n == "hub" else 0.0 for n in found} and len(found) == 161
    # a row for each link and pivot would be 1,500 from the hub
    assert max(sent) <= 161
