"""Reading flow logs and writing results, in a fresh folder."""

import datetime

import pytest
from pyspark.sql import functions as F

from hostweave.functions import columns
from hostweave.operators import graph, synth
from hostweave.sources import flow_csv
from hostweave.sources.schema import FLOW_COLUMNS

HEADER = [name for name, _, _ in FLOW_COLUMNS]
FLOW = {
    "StartTime": "2011/08/10 09:46:53.047277",
    "Dur": "3550.182373",
    "Proto": "udp",
    "SrcAddr": "212.50.71.179",
    "Sport": "39678",
    "Dir": "  <->",
    "DstAddr": "147.32.84.229",
    "Dport": "0x0303",
    "State": "CON",
    "sTos": "0",
    "dTos": "",
    "TotPkts": "12",
    "TotBytes": "875",
    "SrcBytes": "413",
    "Label": "flow=Background-UDP-Established",
}


def write(path, rows, header=HEADER):
    path.write_text("\n".join([",".join(header), *[",".join(row[c] for c in header) for row in rows]]) + "\n")


@pytest.fixture()
def logs(tmp_path):
    folder = tmp_path / "input"
    folder.mkdir()
    write(folder / "5.binetflow", [FLOW, FLOW | {"SrcAddr": "1.1.1.1", "TotBytes": "many"}])
    write(folder / "11.more.binetflow", [FLOW | {"Label": "flow=From-Botnet-V51-1"}])
    return folder


def test_read_flows(spark, logs):
    rows = flow_csv.read_flows(spark, str(logs)).orderBy("scenario", "src_addr").collect()
    assert [r.scenario for r in rows] == ["11", "5", "5"]
    first = rows[0]
    assert first.start_time == datetime.datetime(2011, 8, 10, 9, 46, 53, 47277)
    assert (first.dur, first.s_tos, first.d_tos, first.tot_pkts) == (3550.182373, 0.0, None, 12)
    assert first.dport == "0x0303"
    assert rows[1].tot_bytes is None
    assert rows[2].tot_bytes == 875


def test_columns_are_found_by_name(spark, tmp_path):
    write(tmp_path / "a.binetflow", [FLOW], [c for c in reversed(HEADER) if c != "Dir"])
    row = flow_csv.read_flows(spark, str(tmp_path)).first()
    assert (row.src_addr, row.dst_addr, row.dir, row.tot_pkts) == ("212.50.71.179", "147.32.84.229", None, 12)


def test_empty_part_is_skipped(spark, tmp_path):
    folder = tmp_path / "log.csv"
    folder.mkdir()
    write(folder / "part-0.csv", [FLOW])
    (folder / "part-1.csv").write_text("")
    rows = flow_csv.read_flows(spark, str(folder)).collect()
    assert [(r.scenario, r.src_addr) for r in rows] == [("log", "212.50.71.179")]


def test_unused_columns_are_not_read(spark, logs):
    plan = graph.edges(flow_csv.read_flows(spark, str(logs)))._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "SrcAddr" in schema
    assert "TotBytes" not in schema


def test_pairs_by_any_name(spark, tmp_path):
    (tmp_path / "made.csv").write_text("source,destination,proto\n[1],2,udp\n3,[4],tcp\n")
    rows = flow_csv.read_pairs(spark, str(tmp_path / "made.csv")).orderBy("src_addr").collect()
    assert [(r.scenario, r.src_addr, r.dst_addr) for r in rows] == [("made", "1", "2"), ("made", "3", "4")]


def test_ports(spark):
    texts = ["80", "0x0303", "0X1f", "0xzz", "http", "", None, "1.5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(columns.port_number(F.col("t"))).collect()]
    assert got == [80.0, 771.0, 31.0, None, None, None, None, 1.5]


def test_epoch_seconds_are_whole(spark):
    df = spark.createDataFrame([("1970/01/01 00:00:01.900000",), ("1969/12/31 23:59:59.500000",), ("soon",)], "t string")
    got = [r[0] for r in df.select(columns.epoch_seconds(columns.parse_time(F.col("t")))).collect()]
    assert got == [1.0, -1.0, None]


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s1", "tot_bytes", 3), ("s2", "dur", 0)], "scenario string, attribute string, n long")
    path = str(tmp_path / "table")
    flow_csv.write_table(df, path, ["scenario", "attribute"])
    assert sorted((r.scenario, r.attribute, r.n) for r in flow_csv.read_table(spark, path).collect()) == [
        ("s1", "tot_bytes", 3),
        ("s2", "dur", 0),
    ]
    assert [r.n for r in flow_csv.read_histogram(spark, path).collect()] == [3]


def lines(path):
    return [line for part in sorted(path.glob("part-*")) for line in part.read_text().splitlines()]


def test_flows_are_written_in_time_order(spark, tmp_path):
    rows = [("b", 30.0), ("a", 10.0), ("c", 20.0), ("d", 10.0)]
    df = spark.createDataFrame(rows, "source string, StartTime double").repartition(3)
    flow_csv.write_flows_csv(df, str(tmp_path / "out"))
    body = [line for line in lines(tmp_path / "out") if line != "source,StartTime"]
    assert body == ["a,10.0", "d,10.0", "c,20.0", "b,30.0"]


def test_distribution_and_profile_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 10), ("b", 9), ("c", 10)], "id string, degree int")
    flow_csv.write_distribution(df, str(tmp_path / "d"), "degree")
    assert lines(tmp_path / "d") == ["9", "10", "10"]
    profile = spark.createDataFrame([(2, 5, 1.0, 3.7, 0.5)], "role int, n_bots long, in_min double, in_max double, mean_x double")
    flow_csv.write_profile(profile, str(tmp_path / "p"))
    assert set(lines(tmp_path / "p")) == {"role,n_bots,in_min,in_max", "2,5,1,3"}


def test_sample_leaves_out_bots(spark):
    rows = [(datetime.datetime(2020, 1, 1 + i % 5), f"h{i}", "flow = Botnet Activity" if i % 2 else "x") for i in range(20)]
    df = spark.createDataFrame(rows, "start_time timestamp, src_addr string, label string")
    got = synth.sample_flows(df, 4).collect()
    assert [r.label for r in got] == ["x"] * 4
    assert [r.start_time.day for r in got] == [1, 1, 2, 2]
