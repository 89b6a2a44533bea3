"""Logs with broken files, several headers and missing values."""

import gzip

import pytest
from pyspark.sql import functions as F

from hostweave.functions import columns
from hostweave.operators import graph, histograms, params, roles
from hostweave.operators.scale import cut
from hostweave.sources import flow_csv
from tests.test_sources import FLOW, HEADER, write


def test_headers_do_not_swap_columns(spark, tmp_path):
    turned = ["DstAddr" if c == "SrcAddr" else "SrcAddr" if c == "DstAddr" else c for c in HEADER]
    write(tmp_path / "a.log", [FLOW])
    write(tmp_path / "b.log", [FLOW], turned)
    found = {(r.src_addr, r.dst_addr) for r in flow_csv.read_flows(spark, str(tmp_path)).collect()}
    assert found == {("212.50.71.179", "147.32.84.229")}


def test_headers_in_any_case(spark, tmp_path):
    write(tmp_path / "a.log", [{k.upper(): v for k, v in FLOW.items()}], [c.upper() for c in HEADER])
    write(tmp_path / "b.log", [{k.lower(): v for k, v in FLOW.items()}], [c.lower() for c in HEADER])
    rows = flow_csv.read_flows(spark, str(tmp_path)).collect()
    assert [r.label for r in rows] == [FLOW["Label"]] * 2
    assert [r.tot_pkts for r in rows] == [12, 12]


def test_a_file_without_or_with_two_headers_fails(spark, tmp_path):
    (tmp_path / "bad.log").write_text("1,2,3\n4,5,6\n")
    with pytest.raises(ValueError, match="0 different headers"):
        flow_csv.read_flows(spark, str(tmp_path))
    (tmp_path / "bad.log").write_text("SrcAddr,DstAddr\na,b\nDstAddr,SrcAddr\nc,d\n")
    with pytest.raises(ValueError, match="2 different headers"):
        flow_csv.read_flows(spark, str(tmp_path))


def test_concatenated_parts(spark, tmp_path):
    (tmp_path / "all.log").write_text("SrcAddr,DstAddr\na,b\nSrcAddr,DstAddr\nc,d\n")
    assert {(r.src_addr, r.dst_addr) for r in flow_csv.read_flows(spark, str(tmp_path)).collect()} == {("a", "b"), ("c", "d")}


def test_a_broken_file_fails_or_is_left_out_whole(spark, tmp_path):
    write(tmp_path / "good.log", [FLOW])
    lines = "\n".join([",".join(HEADER), *[",".join(FLOW[c] + str(i) for c in HEADER) for i in range(5000)]])
    whole = gzip.compress(lines.encode())
    (tmp_path / "cut.log.gz").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception):
        flow_csv.read_flows(spark, str(tmp_path)).count()
    report = {r.file.rsplit("/", 1)[1]: (r.rows, r.skipped) for r in flow_csv.check_files(spark, str(tmp_path)).collect()}
    assert report == {"good.log": (2, False), "cut.log.gz": (None, True)}
    assert flow_csv.read_flows(spark, str(tmp_path), skip_corrupt=True).count() == 1


def test_other_scenarios_stay(spark, tmp_path):
    out = str(tmp_path / "table")
    for name, value in (("s1", 1), ("s2", 2), ("s1", 3)):
        flow_csv.write_table(spark.createDataFrame([(name, value)], "scenario string, v int"), out)
    assert {(r.scenario, r.v) for r in flow_csv.read_table(spark, out).collect()} == {("s1", 3), ("s2", 2)}


@pytest.mark.parametrize(
    "text,port",
    [("0x0", 0.0), ("0x00000000000000000050", 80.0), ("0x123456789abcdef", float(0x123456789ABCDEF)), ("0x12345678901234567", None), ("0x", None), ("x", None), (None, None), ("80", 80.0), ("0X1F", 31.0)],
)
def test_long_ports(spark, text, port):
    assert spark.createDataFrame([(text,)], "t string").select(columns.port_number(F.col("t"))).first()[0] == port


def test_each_end_counts(spark):
    flows = spark.createDataFrame([("a", "b"), ("a", None), (None, "b"), (None, None)], "src_addr string, dst_addr string")
    assert {(r.id, r.indegree, r.outdegree) for r in graph.flow_degrees(flows).collect()} == {("a", 0, 2), ("b", 2, 0)}
    assert graph.edges(flows).count() == 1


def test_wide_text_is_categorical(spark):
    counts = spark.createDataFrame([("proto", f"p{i}", None, 1 + i % 3) for i in range(250)] + [("proto", None, None, 50)], "attribute string, label string, value double, n long")
    table = histograms.cumulative(histograms.with_share(histograms.categorical_histograms(cut(counts)))).orderBy("bin").collect()
    assert [r.bin for r in table] == list(range(1, 251))
    assert [r.n for r in table] == sorted((r.n for r in table), reverse=True)
    assert table[-1].cum_hi == pytest.approx(1 - 50 / table[0].total)
    assert histograms.quantile_histograms(cut(counts)).count() == 0


def test_high_roles_are_kept(spark):
    table = spark.createDataFrame([("a", 0), ("b", 6)], "node string, role int")
    assert {(r.role, r.n_nodes) for r in params.role_sizes(table, 4).collect()} == {(i, int(i in (0, 6))) for i in range(7)}
    flows = spark.createDataFrame([("a", "b")], "src_addr string, dst_addr string")
    made = params.role_edges(flows, table, 4).collect()
    assert len(made) == 49 and [(r.src_role, r.dst_role) for r in made if r.n] == [(0, 6)]


def test_kmeans_finds_separate_groups_per_scenario(spark):
    names = ["indegree", "outdegree", "average_neighbor_degree", "triangles", "clustering_coefficient", "kCore"]
    rows = [(s, f"{s}{i}", *[float((i % 2) * 10 + i / 100 + k + (5 if s == "y" else 0)) for k in range(6)]) for s in ("x", "y") for i in range(40)]
    points = cut(spark.createDataFrame(rows, "scenario string, id string, " + ", ".join(f"{n} double" for n in names)))
    found = roles.assign_roles(points, roles.fit_centroids(points, 2)).collect()
    assert all(r.role == int(r.node[1:]) % 2 for r in found) and len(found) == 80
