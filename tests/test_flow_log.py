"""The data source of flow logs."""

import gzip
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In
from pyspark.sql.types import StructType

from hostweave.sources import flow_csv, flow_log, stores
from tests.test_sources import FLOW, HEADER, write


def reader(path, columns=("SrcAddr", "DstAddr", "scenario"), kind=flow_log.FlowLogReader, **options):
    schema = StructType()
    for c in columns:
        schema = schema.add(c, "string")
    return kind(schema, {"path": json.dumps([str(path)]), **options})


def rows(source):
    parts = source.partitions()
    return [tuple(r.values()) for p in parts for b in source.read(p) for r in b.to_pylist()], parts


def test_every_line_is_in_one_range(tmp_path):
    rng = random.Random(1)
    lines = [f"{i}," + "x" * rng.randrange(60) for i in range(300)]
    for end in ("", "\n"):
        (tmp_path / "a.log").write_text("SrcAddr,DstAddr\n" + "\n".join(lines) + end)
        for size in (1, 7, 64, 1000, 1 << 20):
            got, parts = rows(reader(tmp_path, rangeBytes=str(size)))
            assert [f"{a},{b or ''}" for a, b, _ in got] == lines
            assert len(parts) == -(-(tmp_path / "a.log").stat().st_size // size)


def test_bytes_read(tmp_path, monkeypatch):
    (tmp_path / "a.log").write_text("SrcAddr,DstAddr,Label\n" + "host-a,host-b,label\n" * 200_000)
    size = (tmp_path / "a.log").stat().st_size
    read = []

    class Counted:
        def __init__(self, stream):
            self.stream, self.bytes = stream, 0

        def __enter__(self):
            return self

        def __exit__(self, *_):
            read.append(self.bytes)

        def read(self, n):
            data = self.stream.read(n)
            self.bytes += len(data)
            return data

        def seek(self, at):
            self.stream.seek(at)

    plain = flow_log.open_range
    monkeypatch.setattr(flow_log, "open_range", lambda file: Counted(plain(file)))
    got, parts = rows(reader(tmp_path, rangeBytes=str(1 << 20)))
    assert len(got) == 200_000 and len(parts) == 4
    heads, ranges = read[::2], read[1::2]
    assert all(n <= flow_log.HEAD_STEP for n in heads) and sum(heads) <= 64 << 10
    assert sum(ranges) <= size + 4 * 2 * flow_log.HEAD_STEP
    read.clear()
    assert flow_csv._headers_at_front(str(tmp_path / "a.log"), ["SrcAddr", "DstAddr"]) == [(str(tmp_path / "a.log"), "SrcAddr,DstAddr,Label")]
    assert sum(read) <= 64 << 10


def test_same_rows_as_the_csv_reader(spark, tmp_path):
    turned = ["DstAddr" if c == "SrcAddr" else "SrcAddr" if c == "DstAddr" else c.upper() for c in HEADER]
    write(tmp_path / "one.x.log", [FLOW, FLOW])
    write(tmp_path / "two.log", [{k.upper() if k.upper() in turned else k: v for k, v in FLOW.items()}], turned)
    (tmp_path / "three.log").write_text("﻿srcaddr,\"dstaddr\" ,dur\r\na,b,1.5\r\n\r\nsrcaddr,dstaddr,dur\r\nc,d\r\ne,f,x,more\r\n\"g,h\",,")
    (tmp_path / "none.log").write_text("")
    (tmp_path / "_hidden").write_text("1,2")
    want = flow_csv.read_flows(spark, str(tmp_path))
    got = flow_csv.scan_flows(spark, str(tmp_path))
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert key(got) == key(want) and got.count() == 7
    assert {r.scenario for r in got.collect()} == {"one", "two", "three"}


def test_only_the_columns_asked_for_are_parsed(spark, tmp_path):
    write(tmp_path / "a.log", [FLOW])
    got = flow_csv.scan_flows(spark, str(tmp_path), ["dst_addr"])
    assert got.columns == ["scenario", "dst_addr"] and got.first().dst_addr == FLOW["DstAddr"]
    block = ",".join(HEADER).encode() + b"\n" + b"1," * 14 + b"1\n"
    names = [c.lower() for c in HEADER]
    assert set(flow_log.parse(block, names, ["dport"], ["srcaddr", "dstaddr"], "f").column_names) == {"dport", "srcaddr", "dstaddr"}


def test_bad_headers_fail(spark, tmp_path):
    (tmp_path / "bad.log").write_text("1,2,3\n4,5,6\n")
    with pytest.raises(ValueError, match="0 different headers"):
        rows(reader(tmp_path))
    (tmp_path / "bad.log").write_text("SrcAddr,DstAddr\na,b\nDstAddr,SrcAddr\nc,d\n")
    with pytest.raises(ValueError, match="2 different headers"):
        rows(reader(tmp_path))
    (tmp_path / "bad.log").write_text("SrcAddr,DstAddr,x,X\na,b,c,d\n")
    with pytest.raises(ValueError, match="repeats a name"):
        rows(reader(tmp_path))
    with pytest.raises(Exception, match="repeats a name"):
        flow_csv.scan_flows(spark, str(tmp_path)).count()
    with pytest.raises(ValueError, match="no line ends"):
        (tmp_path / "bad.log").write_text("SrcAddr,DstAddr" + "x" * (65 << 10))
        rows(reader(tmp_path))


def test_another_header_far_down_fails(spark, tmp_path):
    far = "a,b\n" * (flow_log.HEAD_BYTES // 4 + 10)
    (tmp_path / "bad.log").write_text("SrcAddr,DstAddr\n" + far + "DstAddr,SrcAddr\nc,d\n")
    with pytest.raises(Exception, match="2 different headers"):
        flow_csv.read_flows(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="2 different headers"):
        flow_csv.scan_flows(spark, str(tmp_path)).collect()
    (tmp_path / "bad.log").write_text("SrcAddr,DstAddr\n" + far + "SrcAddr,DstAddr\nc,d\n")
    n = flow_log.HEAD_BYTES // 4 + 11
    assert flow_csv.read_flows(spark, str(tmp_path)).count() == flow_csv.scan_flows(spark, str(tmp_path)).count() == n


def test_odd_bytes(tmp_path):
    (tmp_path / "a.log").write_bytes(b"SrcAddr,DstAddr\n\xff,b\n")
    assert rows(reader(tmp_path))[0] == [("�", "b", "a")]


def test_packed_files(spark, tmp_path):
    lines = "SrcAddr,DstAddr\n" + "".join(f"a{i},b\n" for i in range(50_000))
    whole = gzip.compress(lines.encode())
    (tmp_path / "good.log.gz").write_bytes(whole)
    got, parts = rows(reader(tmp_path, rangeBytes="100"))
    assert len(got) == 50_000 and len(parts) == 1
    (tmp_path / "cut.log.gz").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception):
        flow_csv.scan_flows(spark, str(tmp_path)).count()
    report = {r.file.rsplit("/", 1)[1]: (r.rows, r.skipped) for r in flow_csv.check_files(spark, str(tmp_path)).collect()}
    assert report == {"good.log.gz": (50_001, False), "cut.log.gz": (None, True)}


def test_a_scenario_filter_leaves_files_out(tmp_path):
    for name in ("s1", "s2", "s3"):
        (tmp_path / f"{name}.log").write_text(f"SrcAddr,DstAddr\n{name},b\n")
    source = reader(tmp_path, kind=flow_log.PruningReader)
    assert [f.value for f in source.pushFilters([EqualTo(("SrcAddr",), "x"), In(("scenario",), ("s1", "s3"))])] == ["x"]
    assert [r[0] for r in rows(source)[0]] == ["s1", "s3"]
    assert list(source.pushFilters([EqualTo(("scenario",), "s3")])) == [] and len(source.partitions()) == 1


def test_lines_are_counted_as_spark_does(spark, tmp_path):
    for i, text in enumerate(("", "a", "a\n", "a\r\nb\rc\nd", "\n\n", "a\r", "\r\n")):
        (tmp_path / f"{i}.txt").write_bytes(text.encode())
        assert flow_csv._count_lines(str(tmp_path / f"{i}.txt"))[0][1] == spark.read.text(str(tmp_path / f"{i}.txt")).count(), repr(text)


def test_stores():
    assert stores.is_known("/x") and stores.is_known("file:///x") and stores.is_known("s3://b/x")
    assert not stores.is_known("viewfs://c/x")
    assert stores.store("file:///a%20b")[1] == "/a b"


def test_no_files_and_spaces(spark, tmp_path):
    folder = tmp_path / "a b"
    folder.mkdir()
    assert flow_csv.scan_flows(spark, str(folder)).count() == 0
    write(folder / "x y.log", [FLOW])
    assert flow_csv.scan_flows(spark, str(folder)).count() == flow_csv.read_flows(spark, str(folder)).count() == 1
    assert flow_csv.scan_flows(spark, f"file://{str(folder).replace(' ', '%20')}").where(F.col("scenario") == "x y").count() == 1
