"""Columns of the tables that are read and written."""

from __future__ import annotations

from pyspark.sql import types as T

# Header names of a flow log, our column names and types, in file order.
FLOW_COLUMNS = [
    ("StartTime", "start_time", T.TimestampType()),
    ("Dur", "dur", T.DoubleType()),
    ("Proto", "proto", T.StringType()),
    ("SrcAddr", "src_addr", T.StringType()),
    ("Sport", "sport", T.StringType()),
    ("Dir", "dir", T.StringType()),
    ("DstAddr", "dst_addr", T.StringType()),
    ("Dport", "dport", T.StringType()),
    ("State", "state", T.StringType()),
    ("sTos", "s_tos", T.DoubleType()),
    ("dTos", "d_tos", T.DoubleType()),
    ("TotPkts", "tot_pkts", T.LongType()),
    ("TotBytes", "tot_bytes", T.LongType()),
    ("SrcBytes", "src_bytes", T.LongType()),
    ("Label", "label", T.StringType()),
]

FLOW_SCHEMA = T.StructType([T.StructField(name, kind) for _, name, kind in FLOW_COLUMNS])

# Fixed value: time format of a flow log.
TIME_FORMAT = "yyyy/MM/dd HH:mm:ss.SSSSSS"

# The histogrammed attributes and how each becomes a number.
# Addresses, state and label get no histogram.
ATTRIBUTES = [
    ("start_time", "time"),
    ("dur", "number"),
    ("proto", "text"),
    ("sport", "port"),
    ("dir", "text"),
    ("dport", "port"),
    ("s_tos", "number"),
    ("d_tos", "number"),
    ("tot_pkts", "number"),
    ("tot_bytes", "number"),
    ("src_bytes", "number"),
]

# Columns of a synthetic flow after source, destination and proto,
# with the attribute each is drawn from (state has no histogram, so it stays empty).
SYNTH_COLUMNS = [
    ("StartTime", "start_time"),
    ("Dur", "dur"),
    ("Sport", "sport"),
    ("Dir", "dir"),
    ("Dport", "dport"),
    ("State", "state"),
    ("sTos", "s_tos"),
    ("dTos", "d_tos"),
    ("TotPkts", "tot_pkts"),
    ("TotBytes", "tot_bytes"),
]

# Marks of bot flows in an input label, and the two labels of synthetic flows.
BOT_MARK = "Botnet"
BOT_LABEL = "flow = Botnet Activity"
NORMAL_LABEL = "flow = normal dataflow"

# Node features in table order.
FEATURES = [
    "indegree",
    "outdegree",
    "average_neighbor_degree",
    "triangles",
    "clustering_coefficient",
    "kCore",
]
