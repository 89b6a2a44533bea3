"""Host graph of a flow log: edges, nodes, degrees, neighbour degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.operators.scale import BROADCAST_ROWS, by, cut, cut_and_see, hot_keys, running_total, skew_join


def flow_edges(flows: DataFrame) -> DataFrame:
    """(src, dst) of every flow, parallel edges included."""
    return flows.select(*by(flows), F.col("src_addr").alias("src"), F.col("dst_addr").alias("dst")).where(
        "src is not null and dst is not null"
    )


def edges(flows: DataFrame) -> DataFrame:
    """Distinct directed edges; self-loops stay."""
    return flow_edges(flows).distinct()


def flow_pairs(flows: DataFrame) -> DataFrame:
    """Distinct directed edges with their number of flows."""
    return flow_edges(flows).groupBy(*by(flows), "src", "dst").agg(F.count("*").alias("n"))


def _ends(edge_list: DataFrame) -> DataFrame:
    """Two rows per edge: its source (one out) and its target (one in); an end that is null has none."""
    found = edge_list.select(
        *by(edge_list),
        F.explode(
            F.array(
                F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
            )
        ).alias("e"),
    )
    return found.select(*by(edge_list), "e.*").where("id is not null")


def nodes(edge_list: DataFrame) -> DataFrame:
    """Every host that is a source or a target."""
    return _ends(edge_list).select(*by(edge_list), "id").distinct()


def graph_size(edge_list: DataFrame) -> DataFrame:
    """Number of nodes and edges."""
    keys = by(edge_list)
    return (
        degrees(edge_list)
        .groupBy(*keys)
        .agg(F.count("*").alias("n_nodes"), F.coalesce(F.sum("outdegree"), F.lit(0)).alias("n_edges"))
    )


def degrees(edge_list: DataFrame) -> DataFrame:
    """In, out and total degree of every node in one aggregation.

    Over distinct edges these are the feature degrees; over raw flows every
    parallel edge counts. A self-loop adds one in and one out.
    """
    return (
        _ends(edge_list)
        .groupBy(*by(edge_list), "id")
        .agg(F.sum("i").alias("indegree"), F.sum("o").alias("outdegree"), F.count("*").alias("degree"))
    )


def flow_degrees(flows: DataFrame) -> DataFrame:
    """Degrees that count every flow; of a flow with one end, that end counts."""
    return degrees(flows.select(*by(flows), F.col("src_addr").alias("src"), F.col("dst_addr").alias("dst")))


def in_degree(edge_list: DataFrame) -> DataFrame:
    return edge_list.groupBy(*by(edge_list), F.col("dst").alias("id")).agg(F.count("*").alias("indegree"))


def out_degree(edge_list: DataFrame) -> DataFrame:
    return edge_list.groupBy(*by(edge_list), F.col("src").alias("id")).agg(F.count("*").alias("outdegree"))


def total_degree(edge_list: DataFrame) -> DataFrame:
    return degrees(edge_list).select(*by(edge_list), "id", "degree")


def links(edge_list: DataFrame) -> DataFrame:
    """(id, nbr) in both directions; a self-loop gives two rows."""
    return edge_list.select(
        *by(edge_list),
        F.explode(
            F.array(
                F.struct(F.col("src").alias("id"), F.col("dst").alias("nbr")),
                F.struct(F.col("dst").alias("id"), F.col("src").alias("nbr")),
            )
        ).alias("e"),
    ).select(*by(edge_list), "e.*")


def avg_neighbor_degree(edge_list: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Mean total degree of the neighbours over all incident edges."""
    keys = by(edge_list)
    degree = total_degree(edge_list).withColumnRenamed("id", "nbr")
    on = [*keys, "nbr"]
    hot = hot_keys(degree, on, "degree", hot_rows)
    return (
        skew_join(links(edge_list), degree, on, hot, ["id"])
        .groupBy(*keys, "id")
        .agg(F.avg("degree").alias("average_neighbor_degree"))
    )


def avg_successor_degree(edge_list: DataFrame, parallel: bool = False, hot_rows: int | None = None) -> DataFrame:
    """Out-degrees of the distinct successors, added up and divided by the own out-degree.

    ``edge_list`` holds distinct edges or, with ``parallel``, raw flows; then
    out-degrees count flows while each successor still counts once. A node
    without successors gets 0.
    """
    keys = by(edge_list)
    own = degrees(edge_list).select(*keys, "id", "indegree", "outdegree")
    target = own.select(*keys, F.col("id").alias("dst"), F.col("outdegree").alias("d"), "indegree")
    on = [*keys, "dst"]
    hot = hot_keys(target, on, "indegree", hot_rows)
    pairs = edge_list.distinct() if parallel else edge_list
    sums = (
        skew_join(pairs, target.drop("indegree"), on, hot, ["src"])
        .groupBy(*keys, F.col("src").alias("id"))
        .agg(F.sum("d").alias("d"))
    )
    return own.join(sums, [*keys, "id"], "left").select(
        *keys,
        "id",
        (F.coalesce("d", F.lit(0)) / F.greatest("outdegree", F.lit(1))).alias("avg_successor_degree"),
    )


def numbered(edge_list: DataFrame, hot_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Hosts with their degrees and a number, and the edges between these numbers.

    Numbers run through all scenarios in order of (degree, id), so they are
    unique without the scenario and an edge can be pointed to its busier end by
    comparing numbers. Both tables are stored. A small host table is broadcast
    to the edges; otherwise both ends are joined with the edges of hot hosts split.
    """
    keys = by(edge_list)
    hosts, seen = cut_and_see(running_total(degrees(edge_list), F.lit(1), ["degree", "id", *keys], name="number"), n=F.count("*"))
    small = hot_rows is None and seen["n"] <= BROADCAST_ROWS
    coded = edge_list
    for end, other in (("src", "dst"), ("dst", "src")):
        on = [*keys, end]
        number = hosts.select(*keys, F.col("id").alias(end), F.col("number").alias("n_" + end), "degree")
        if small:
            coded = coded.join(F.broadcast(number.drop("degree")), on)
        else:
            hot = hot_keys(number, on, "degree", hot_rows)
            coded = skew_join(coded, number.drop("degree"), on, hot, [other])
    return hosts, cut(coded.select(F.col("n_src").alias("src"), F.col("n_dst").alias("dst")))


def with_hosts(hosts: DataFrame, table: DataFrame) -> DataFrame:
    """Replace the number of a per-host table by scenario and id; hosts without a row get nulls."""
    found = table.withColumnRenamed("id", "number")
    return hosts.select(*by(hosts), "id", "number").join(found, "number", "left").drop("number")
