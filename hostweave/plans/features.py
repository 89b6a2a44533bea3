"""Feature table of every host of a flow log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.operators.graph import avg_neighbor_degree, degrees, edges, links, numbered
from hostweave.operators.peeling import peel
from hostweave.operators.scale import Wires, by, cut
from hostweave.operators.triangles import numbered_triangle_features


def basic_features(edge_list: DataFrame) -> DataFrame:
    """Degrees and average neighbour degree only."""
    on = [*by(edge_list), "id"]
    return (
        degrees(edge_list)
        .join(avg_neighbor_degree(edge_list), on, "left")
        .select(
            *on,
            "indegree",
            "outdegree",
            "average_neighbor_degree",
        )
        .na.fill(0)
    )


def edge_features(edge_list: DataFrame, kmax: int = 3, hot_rows: int | None = None) -> DataFrame:
    """All features from distinct edges; ``edge_list`` is read several times, so pass a stored table.

    Hosts are numbered once and everything runs on the numbers: the links are
    shuffled to their senders once for both the neighbour degrees and the
    peeling, and every part comes out partitioned by host, ready to join.
    """
    hosts, coded = numbered(edge_list, hot_rows)
    degree = hosts.select(F.col("number").alias("id"), "degree")
    counts = degree.select(F.col("id").alias("nbr"), F.col("degree").alias("n"))
    with Wires(links(coded), hot_rows, counts) as wires:
        neighbors = cut(
            wires.carry(degree, "degree").groupBy("id").agg(F.avg("degree").alias("average_neighbor_degree"))
        )
        cores = peel(wires, degree, kmax)
    corners = numbered_triangle_features(hosts, coded, hot_rows)
    parts = neighbors.join(corners, "id", "left").join(cores, "id").withColumnRenamed("id", "number")
    return hosts.join(parts, "number").select(
        *by(hosts),
        "id",
        "indegree",
        "outdegree",
        F.coalesce("average_neighbor_degree", F.lit(0.0)).alias("average_neighbor_degree"),
        F.coalesce("triangles", F.lit(0)).alias("triangles"),
        F.coalesce("clustering_directed", F.lit(0.0)).alias("clustering_coefficient"),
        F.coalesce("kCore", F.lit(0)).alias("kCore"),
    )


def node_features(flows: DataFrame, kmax: int = 3) -> DataFrame:
    """In-degree, out-degree, average neighbour degree, triangles, clustering and k-core value per host."""
    return edge_features(cut(edges(flows)), kmax)
