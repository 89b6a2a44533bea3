"""Triangles and clustering coefficients.

Hosts are numbered in order of (degree, id) and every undirected edge points
from the lower to the higher number, so no host keeps more than sqrt(2m)
out-neighbours however many edges it has, and each triangle is found once as
a common out-neighbour of the two ends of an edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.operators.graph import numbered, with_hosts
from hostweave.operators.scale import by, cut, hot_keys, skew_join


def canonical_edges(edge_list: DataFrame) -> DataFrame:
    """Undirected edges a < b without self-loops; ``mult`` is 2 for a reciprocal pair.

    Partitioned by ``a``. With numbered hosts a host is ``a`` at most sqrt(2m) times.
    """
    keys = by(edge_list)
    pairs = edge_list.where("src <> dst").select(
        *keys, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    )
    return pairs.groupBy(*keys, "a", "b").agg(F.count("*").cast("int").alias("mult"))


def neighbor_counts(canonical: DataFrame) -> DataFrame:
    """Number of distinct neighbours other than the node itself."""
    keys = by(canonical)
    return (
        canonical.select(*keys, F.explode(F.array("a", "b")).alias("id"))
        .groupBy(*keys, "id")
        .agg(F.count("*").alias("n_neighbors"))
    )


def corner_counts(canonical: DataFrame, hot: DataFrame) -> DataFrame:
    """Per host of a triangle: its triangles and the directed edges opposite to it; hosts are numbers.

    ``hot`` has the hosts with many edges, see ``hot_keys``.
    """
    outs = canonical.groupBy("a").agg(
        F.collect_list("b").alias("out"),
        F.collect_list(F.when(F.col("mult") == 2, F.col("b"))).alias("both"),
    )
    out_b = outs.select(F.col("a").alias("b"), F.col("out").alias("out_b"), F.col("both").alias("both_b"))
    closed = (
        skew_join(canonical, out_b, ["b"], hot.withColumnRenamed("id", "b"), ["a"])
        .join(outs, "a")
        .select("a", "b", "mult", "both", "both_b", F.array_intersect("out", "out_b").alias("c"))
    )

    def corner(node, triangles, opposite):
        return F.struct(
            node.alias("id"), triangles.cast("long").alias("triangles"), opposite.cast("long").alias("opposite")
        )

    found = F.size("c")
    at_a = corner(F.col("a"), found, found + F.size(F.array_intersect("c", "both_b")))
    at_b = corner(F.col("b"), found, found + F.size(F.array_intersect("c", "both")))
    at_c = F.transform("c", lambda c: corner(c, F.lit(1), F.col("mult")))
    # a filter on the intersection would be pushed into the join and computed twice
    corners = F.when(found > 0, F.concat(F.array(at_a, at_b), at_c))
    return (
        closed.select(F.explode(corners).alias("t"))
        .select("t.*")
        .groupBy("id")
        .agg(F.sum("triangles").alias("triangles"), F.sum("opposite").alias("opposite"))
    )


def numbered_triangle_features(hosts: DataFrame, coded: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Triangles and both clustering coefficients for hosts that have a neighbour, from ``numbered`` tables."""
    canonical = cut(canonical_edges(coded))
    hot = hot_keys(hosts.select(F.col("number").alias("id"), "degree"), ["id"], "degree", hot_rows)
    joined = (
        neighbor_counts(canonical)
        .join(corner_counts(canonical, hot), "id", "left")
        .na.fill(0, ["triangles", "opposite"])
    )
    pairs = F.col("n_neighbors") * (F.col("n_neighbors") - 1)
    return joined.select(
        "id",
        "triangles",
        F.when(pairs > 0, 2 * F.col("opposite") / pairs).otherwise(0.0).alias("clustering_directed"),
        F.when(pairs > 0, 2 * F.col("triangles") / pairs).otherwise(0.0).alias("clustering_undirected"),
    )


def triangle_features(edge_list: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Triangles, directed and undirected clustering coefficient of every node.

    The directed coefficient counts directed edges among the neighbours, so it
    runs from 0 to 2; the undirected one is that of the simple graph.
    ``edge_list`` is read several times, so pass a stored table.
    """
    hosts, coded = numbered(edge_list, hot_rows)
    return with_hosts(hosts, numbered_triangle_features(hosts, coded, hot_rows)).na.fill(0)


def triangles(edge_list: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Triangles per node of the simple undirected graph."""
    return triangle_features(edge_list, hot_rows).select(*by(edge_list), "id", "triangles")


def clustering_coefficient(edge_list: DataFrame, mode: str = "directed", hot_rows: int | None = None) -> DataFrame:
    """Local clustering, ``directed`` (range 0 to 2) or ``undirected``."""
    return triangle_features(edge_list, hot_rows).select(
        *by(edge_list), "id", F.col("clustering_" + mode).alias("clustering_coefficient")
    )
