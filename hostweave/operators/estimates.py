"""Numbers of triangles from a part of the edges.

Every undirected edge is kept with probability ``share``, decided by a hash of its ends, so a retried task keeps the same.
A triangle is left with probability share**3, and two triangles that have an edge in common are both left with share**5.
So the triangles that are left, divided by share**3, estimate all of them without bias, and the variance of that is

    T (1 / share**3 - 1) + 2 K (1 / share - 1)

with T triangles and K pairs of triangles with an edge in common, of which the same sample gives unbiased estimates.
Work falls with the edges: hosts are numbered anew by what they keep, and lists point to the busier end.

Defined cases: a graph (or scenario) without edges but self-loops, or without a triangle left, has the estimate 0 with
variance 0; ``share`` = 1 counts exactly. Reciprocal and repeated edges count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.functions.draws import uniform
from hostweave.operators.graph import numbered
from hostweave.operators.scale import by, cut, hot_keys, skew_join
from hostweave.operators.triangles import canonical_edges


def kept_edges(edge_list: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Undirected edges (src < dst) that the hash of their ends keeps, each once."""
    keys = by(edge_list)
    pairs = edge_list.where("src <> dst").select(*keys, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    # edges that go come before the exchange
    return pairs.where(uniform(seed, "triangle", *keys, "src", "dst") <= share).distinct()


def edge_triangles(canonical: DataFrame, hot: DataFrame) -> DataFrame:
    """(a, b, n) of every edge that is in a triangle; hosts are numbers and edges point to the busier end."""
    outs = canonical.groupBy("a").agg(F.collect_list("b").alias("out"))  # at most sqrt(2 m) each
    out_b = outs.select(F.col("a").alias("b"), F.col("out").alias("out_b"))
    closed = (
        skew_join(canonical.select("a", "b"), out_b, ["b"], hot.withColumnRenamed("id", "b"), ["a"])
        .join(outs, "a")
        .select("a", "b", F.array_intersect("out", "out_b").alias("c"))
    )
    edge = lambda a, b, n: F.struct(a.alias("a"), b.alias("b"), n.cast("long").alias("n"))
    others = F.flatten(F.transform("c", lambda c: F.array(edge(F.col("a"), c, F.lit(1)), edge(F.col("b"), c, F.lit(1)))))
    found = F.when(F.size("c") > 0, F.concat(F.array(edge(F.col("a"), F.col("b"), F.size("c"))), others))
    return closed.select(F.explode(found).alias("e")).select("e.*").groupBy("a", "b").agg(F.sum("n").alias("n"))


def triangle_estimate(edge_list: DataFrame, share: float = 0.3, seed: int = 0, hot_rows: int | None = None) -> DataFrame:
    """(triangles, variance) of the simple undirected graph, one row per scenario, estimated from a share of the edges.

    ``edge_list`` is read twice, so pass a stored table.
    """
    keys = by(edge_list)
    kept = cut(kept_edges(edge_list, share, seed))
    hosts, coded = numbered(kept, hot_rows)
    canonical = cut(canonical_edges(coded))
    hot = hot_keys(hosts.select(F.col("number").alias("id"), "degree"), ["id"], "degree", hot_rows)
    per_edge = edge_triangles(canonical, hot)
    if keys:
        per_edge = per_edge.join(hosts.select(F.col("number").alias("a"), *keys), "a")
    sums = per_edge.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("k"))
    triangles = F.coalesce(F.col("n") / 3, F.lit(0.0)) / share**3
    pairs = F.coalesce("k", F.lit(0.0)) / share**5
    told = sums.select(*keys, triangles.alias("triangles"), (triangles * (1 / share**3 - 1) + 2 * pairs * (1 / share - 1)).alias("variance"))
    if keys:
        told = edge_list.select(*keys).distinct().join(told, keys, "left").na.fill(0.0, ["triangles", "variance"])
    return told
