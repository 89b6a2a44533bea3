"""Truncated k-core value and true core number.

Both read their edge list more than once; pass a stored table or ``cut(...)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostweave.operators.graph import links, nodes
from hostweave.operators.scale import Wires, by, cut, cut_and_see, hot_keys, skew_join
from hostweave.operators.triangles import canonical_edges


def k_core(edge_list: DataFrame, kmax: int = 3, hot_rows: int | None = None) -> DataFrame:
    """Truncated k-core value of every node."""
    ends = links(edge_list)
    degree = ends.groupBy(*by(edge_list), "id").agg(F.count("*").alias("degree"))
    with Wires(ends, hot_rows) as wires:
        return peel(wires, degree, kmax)


def peel(wires: Wires, degree: DataFrame, kmax: int = 3) -> DataFrame:
    """Truncated k-core value from the links in both directions and the total degrees (id, degree).

    For k up to ``kmax``, nodes that still have neighbours but fewer than k
    edge ends to them leave together, until none does. A node that left at k
    gets k - 1. A node that stays gets its remaining degree, or kmax - 1 if all
    its neighbours left. Reciprocal edges count twice, self-loops two ends.
    """
    on = [*wires.by, "id"]
    # the smallest degree of those who stay tells the next k at which someone leaves
    least = F.min(F.when(F.col("left_at").isNull() & (F.col("degree") > 0), F.col("degree")))
    state, seen = cut_and_see(degree.select(*on, "degree", F.lit(None).cast("int").alias("left_at")), least=least)
    k = 1
    while seen["least"] is not None and (k := max(k, seen["least"] + 1)) <= kmax:
        leaves = F.col("left_at").isNull() & F.col("degree").between(1, k - 1)
        lost = wires.carry(state.where(leaves)).groupBy(*on).agg(F.count("*").alias("lost"))
        state, seen = cut_and_see(
            state.join(lost, on, "left").select(
                *on,
                (F.col("degree") - F.coalesce("lost", F.lit(0))).alias("degree"),
                F.when(leaves, F.lit(k)).otherwise(F.col("left_at")).alias("left_at"),
            ),
            least=least,
        )
    value = (
        F.when(F.col("left_at").isNotNull(), F.col("left_at") - 1)
        .when(F.col("degree") == 0, F.lit(kmax - 1))
        .otherwise(F.col("degree"))
    )
    return state.select(*on, value.cast("int").alias("kCore"))


def core_sizes(cores: DataFrame, kmax: int = 3) -> DataFrame:
    """Number of nodes at or above each k."""
    keys = by(cores)
    return (
        cores.select(*keys, F.explode(F.sequence(F.lit(1), F.least("kCore", F.lit(kmax)))).alias("k"))
        .where("k >= 1")
        .groupBy(*keys, "k")
        .agg(F.count("*").alias("n_nodes"))
    )


def core_number(edge_list: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Core number on the simple undirected graph without self-loops.

    Each node starts at its degree and repeatedly takes the h-index of its
    neighbours' values; the fixed point is the core number. Neighbour values
    are counted per (node, value) before they meet, and a node sees at most
    2 sqrt(m) different values, so hubs stay small. The counts are kept, values
    at or above the node's own as one, so after the first round only nodes that
    fell send: their old value leaves the counts and their new one joins them.
    A link knows its receiver's degree, above which a value says nothing.
    """
    keys = by(edge_list)
    on = [*keys, "id"]
    ends = cut(links(canonical_edges(edge_list).select(*keys, F.col("a").alias("src"), F.col("b").alias("dst"))))
    from_top = Window.partitionBy(*on).orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy(*on)
    falls = {"n": F.count_if(F.col("value") < F.col("before"))}

    def lowered(counts: DataFrame) -> tuple[DataFrame, dict]:
        """Counts (id, value, n, before) cut at the h-index, which is the highest value of a node that is left; nodes that fell."""
        core = F.max(F.least("value", "at_least")).over(own)
        capped = counts.withColumn("at_least", F.sum("n").over(from_top)).withColumn("core", core)
        merged = capped.groupBy(*on, "core", F.least("value", "core").alias("value")).agg(F.sum("n").alias("n"), F.max("before").alias("before"))
        # only the row at the core says what the node had before
        return cut_and_see(merged.select(*on, "value", "n", F.when(F.col("value") == F.col("core"), F.col("before")).alias("before")), **falls)

    degree = cut(ends.groupBy(*on).agg(F.count("*").alias("most")))
    ends = skew_join(ends, degree, on, hot_keys(degree, on, "most", hot_rows), ["nbr"])
    told = lambda value: F.least(F.col(value), F.col("most"))
    senders = degree.select(*keys, F.col("id").alias("nbr"), F.col("most").alias("n"))
    with Wires(ends, hot_rows, senders) as wires:
        first = wires.carry(degree.withColumnRenamed("most", "value"), "value", of_link=["most"])
        counted = first.groupBy(*on, F.col("most").alias("before"), told("value").alias("value")).agg(F.count("*").alias("n"))
        state, seen = lowered(counted)
        while seen["n"]:
            fell = wires.carry(state.where("value < before"), "value", "before", of_link=["most"])
            fell = fell.select(*on, told("before").alias("was"), told("value").alias("now")).where("was <> now")
            moved = F.explode(F.array(F.struct(F.col("was").alias("value"), F.lit(-1).alias("n")), F.struct(F.col("now").alias("value"), F.lit(1).alias("n"))))
            change = fell.select(*on, moved.alias("m")).select(*on, "m.*").groupBy(*on, "value").agg(F.sum("n").alias("n")).where("n <> 0")
            both = state.select(*on, "value", "n", F.col("before").isNotNull().alias("top")).unionByName(change.withColumn("top", F.lit(False)))
            core = F.max(F.when(F.col("top"), F.col("value"))).over(own)
            counts = both.withColumn("before", core).groupBy(*on, "before", F.least("value", "before").alias("value")).agg(F.sum("n").alias("n"))
            state, seen = lowered(counts.where("n <> 0"))
        state = state.where("before is not null").select(*on, F.col("value").alias("core"))
    return nodes(edge_list).join(state, on, "left").select(*on, F.coalesce("core", F.lit(0)).cast("int").alias("core"))
