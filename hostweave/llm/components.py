"""Connected components of a link table by alternating stars, with one stored table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.llm.storage import stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, root) of every end of the links (a, b); root is the smallest id of the component.

    A round hangs every id on its smallest neighbour, first the larger neighbours, then the smaller ones; the number of
    rounds grows with the logarithm of the component size. Links move, no list of a component is ever built. Raises if
    the rounds do not suffice.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _mark(edges)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # larger neighbours of each id go to its smallest neighbour, or to itself
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = stored(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        # an id and its smaller neighbours go to the smallest of them
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select("a", "b", "m")
        edges = stored(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct(), "edges"
        )
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]
