"""Placing given rows: values in histogram intervals, hosts in runs of stubs, samples by hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.functions.draws import draw_key, draw_number, number_bucket
from hostweave.operators.scale import by, join_small, running_total


def value_bins(counts: DataFrame, histogram: DataFrame, cells: int = 4_096) -> DataFrame:
    """(attribute, bin, n): rows of each interval, by a range join of the counted values with the intervals.

    ``counts`` has (attribute, value, n). Values and intervals of an attribute are cut into ``cells`` equal cells over
    its range, so the join is on (attribute, cell); an interval spans few cells and every cell meets few intervals. Values
    are counted before they move, so a common value is one row.
    """
    keys = [*by(counts), "attribute"]
    ranges = histogram.where("lo is not null").groupBy(*keys).agg(F.min("lo").alias("low"), F.max("hi").alias("high"))

    def cell(value: str):
        place = F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * cells)
        return F.when(F.col("high") > F.col("low"), F.greatest(F.lit(0), F.least(place, F.lit(cells - 1)))).otherwise(F.lit(0))

    values = join_small(counts.where("value is not null").groupBy(*keys, "value").agg(F.sum("n").alias("n")), ranges, keys)
    values = values.select(*keys, "value", "n", cell("value").alias("cell"))
    bins = join_small(histogram.where("lo is not null").select(*keys, "bin", "lo", "hi"), ranges, keys)
    bins = bins.select(*keys, "bin", "lo", "hi", F.explode(F.sequence(cell("lo"), cell("hi"))).alias("cell"))
    inside = (F.col("value") <= F.col("hi")) & ((F.col("value") > F.col("lo")) | ((F.col("bin") == 1) & (F.col("value") == F.col("lo"))))
    return values.join(bins, [*keys, "cell"]).where(inside).groupBy(*keys, "bin").agg(F.sum("n").alias("n"))


def role_offsets(degrees: DataFrame, n: str = "indegree") -> DataFrame:
    """(role, id, first, upto): the run of edge ends of every host among those of its role, in order of the host."""
    keys = [*by(degrees), "role"]
    placed = running_total(degrees.select(*keys, "id", n), n, ["id"], keys, name="first")
    return placed.select(*keys, "id", "first", (F.col("first") + F.col(n)).alias("upto"))


def role_sample(degrees: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(role, id): ``n`` hosts of every role, those first in hash order."""
    keys = [*by(degrees), "role"]
    drawn = degrees.select(*keys, "id", draw_number(seed, "sample", draw_key("id")).alias("h"))
    ranked = running_total(drawn, F.lit(1), ["h", "id"], keys, number_bucket(F.col("h"), degrees.count()), "rank")
    return ranked.where(F.col("rank") < n).select(*keys, "id")
