"""States of flow logs that can be merged: quantile sketches of attributes and distinct-host sketches.

A log is read once. Its states take a few kB per scenario and attribute, and what several logs have together follows from
their states: ranks and quantiles of an attribute from KLL sketches, numbers of different hosts, of those that two logs
share and of those that only one has from theta sketches. Sketches are built per task and merged, so no value is counted
and no scenario meets in one task.

``RANK_ERROR`` is the largest difference between the rank asked for and that of the value returned, as a share of all
values, and ``COUNT_ERROR`` that of a number of hosts relative to the union they are taken from, both three times the
usual error. Fewer than ``2 ** LG_K`` hosts are counted exactly.

Defined cases: nulls are not counted; an attribute without values has no sketch and no histogram; NaN and infinite values
are left out of sketches; an empty table has no states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostweave.functions.columns import as_number
from hostweave.operators.scale import by
from hostweave.sources.flow_csv import read_table, write_table
from hostweave.sources.schema import ATTRIBUTES

# Size of a quantile sketch and of the logarithm of a distinct sketch.
KLL_K, LG_K = 1024, 12
RANK_ERROR = 3 * 2.296 / KLL_K**0.9723
COUNT_ERROR = 3 / 2 ** (LG_K / 2)

# Quantiles by which shares are counted.
GRID = 1000

NUMBERS = [(name, kind) for name, kind in ATTRIBUTES if kind != "text"]


def _finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def attribute_sketches(flows: DataFrame, k: int = KLL_K) -> DataFrame:
    """(scenario, attribute, n, least, most, sketch): all numeric attributes in one pass."""
    keys = by(flows)
    numbers = flows.select(*keys, *[_finite(as_number(F.col(name), kind)).alias(name) for name, kind in NUMBERS])
    states = [
        F.struct(F.count(name).alias("n"), F.min(name).alias("least"), F.max(name).alias("most"), F.kll_sketch_agg_double(name, F.lit(k)).alias("sketch")).alias(name)
        for name, _ in NUMBERS
    ]
    wide = numbers.groupBy(*keys).agg(*states)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("attribute"), F.col(name).alias("s")) for name, _ in NUMBERS]))
    return wide.select(*keys, each.alias("a")).select(*keys, "a.attribute", "a.s.*").where("n > 0")


def merged_attributes(sketches: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Sketches of all scenarios together, or per columns ``keep``."""
    return sketches.groupBy(*keep, "attribute").agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch").alias("sketch")
    )


def sketch_histograms(sketches: DataFrame, max_bins: int = 100) -> DataFrame:
    """Equal-frequency intervals from sketches: the most, up to ``max_bins``, with distinct edges.

    ``p`` is the share of the values between the edges, the lower one left out but for the first interval. It is counted on
    GRID quantiles and within 2 * (RANK_ERROR + 1 / GRID) of the true one.
    """
    keys = by(sketches)

    def edges(q: int) -> Column:
        # the outer edges are known exactly
        inner = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(k / q) for k in range(1, q)])) if q > 1 else F.array().cast("array<double>")
        return F.struct(F.lit(q).alias("q"), F.concat(F.array("least"), inner, F.array("most")).alias("edges"))

    tried = sketches.withColumn("t", F.explode(F.array(*map(edges, range(1, max_bins + 1))))).select("*", "t.*")
    best = F.max_by(F.struct("edges", "n", "sketch"), F.col("q"))
    kept = tried.where((F.size(F.array_distinct("edges")) == F.size("edges")) | (F.col("q") == 1)).groupBy(*keys, "attribute").agg(best.alias("b"))
    grid = F.kll_sketch_get_quantile_double("b.sketch", F.array(*[F.lit((i + 0.5) / GRID) for i in range(GRID)]))
    found = kept.select(*keys, "attribute", "b.n", "b.edges", grid.alias("grid"))
    bins = found.select(*keys, "attribute", "n", "edges", "grid", F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("bin"))
    low, high = F.element_at("edges", F.col("bin")), F.element_at("edges", F.col("bin") + 1)
    inside = F.size(F.filter("grid", lambda x: ((x > low) | (F.col("bin") == 1)) & (x <= high)))
    return bins.select(*keys, "attribute", "bin", low.alias("lo"), high.alias("hi"), (inside / GRID).alias("p"), F.col("n").alias("total"))


def host_sketches(flows: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """(scenario, hosts, sources, targets): sketches of the different hosts at either end, and at each end."""
    sketch = lambda c, name: F.theta_sketch_agg(c, F.lit(lg_k)).alias(name)
    keys = by(flows)
    ends = flows.groupBy(*keys).agg(sketch("src_addr", "sources"), sketch("dst_addr", "targets"))
    return ends.select(*keys, F.theta_union("sources", "targets", F.lit(lg_k)).alias("hosts"), "sources", "targets")


def distinct_hosts(sketches: DataFrame) -> DataFrame:
    """Numbers of different hosts, sources and targets, and of hosts that are both."""
    both = F.theta_intersection("sources", "targets")
    columns = {"n_hosts": "hosts", "n_sources": "sources", "n_targets": "targets", "n_both": both}
    return sketches.select(*by(sketches), *[F.theta_sketch_estimate(c).alias(name) for name, c in columns.items()])


def host_changes(sketches: DataFrame) -> DataFrame:
    """Hosts of each scenario, how many of them the scenario before has too, and how many are new or gone since.

    Scenarios follow each other by name; there is a row for each, so the window orders few rows.
    """
    before = F.lag("hosts").over(Window.orderBy("scenario"))
    empty = F.theta_difference("hosts", "hosts")
    pairs = sketches.select("scenario", "hosts", F.coalesce(before, empty).alias("before"))
    columns = {
        "n_hosts": F.col("hosts"),
        "n_stayed": F.theta_intersection("hosts", "before"),
        "n_new": F.theta_difference("hosts", "before"),
        "n_gone": F.theta_difference("before", "hosts"),
        "n_together": F.theta_union("hosts", "before"),
    }
    return pairs.select("scenario", *[F.theta_sketch_estimate(c).alias(name) for name, c in columns.items()])


def add_states(flows: DataFrame, folder: str) -> None:
    """Store the states of the logs in ``flows`` by scenario; states of other scenarios stay and are not read."""
    write_table(attribute_sketches(flows), f"{folder}/attributes")
    write_table(host_sketches(flows), f"{folder}/hosts")


def read_states(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Stored states: attribute sketches and host sketches of all scenarios."""
    return read_table(spark, f"{folder}/attributes"), read_table(spark, f"{folder}/hosts")
