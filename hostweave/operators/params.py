"""Per-role parameters: sizes, role-to-role flows, two-dimensional degree histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostweave.functions.columns import ratio
from hostweave.operators.graph import flow_degrees, flow_pairs
from hostweave.operators.scale import by, cut, hot_keys, is_small, join_small, skew_join

# Fixed value: bins of width one before the wide ones.
THIN_BINS = 20


def role_list(df: DataFrame, n_roles: int, name: str = "role") -> DataFrame:
    """Every role number up to ``n_roles``, or up to the largest one in the table, per scenario; ``top`` is the last."""
    keys = by(df)
    top = F.greatest(F.lit(n_roles - 1), F.max("role").cast("int")).alias("top")
    base = df.groupBy(*keys).agg(top) if keys else df.agg(top)
    return base.select(*keys, "top", F.explode(F.sequence(F.lit(0), F.col("top"))).alias(name))


def role_sizes(roles: DataFrame, n_roles: int = 4) -> DataFrame:
    """Number of hosts per role, empty roles included."""
    keys = by(roles)
    counts = roles.groupBy(*keys, "role").agg(F.count("*").alias("n_nodes"))
    return role_list(roles, n_roles).drop("top").join(counts, [*keys, "role"], "left").na.fill(0, ["n_nodes"])


def scenario_size(sizes: DataFrame) -> DataFrame:
    """Number of hosts of a scenario from its role sizes."""
    return sizes.groupBy(*by(sizes)).agg(F.sum("n_nodes").alias("n_nodes"))


def role_flow_counts(flows: DataFrame, roles: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Flows from role to role, only pairs that occur.

    A small role table is broadcast to the flows. A large one is joined to the
    distinct host pairs instead, with the rows of hot hosts split.
    """
    keys = by(flows)
    src = roles.select(*keys, F.col("node").alias("src"), F.col("role").alias("src_role"))
    dst = roles.select(*keys, F.col("node").alias("dst"), F.col("role").alias("dst_role"))
    if hot_rows is None and is_small(roles):
        joined = (
            flows.select(*keys, F.col("src_addr").alias("src"), F.col("dst_addr").alias("dst"))
            .join(F.broadcast(src), [*keys, "src"])
            .join(F.broadcast(dst), [*keys, "dst"])
            .withColumn("n", F.lit(1))
        )
    else:
        joined = pairs = cut(flow_pairs(flows))
        for side, table, other in (("src", src, "dst"), ("dst", dst, "src")):
            on = [*keys, side]
            counts = pairs.groupBy(*on).agg(F.count("*").alias("pairs"))
            joined = skew_join(joined, table, on, hot_keys(counts, on, "pairs", hot_rows), [other])
    return joined.groupBy(*keys, "src_role", "dst_role").agg(F.sum("n").alias("n"))


def role_edges(flows: DataFrame, roles: DataFrame, n_roles: int = 4, hot_rows: int | None = None) -> DataFrame:
    """Dense role x role table: flows, probability given the source role, joint probability."""
    keys = by(flows)
    grid = role_list(roles, n_roles, "src_role")
    grid = grid.withColumn("dst_role", F.explode(F.sequence(F.lit(0), F.col("top")))).drop("top")
    counts = role_flow_counts(flows, roles, hot_rows)
    dense = grid.join(counts, [*keys, "src_role", "dst_role"], "left").na.fill(0, ["n"])
    row = F.sum("n").over(Window.partitionBy(*keys, "src_role"))
    # n_roles^2 rows per scenario, so one window over a scenario is small
    whole = F.sum("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    return dense.select(
        *keys,
        "src_role",
        "dst_role",
        "n",
        ratio(F.col("n"), row).alias("p_trans"),
        ratio(F.col("n"), whole).alias("p_joint"),
    )


def role_degrees(flows: DataFrame, roles: DataFrame) -> DataFrame:
    """Flow degrees of every host with a role; hosts without flows in a direction get 0."""
    keys = by(flows)
    return (
        roles.select(*keys, F.col("node").alias("id"), "role")
        .join(flow_degrees(flows), [*keys, "id"], "left")
        .na.fill(0, ["indegree", "outdegree", "degree"])
        .select(*keys, "id", "role", "indegree", "outdegree")
    )


def _width(top: str, n_bins: int) -> Column:
    wide = n_bins - THIN_BINS
    return F.greatest(F.lit(1).cast("long"), F.ceil((F.max(top) + 1 - THIN_BINS) / wide))


def bin_widths(degrees: DataFrame, n_bins: int = 200) -> DataFrame:
    """Width of the wide bins per role, from the role's largest degrees."""
    return degrees.groupBy(*by(degrees), "role").agg(
        _width("indegree", n_bins).alias("in_width"), _width("outdegree", n_bins).alias("out_width")
    )


def _lower(index: Column, width: Column) -> Column:
    """Lower edge of a bin; the lower edge of the next bin is its upper edge."""
    return F.when(index < THIN_BINS, index).otherwise(THIN_BINS + (index - THIN_BINS) * width)


def _bin(degree: Column, width: Column) -> Column:
    return F.when(degree < THIN_BINS, degree).otherwise(THIN_BINS + F.floor((degree - THIN_BINS) / width))


def degree_bins(degrees: DataFrame, n_bins: int = 200) -> DataFrame:
    """All bins of both directions per role that has hosts."""
    index = F.col("bin")
    return (
        bin_widths(degrees, n_bins)
        .unpivot([*by(degrees), "role"], ["in_width", "out_width"], "direction", "width")
        .withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))))
        .select(
            *by(degrees),
            "role",
            F.regexp_replace("direction", "_width", "").alias("direction"),
            "bin",
            _lower(index, F.col("width")).alias("lo"),
            _lower(index + 1, F.col("width")).alias("hi"),
        )
    )


def degree_hist2d(degrees: DataFrame, n_bins: int = 200, dense: bool = False) -> DataFrame:
    """Hosts per (in-degree bin, out-degree bin) of their role; ``dense`` adds the empty cells."""
    keys = [*by(degrees), "role"]
    widths = bin_widths(degrees, n_bins)
    cells = (
        join_small(degrees, widths, keys)
        .withColumn("in_bin", _bin(F.col("indegree"), F.col("in_width")))
        .withColumn("out_bin", _bin(F.col("outdegree"), F.col("out_width")))
        .groupBy(*keys, "in_bin", "out_bin", "in_width", "out_width")
        .agg(F.count("*").alias("n"))
    )
    if dense:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long")))
        grid = widths.withColumn("in_bin", every).withColumn("out_bin", every)
        cells = grid.join(cells, [*keys, "in_bin", "out_bin", "in_width", "out_width"], "left").na.fill(0, ["n"])
    i, o, iw, ow = (F.col(c) for c in ("in_bin", "out_bin", "in_width", "out_width"))
    return cells.select(
        *keys,
        _lower(i, iw).alias("in_lo"),
        _lower(i + 1, iw).alias("in_hi"),
        _lower(o, ow).alias("out_lo"),
        _lower(o + 1, ow).alias("out_hi"),
        "n",
    )
