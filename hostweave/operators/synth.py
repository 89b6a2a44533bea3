"""Synthetic flow tables from degree, role and attribute histograms.

All draws are hashes of a seed and the row's own key, so the same seed gives
the same table whatever the cluster does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostweave.functions.columns import as_number, is_bot_like
from hostweave.functions.draws import (
    draw_key,
    draw_number,
    integer_between,
    lower_uniform,
    number_bucket,
    uniform,
    upper_uniform,
)
from hostweave.operators.scale import by, cut, expand, is_small, join_small, running_total
from hostweave.sources.schema import ATTRIBUTES, BOT_LABEL, NORMAL_LABEL, SYNTH_COLUMNS

# Consecutive node ids whose degrees are added up in one task.
ID_BLOCK = 1_000_000
# Consecutive in-stubs that share a join key when stubs are paired.
SLOT_CELL = 16
# Attributes drawn in one generated method; with more of them it gets too long for the JVM to compile.
DRAWS_PER_STAGE = 3
# More than any table has, so that coalesce merges none.
MANY_PARTITIONS = 10_000_000
# Parts of the unit interval that share a join key when values are drawn.
DRAW_CELLS = 64


def scenario_starts(sizes: DataFrame, start: int = 0) -> DataFrame:
    """First node id of each scenario, from its size; one row per input log."""
    earlier = Window.partitionBy(F.lit(0)).orderBy("scenario").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("scenario", (F.lit(start) + F.coalesce(F.sum("n_nodes").over(earlier), F.lit(0))).alias("start"))


def synth_nodes(histogram: DataFrame, seed: int = 0, start: int = 0) -> DataFrame:
    """One host per count of the degree histogram, with integer degrees drawn inside its cell.

    Ids are contiguous from ``start``, by role and cell, scenario after scenario.
    """
    keys = by(histogram)
    cells = cut(histogram.where("n >= 1"))
    # at most n_roles * n_bins^2 rows per scenario
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("role", "in_lo", "out_lo")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    if keys:
        sizes = cells.groupBy(*keys).agg(F.sum("n").alias("n_nodes"))
        cells = join_small(cells, scenario_starts(sizes, start), keys)
    else:
        cells = cells.withColumn("start", F.lit(start).cast("long"))
    return (
        expand(cells, "n", "i")
        .withColumn("id", F.col("start") + F.col("offset") + F.col("i"))
        .select(
            *keys,
            "id",
            "role",
            integer_between(F.col("in_lo"), F.col("in_hi"), uniform(seed, "in", "id")).alias("indegree"),
            integer_between(F.col("out_lo"), F.col("out_hi"), uniform(seed, "out", "id")).alias("outdegree"),
        )
    )


def stub_supply(hosts: DataFrame) -> DataFrame:
    """Hosts, in-stubs and out-stubs per role, and whether the in-stubs run out."""
    keys = by(hosts)
    return (
        hosts.groupBy(*keys, "role")
        .agg(
            F.count("*").alias("n_nodes"), F.sum("indegree").alias("in_stubs"), F.sum("outdegree").alias("out_stubs")
        )
        .withColumn("short", F.col("in_stubs") <= F.col("out_stubs"))
    )


def destination_shares(role_edges: DataFrame, supply: DataFrame) -> DataFrame:
    """Interval of the unit range that leads from a source role to each destination role.

    Only roles with in-stubs can be reached. A source role without flows to
    any of them leads to the first of them.
    """
    keys = by(role_edges)
    fed = supply.where("in_stubs > 0").select(*keys, F.col("role").alias("dst_role"))
    # n_roles^2 rows per scenario
    reach = role_edges.select(*keys, "src_role", "dst_role", "n").join(fed, [*keys, "dst_role"], "left_semi")
    row = Window.partitionBy(*keys, "src_role")
    upto = F.sum("n").over(row.orderBy("dst_role").rowsBetween(Window.unboundedPreceding, 0))
    return (
        reach.withColumn("total", F.sum("n").over(row))
        .withColumn("n", F.when((F.col("total") == 0) & (F.row_number().over(row.orderBy("dst_role")) == 1), 1).otherwise(F.col("n")))
        .withColumn("total", F.greatest("total", F.lit(1)))
        .withColumn("upto", upto)
        .where("n > 0")
        .select(
            *keys,
            "src_role",
            "dst_role",
            ((F.col("upto") - F.col("n")) / F.col("total")).alias("lo"),
            (F.col("upto") / F.col("total")).alias("hi"),
        )
    )


def out_stubs(hosts: DataFrame, shares: DataFrame, seed: int = 0) -> DataFrame:
    """One row per out-stub of a host with the role it leads to."""
    keys = by(hosts)
    stubs = expand(hosts.select(*keys, "id", F.col("role").alias("src_role"), "outdegree"), "outdegree", "stub")
    drawn = stubs.withColumn("u", uniform(seed, "role", "id", "stub"))
    return (
        join_small(drawn, shares, [*keys, "src_role"])
        .where("u > lo and u <= hi")
        .select(*keys, "id", "stub", "src_role", "dst_role")
    )


def pair_stubs(stubs: DataFrame, hosts: DataFrame, supply: DataFrame, seed: int = 0) -> DataFrame:
    """Edges from out-stubs and the hosts' in-stubs; self-loops are dropped.

    Out-stubs that lead to a role are put in random order and dealt to its
    in-stubs, starting over when these run out. A host owns a run of in-stub
    numbers, so it is found by its cell of numbers and the in-stubs themselves
    need not be written out.
    """
    keys = by(hosts)
    total = supply.where("in_stubs > 0").select(*keys, F.col("role").alias("dst_role"), "in_stubs")
    shuffled = stubs.withColumn("h", draw_number(seed, "pair", draw_key("id", "stub")))
    rows = supply.agg(F.sum("out_stubs")).first()[0] or 0
    ranked = running_total(
        shuffled, F.lit(1), ["h", "id", "stub"], [*keys, "dst_role"], number_bucket(F.col("h"), rows), "rank"
    )
    dealt = (
        join_small(ranked, total, [*keys, "dst_role"])
        .withColumn("slot", F.col("rank") % F.col("in_stubs"))
        .withColumn("cell", F.floor(F.col("slot") / SLOT_CELL))
        .select(*keys, "dst_role", "cell", "slot", F.col("id").alias("src"), "stub", "src_role")
    )
    owners = running_total(
        hosts.where("indegree > 0").select(*keys, F.col("role").alias("dst_role"), F.col("id").alias("dst"), "indegree"),
        "indegree",
        ["dst"],
        [*keys, "dst_role"],
        F.floor(F.col("dst") / ID_BLOCK),
        "first",
    ).withColumn("stop", F.col("first") + F.col("indegree"))
    runs = owners.select(
        *keys,
        "dst_role",
        "dst",
        "first",
        "stop",
        F.explode(F.sequence(F.floor(F.col("first") / SLOT_CELL), F.floor((F.col("stop") - 1) / SLOT_CELL))).alias("cell"),
    )
    return (
        dealt.join(runs, [*keys, "dst_role", "cell"])
        .where("slot >= first and slot < stop and src <> dst")
        .select(*keys, "src", "stub", "dst", "src_role", "dst_role")
    )


def synth_edges(hosts: DataFrame, role_edges: DataFrame, seed: int = 0) -> DataFrame:
    """Edges between synthetic hosts; reads ``hosts`` several times, so pass a stored table."""
    supply = cut(stub_supply(hosts))
    return pair_stubs(out_stubs(hosts, destination_shares(role_edges, supply), seed), hosts, supply, seed)


def draw_attributes(edge_list: DataFrame, histogram: DataFrame, seed: int = 0) -> DataFrame:
    """One column per attribute of a synthetic flow, drawn from its histogram for every (src, stub).

    ``histogram`` has the cumulative shares and is read once per attribute, so
    pass a stored table. An interval gives a number inside it. An attribute
    without a histogram is null, and so is the share of nulls of a category.
    """
    keys = by(edge_list)
    small = is_small(histogram)
    result = edge_list.withColumn("key", draw_key("src", "stub"))
    drawn = {"proto", *[name for _, name in SYNTH_COLUMNS]}
    for n, (name, kind) in enumerate([a for a in ATTRIBUTES if a[0] in drawn]):
        if n and n % DRAWS_PER_STAGE == 0:
            # a narrow step that moves no rows but ends the generated method
            result = result.coalesce(MANY_PARTITIONS)
        typed = F.col("label").cast("timestamp") if kind == "time" else F.col("label")
        bins = histogram.where(F.col("attribute") == name).select(
            *keys,
            "label",
            "cum_lo",
            "cum_hi",
            # a category is an interval of length 0
            F.coalesce("lo", as_number(typed, kind)).alias("lo"),
            F.coalesce(F.col("hi") - F.col("lo"), F.lit(0.0)).alias("span"),
            F.explode(
                F.sequence(F.floor(F.col("cum_lo") * DRAW_CELLS), F.floor(F.col("cum_hi") * DRAW_CELLS))
            ).alias("cell"),
        )
        bins = F.broadcast(bins) if small else bins
        left = (
            result.withColumn("h", draw_number(seed, name, F.col("key")))
            .withColumn("u", upper_uniform(F.col("h")))
            .withColumn("cell", F.floor(F.col("u") * DRAW_CELLS))
            .alias("l")
        )
        right = bins.alias("r")
        match = (F.col("l.cell") == F.col("r.cell")) & (F.col("u") > F.col("cum_lo")) & (F.col("u") <= F.col("cum_hi"))
        for key in keys:
            match = match & (F.col("l." + key) == F.col("r." + key))
        value = F.col("label") if kind == "text" else F.col("lo") + lower_uniform(F.col("h")) * F.col("span")
        result = left.join(right, match, "left").select(
            *[F.col("l." + c).alias(c) for c in result.columns], value.alias(name)
        )
    return result.drop("key")


def label_flows(edge_list: DataFrame, bots: DataFrame) -> DataFrame:
    """Flows of a chosen bot host get the bot label, all others the normal one."""
    keys = by(edge_list)
    chosen = bots.select(*keys, F.col("id").alias("src"), F.lit(True).alias("chosen"))
    chosen = F.broadcast(chosen) if is_small(bots) else chosen
    label = F.when(F.col("chosen"), F.lit(BOT_LABEL)).otherwise(F.lit(NORMAL_LABEL))
    return edge_list.join(chosen, [*keys, "src"], "left").withColumn("label", label).drop("chosen")


def flows_by_time(flows: DataFrame) -> DataFrame:
    """Flows in order of their start.

    Equal starts are put in order of the other columns, so that a moment with
    very many flows is divided over several tasks.
    """
    return flows.orderBy("start_time", *[c for c in flows.columns if c != "start_time"])


def sample_flows(flows: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` flows by start that are not labelled as bot traffic."""
    return flows_by_time(flows.where(~is_bot_like(F.col("label")))).limit(n)
