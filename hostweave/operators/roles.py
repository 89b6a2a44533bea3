"""Behavioural roles of hosts and the profile of labelled bot hosts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostweave.functions.columns import is_bot
from hostweave.functions.draws import draw_key, draw_number, number_bucket
from hostweave.operators.scale import by, cut, cut_and_see, running_total, with_row
from hostweave.sources.schema import FEATURES

# Given centres as a list, or as a table of (scenario if there are any, role, features).
Centroids = Sequence[Sequence[float]] | DataFrame

# Digits that centres are kept to, so that the order of sums does not decide.
CENTRE_DIGITS = 9


def feature_stats(features: DataFrame) -> DataFrame:
    """Mean and population deviation of each feature, one row per scenario; a deviation of 0 becomes 1."""
    mean = [F.avg(c).alias("avg_" + c) for c in FEATURES]
    std = [F.stddev_pop(c).alias("std_" + c) for c in FEATURES]
    return features.groupBy(*by(features)).agg(*mean, *std).replace(0.0, 1.0, ["std_" + c for c in FEATURES])


def _scaled(name: str, value: str) -> Column:
    return ((F.col(value) - F.col("avg_" + name)) / F.col("std_" + name)).alias(name)


def zscore(features: DataFrame) -> DataFrame:
    """Features with mean 0 and deviation 1 within their scenario."""
    return with_row(features, feature_stats(features)).select(
        *by(features), "id", *[_scaled(c, c) for c in FEATURES]
    )


def nearest(centroids: Sequence[Sequence[float]]) -> Column:
    """Index of the nearest centroid; the smaller one on a tie."""
    distances = F.array(
        *[sum((F.pow(F.col(c) - F.lit(float(x)), 2) for c, x in zip(FEATURES, point)), F.lit(0.0)) for point in centroids]
    )
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def with_nearest(points: DataFrame, centroids: Centroids) -> DataFrame:
    """Add ``role``, the nearest centre of the point's scenario, the smaller number on a tie."""
    if not isinstance(centroids, DataFrame):
        return points.withColumn("role", nearest(centroids))
    # a few centres per scenario in one row
    centre = F.struct(F.col("role").cast("int").alias("role"), *FEATURES)
    lists = centroids.groupBy(*by(centroids)).agg(F.sort_array(F.collect_list(centre)).alias("_centres"))

    def far(c: Column) -> Column:
        distance = sum((F.pow(F.col(name) - c[name], 2) for name in FEATURES), F.lit(0.0))
        return F.struct(distance.alias("distance"), c["role"].alias("role"))

    known = reduce(and_, [F.col(c).isNotNull() for c in FEATURES])
    found = F.array_min(F.transform("_centres", far))["role"]
    return with_row(points, lists).withColumn("role", F.when(known, found)).drop("_centres")


def assign_roles(scaled: DataFrame, centroids: Centroids) -> DataFrame:
    return with_nearest(scaled, centroids).select(*by(scaled), F.col("id").alias("node"), "role")


def fit_centroids(scaled: DataFrame, n_roles: int = 4, seed: int = 0, rounds: int = 10) -> DataFrame:
    """k-means centres of all scenarios in one pass per round, as a table of (scenario, role, features).

    Centres start at the ``n_roles`` hosts of each scenario that come first in hash order and move ``rounds`` times, or
    until none does; a centre without hosts stays where it is. Roles are numbered by the centres in ascending order.
    ``scaled`` is read every round, so pass a stored table.
    """
    keys = by(scaled)
    drawn = scaled.withColumn("h", draw_number(seed, "start", draw_key("id")))
    order = ["h", "id"]
    if keys:
        # the bound on the plain rank lets every task drop all but its first hosts before they meet
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        first = drawn.withColumn("rank", rank).where(F.col("rank") <= n_roles).withColumn("role", F.col("rank") - 1).drop("rank")
    else:
        first = drawn.orderBy(*order).limit(n_roles).withColumn("role", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1)
    rounded = [F.round(c, CENTRE_DIGITS).alias(c) for c in FEATURES]
    centres = cut(first.select(*keys, "role", *rounded))
    for _ in range(rounds):
        moved = with_nearest(scaled, centres).groupBy(*keys, "role").agg(*[F.round(F.avg(c), CENTRE_DIGITS).alias("_" + c) for c in FEATURES])
        old = centres
        now = [F.coalesce("_" + c, c).alias(c) for c in FEATURES]
        change = reduce(or_, [~F.col("_" + c).eqNullSafe(F.col(c)) & F.col("_" + c).isNotNull() for c in FEATURES])
        joined = old.join(moved, [*keys, "role"], "left").select(*keys, "role", *now, change.alias("moved"))
        centres, seen = cut_and_see(joined, n=F.count_if("moved"))
        centres = centres.drop("moved")
        if not seen["n"]:
            break
    # a few rows per scenario
    place = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return centres.select(*keys, (F.row_number().over(place.orderBy(*FEATURES, "role")) - 1).alias("role"), *FEATURES)


def cluster_roles(features: DataFrame, n_roles: int = 4, seed: int = 0) -> DataFrame:
    """Role of every host by k-means on the scaled features, each scenario by itself, all in the same jobs."""
    scaled = cut(zscore(features))
    return assign_roles(scaled, fit_centroids(scaled, n_roles, seed))


def bot_hosts(flows: DataFrame) -> DataFrame:
    """Distinct sources of flows labelled as bot traffic."""
    return flows.where(is_bot(F.col("label"))).select(*by(flows), F.col("src_addr").alias("id")).distinct()


def missing_bots(flows: DataFrame, features: DataFrame) -> DataFrame:
    """Bot hosts without a feature row."""
    return bot_hosts(flows).join(features, [*by(flows), "id"], "left_anti")


def bot_profile(flows: DataFrame, features: DataFrame) -> DataFrame:
    """Number of bot hosts, range of their degrees, and mean features, one row per scenario.

    A scenario without bot flows has 0 bots and nulls.
    """
    keys = by(flows)
    joined = bot_hosts(flows).join(features, [*keys, "id"], "left")
    profile = joined.groupBy(*keys).agg(
        F.count("id").alias("n_bots"),
        F.min("indegree").cast("long").alias("in_min"),
        F.max("indegree").cast("long").alias("in_max"),
        F.min("outdegree").cast("long").alias("out_min"),
        F.max("outdegree").cast("long").alias("out_max"),
        *[F.avg(c).alias("mean_" + c) for c in FEATURES],
    )
    if keys:
        profile = flows.select(*keys).distinct().join(profile, keys, "left").na.fill(0, ["n_bots"])
    return profile


def bot_role(profile: DataFrame, stats: DataFrame, centroids: Centroids, scale_profile: bool = True) -> DataFrame:
    """The profile with ``role``, the role nearest to the mean bot.

    ``scale_profile=False`` compares the raw means with the scaled centroids.
    """
    keys = by(profile)
    point = with_row(profile, stats).select(
        *keys, *[_scaled(c, "mean_" + c) if scale_profile else F.col("mean_" + c).alias(c) for c in FEATURES]
    )
    return with_row(profile, with_nearest(point, centroids).select(*keys, "role"))


def bot_candidates(hosts: DataFrame, profile: DataFrame, seed: int = 0) -> DataFrame:
    """At most ``n_bots`` hosts of the bot role whose degrees lie in the bots' range.

    ``hosts`` has (id, role, indegree, outdegree). Which hosts are taken is
    decided by a hash, and their rank is found without sorting all in one task.
    """
    keys = by(hosts)
    ranges = profile.select(*keys, "role", "n_bots", "in_min", "in_max", "out_min", "out_max")
    fitting = (
        with_row(hosts, ranges, "bot_")
        .where(
            (F.col("role") == F.col("bot_role"))
            & F.col("indegree").between(F.col("bot_in_min"), F.col("bot_in_max"))
            & F.col("outdegree").between(F.col("bot_out_min"), F.col("bot_out_max"))
        )
        .select(*keys, "id", "bot_n_bots", draw_number(seed, "bot", draw_key("id")).alias("h"))
    )
    bucket = number_bucket(F.col("h"), hosts.count())
    ranked = running_total(fitting, F.lit(1), ["h", "id"], keys, bucket, "rank")
    return ranked.where("rank < bot_n_bots").select(*keys, "id")
