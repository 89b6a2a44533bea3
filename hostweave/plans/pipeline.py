"""The whole way from flow logs to parameters to a scored synthetic table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.operators import histograms, params, roles, synth
from hostweave.operators.scale import by, cut
from hostweave.plans.features import node_features
from hostweave.sources.schema import SYNTH_COLUMNS


@dataclass
class Model:
    """Everything that is estimated from flows; all tables are stored."""

    roles: DataFrame
    profile: DataFrame
    sizes: DataFrame
    role_edges: DataFrame
    degree_histogram: DataFrame
    attribute_histogram: DataFrame


def estimate(flows: DataFrame, n_roles: int = 4, n_bins: int = 200, seed: int = 0) -> Model:
    """Roles by k-means, bot profile, role parameters and attribute histograms of all logs, each scenario by itself."""
    features = cut(node_features(flows))
    stats = roles.feature_stats(features)
    scaled = cut(roles.zscore(features))
    centroids = cut(roles.fit_centroids(scaled, n_roles, seed))
    table = cut(roles.assign_roles(scaled, centroids))
    profile = cut(roles.bot_role(roles.bot_profile(flows, features), stats, centroids))
    return estimate_with_roles(flows, table, profile, n_roles, n_bins)


def estimate_with_roles(
    flows: DataFrame, table: DataFrame, profile: DataFrame, n_roles: int = 4, n_bins: int = 200
) -> Model:
    """The model for given roles and bot profile."""
    degrees = params.role_degrees(flows, table)
    return Model(
        roles=table,
        profile=profile,
        sizes=cut(params.role_sizes(table, n_roles)),
        role_edges=cut(params.role_edges(flows, table, n_roles)),
        degree_histogram=cut(params.degree_hist2d(degrees, n_bins)),
        attribute_histogram=cut(histograms.cumulative(histograms.attr_histograms(flows))),
    )


def synthesize(model: Model, seed: int = 0, start: int = 0) -> DataFrame:
    """A synthetic flow table with the column names of a flow log."""
    hosts = cut(synth.synth_nodes(model.degree_histogram, seed, start))
    edge_list = synth.synth_edges(hosts, model.role_edges, seed)
    bots = cut(roles.bot_candidates(hosts, model.profile, seed))
    flows = synth.label_flows(synth.draw_attributes(edge_list, model.attribute_histogram, seed), bots)
    return flows.select(
        *by(flows),
        F.col("src").alias("source"),
        F.col("dst").alias("destination"),
        "proto",
        *[
            (F.col(name) if name in flows.columns else F.lit(None).cast("string")).alias(header)
            for header, name in SYNTH_COLUMNS
        ],
        F.col("label").alias("Label"),
    )
