"""Registered queries over the test tables.

The test tables hold no flow logs, so ``lineitem`` is read as one: parts are
sources, suppliers are destination hubs, in one shared host id space.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostweave.functions.columns import port_number
from hostweave.operators import (
    distance,
    estimates,
    graph,
    histograms,
    pagerank,
    params,
    peeling,
    placing,
    roles,
    sketches,
    synth,
    triangles,
    validate,
)
from hostweave.operators.scale import PARTITION_ROWS, checkpoint_folder, cut, running_total
from hostweave.plans import features
from hostweave.sources import flow_csv
from hostweave.sources.schema import FEATURES, FLOW_COLUMNS

Query = Callable[[SparkSession, str], DataFrame]

# The view runs unchanged in Spark SQL and in the SQL of the oracles.
FLOW_VIEW = """
SELECT CAST(l_shipdate AS TIMESTAMP) AS start_time,
       l_tax AS dur,
       CASE l_returnflag WHEN 'A' THEN 'tcp' WHEN 'N' THEN 'udp' ELSE 'icmp' END AS proto,
       CAST(l_partkey AS STRING) AS src_addr,
       CAST(l_orderkey % 1024 AS STRING) AS sport,
       CASE l_linestatus WHEN 'F' THEN '->' ELSE '<->' END AS dir,
       CAST(l_suppkey AS STRING) AS dst_addr,
       CAST(l_linenumber AS STRING) AS dport,
       concat(l_returnflag, '_', l_linestatus) AS state,
       CASE WHEN l_discount = 0.0 THEN NULL ELSE CAST(0.0 AS DOUBLE) END AS s_tos,
       CAST(NULL AS DOUBLE) AS d_tos,
       CAST(l_quantity AS BIGINT) AS tot_pkts,
       CAST(floor(l_extendedprice) AS BIGINT) AS tot_bytes,
       CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS src_bytes,
       CASE WHEN l_partkey <= 10 AND l_returnflag = 'R'
            THEN 'flow=From-Botnet' ELSE 'flow=Background' END AS label{extra}
FROM {table}
"""

# Role centres for the queries that need no k-means, in scaled feature space.
CENTROIDS = [
    [-0.3, -0.5, 0.5, -0.3, 0.5, 0.0],
    [-0.3, 0.5, -0.5, -0.3, -0.5, 0.0],
    [3.0, 0.0, -2.0, 3.0, -2.0, 0.5],
    [0.5, 1.5, 0.0, 0.5, 0.0, -1.0],
]

N_ROLES = 4


# The same rows with what real logs have: missing ends and protocols, hexadecimal ports, and a wide text attribute.
DIRTY_VIEW = """
SELECT CAST(l_shipdate AS TIMESTAMP) AS start_time, l_tax AS dur,
       CASE WHEN l_linenumber = 3 THEN NULL ELSE concat('p', CAST(l_orderkey % 150 AS STRING)) END AS proto,
       CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE CAST(l_partkey AS STRING) END AS src_addr,
       CASE WHEN l_orderkey % 3 = 0 THEN concat('0x', CAST(l_orderkey % 1000 AS STRING))
            WHEN l_orderkey % 3 = 1 THEN concat('0x00000000000000000', CAST(l_orderkey % 100 AS STRING))
            WHEN l_orderkey % 5 = 0 THEN '0x12345678901234567' ELSE 'none' END AS sport,
       CASE l_linestatus WHEN 'F' THEN '->' ELSE '<->' END AS dir,
       CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(l_suppkey AS STRING) END AS dst_addr,
       CAST(l_linenumber AS STRING) AS dport, CAST(NULL AS STRING) AS state, CAST(NULL AS DOUBLE) AS s_tos,
       CAST(NULL AS DOUBLE) AS d_tos, CAST(l_quantity AS BIGINT) AS tot_pkts,
       CAST(floor(l_extendedprice) AS BIGINT) AS tot_bytes, CAST(l_quantity AS BIGINT) AS src_bytes, 'x' AS label
FROM {table}
"""


def dirty_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DIRTY_VIEW, table=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def flows(spark: SparkSession, sf_dir: str, scenarios: bool = False) -> DataFrame:
    """The proxy flow log; with ``scenarios`` each return flag is a log of its own."""
    extra = ", l_returnflag AS scenario" if scenarios else ""
    view = FLOW_VIEW.format(extra=extra, table="{table}")
    return spark.sql(view, table=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def half_flows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The log divided in two by direction."""
    whole = flows(spark, sf_dir)
    return whole.where("dir = '->'"), whole.where("dir = '<->'")


def stored_edges(spark: SparkSession, sf_dir: str, scenarios: bool = False) -> DataFrame:
    return cut(graph.edges(flows(spark, sf_dir, scenarios)))


def fixed_roles(log: DataFrame) -> DataFrame:
    """A role for every host by a fixed rule, so that parameters can be checked without k-means."""
    hosts = graph.nodes(graph.flow_edges(log))
    role = (F.col("id").cast("long") % N_ROLES).cast("int")
    return cut(hosts.select(*[c for c in hosts.columns if c != "id"], F.col("id").alias("node"), role.alias("role")))


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(features.node_features(flows(spark, sf_dir)))


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    """Doubles whose sums may differ in the last bits, made comparable."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def on_edges(function: Callable[[DataFrame], DataFrame], stored: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(stored_edges(spark, sf_dir) if stored else graph.edges(flows(spark, sf_dir)))

    return run


def node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        features.node_features(flows(spark, sf_dir)), "average_neighbor_degree", "clustering_coefficient"
    )


def node_features_by_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        features.node_features(flows(spark, sf_dir, True)), "average_neighbor_degree", "clustering_coefficient"
    )


def features_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(roles.zscore(stored_features(spark, sf_dir)), *FEATURES, digits=6)


def role_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.assign_roles(roles.zscore(stored_features(spark, sf_dir)), CENTROIDS)


def roles_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.cluster_roles(stored_features(spark, sf_dir), N_ROLES, seed=0)


def bot_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        roles.bot_profile(flows(spark, sf_dir), stored_features(spark, sf_dir)), *["mean_" + c for c in FEATURES]
    )


def _bot_role(spark: SparkSession, sf_dir: str, scale_profile: bool) -> DataFrame:
    table = stored_features(spark, sf_dir)
    profile = roles.bot_profile(flows(spark, sf_dir), table)
    result = roles.bot_role(profile, roles.feature_stats(table), CENTROIDS, scale_profile)
    return result.select("role", "n_bots", "in_min", "in_max", "out_min", "out_max")


def bot_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bot_role(spark, sf_dir, True)


def bot_role_unscaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bot_role(spark, sf_dir, False)


def missing_bots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bot hosts of the log that never receive a flow, found by matching against the receivers."""
    log = flows(spark, sf_dir)
    return roles.missing_bots(log, graph.in_degree(graph.edges(log)))


def missing_bots_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bot hosts of the log that send none of its largest flows."""
    log = flows(spark, sf_dir)
    return roles.missing_bots(log, graph.edges(log.where("tot_pkts = 50")).select(F.col("src").alias("id")).distinct())


def fixed_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow-degree ranges of the bot hosts, with role 1 as the bot role."""
    log = flows(spark, sf_dir)
    table = graph.flow_degrees(log).withColumns({c: F.lit(0) for c in FEATURES[2:]})
    return roles.bot_profile(log, table).withColumn("role", F.lit(1))


def bot_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = flows(spark, sf_dir)
    return roles.bot_candidates(params.role_degrees(log, fixed_roles(log)), fixed_profile(spark, sf_dir))


def role_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return params.role_sizes(fixed_roles(flows(spark, sf_dir)), N_ROLES)


def scenario_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return params.scenario_size(params.role_sizes(fixed_roles(flows(spark, sf_dir, True)), N_ROLES))


def role_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = flows(spark, sf_dir)
    return rounded(params.role_edges(log, fixed_roles(log), N_ROLES), "p_trans", "p_joint")


def role_edges_by_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = flows(spark, sf_dir, True)
    return rounded(params.role_edges(log, fixed_roles(log), N_ROLES), "p_trans", "p_joint")


def degree_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = flows(spark, sf_dir)
    return params.degree_bins(params.role_degrees(log, fixed_roles(log)))


def _hist2d(spark: SparkSession, sf_dir: str, scenarios: bool = False, dense: bool = False) -> DataFrame:
    log = flows(spark, sf_dir, scenarios)
    return params.degree_hist2d(params.role_degrees(log, fixed_roles(log)), dense=dense)


def degree_hist2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hist2d(spark, sf_dir)


def degree_hist2d_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hist2d(spark, sf_dir, dense=True)


def degree_hist2d_by_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hist2d(spark, sf_dir, scenarios=True)


def attr_hist_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cut(histograms.attribute_counts(flows(spark, sf_dir)))
    table = histograms.with_share(histograms.categorical_histograms(counts))
    return rounded(table, "p").drop("lo", "hi")


def attr_hist_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cut(histograms.attribute_counts(flows(spark, sf_dir)))
    return rounded(histograms.with_share(histograms.quantile_histograms(counts)), "p", "lo", "hi").drop("label")


def attr_hist_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(histograms.attr_histograms(flows(spark, sf_dir)), "p", "lo", "hi")


def attr_hist_by_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(histograms.attr_histograms(flows(spark, sf_dir, True)), "p", "lo", "hi")


def attr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.attribute_summary(histograms.attribute_counts(flows(spark, sf_dir)))


def stored_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(histograms.cumulative(histograms.attr_histograms(flows(spark, sf_dir))))


def hist_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = histograms.cumulative(histograms.attr_histograms(flows(spark, sf_dir)))
    return rounded(table.select("attribute", "bin", "n", "cum_lo", "cum_hi"), "cum_lo", "cum_hi")


def degree_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.sorted_distribution(graph.flow_degrees(flows(spark, sf_dir)), "degree")


def _half_properties(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    tables = []
    for half in half_flows(spark, sf_dir):
        edge_list = cut(graph.edges(half))
        tables.append(
            validate.property_tables(
                [
                    (graph.flow_degrees(half), ["indegree", "outdegree", "degree"]),
                    (graph.avg_neighbor_degree(edge_list), ["average_neighbor_degree"]),
                    (triangles.triangle_features(edge_list), ["triangles", "clustering_undirected"]),
                ]
            )
        )
    return tables


def hist_equal_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [
        validate.distribution(graph.flow_degrees(half), ["indegree", "outdegree", "degree"])
        for half in half_flows(spark, sf_dir)
    ]
    return validate.equal_width_histograms(*sides)


def hist_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validate.histogram_intersection(*_half_properties(spark, sf_dir)), "score")


def synthetic_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(synth.synth_nodes(degree_hist2d(spark, sf_dir)))


def stored_role_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = flows(spark, sf_dir)
    return cut(params.role_edges(log, fixed_roles(log), N_ROLES))


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One half of the log against the other."""
    return rounded(validate.validation_report(*half_flows(spark, sf_dir)), "score")


def validation_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scenarios of one half of the log against those of the other."""
    whole = flows(spark, sf_dir, True)
    report = validate.validation_report(whole.where("dir = '->'"), whole.where("dir = '<->'"))
    return rounded(report, "score")


def synth_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.synth_nodes(degree_hist2d(spark, sf_dir))


def synth_nodes_by_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.synth_nodes(degree_hist2d_by_scenario(spark, sf_dir), start=1000)


def stub_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.stub_supply(synthetic_hosts(spark, sf_dir))


def synth_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = synthetic_hosts(spark, sf_dir)
    shares = synth.destination_shares(stored_role_edges(spark, sf_dir), synth.stub_supply(hosts))
    return synth.out_stubs(hosts, shares)


def synth_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.synth_edges(synthetic_hosts(spark, sf_dir), stored_role_edges(spark, sf_dir))


def synth_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = synth.draw_attributes(synth_edges(spark, sf_dir), stored_histogram(spark, sf_dir))
    numbers = ["start_time", "dur", "sport", "dport", "s_tos", "d_tos", "tot_pkts", "tot_bytes"]
    return rounded(table, *numbers, digits=3)


def synth_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = synthetic_hosts(spark, sf_dir)
    bots = cut(roles.bot_candidates(hosts, fixed_profile(spark, sf_dir)))
    return synth.label_flows(synth.synth_edges(hosts, stored_role_edges(spark, sf_dir)), bots)


def sample_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.sample_flows(flows(spark, sf_dir))


def flows_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.flows_by_time(flows(spark, sf_dir))


def fresh(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4()}"


def flow_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scenario written as a log of its own in one folder, and all read back together."""
    folder = fresh(spark, "logs")
    flow_csv.write_log(flows(spark, sf_dir, True), folder)
    return flow_csv.read_flows(spark, folder)


def flow_csv_many_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios stored one after the other: a later one leaves the earlier ones as they are."""
    folder, out = fresh(spark, "logs"), fresh(spark, "flows")
    log = flows(spark, sf_dir, True)
    flow_csv.write_log(log.where("dir = '->'"), f"{folder}/a")
    flow_csv.write_log(log.where("dir <> '->'").withColumn("scenario", F.concat("scenario", F.lit("2"))), f"{folder}/b")
    flow_csv.ingest(spark, f"{folder}/a", out)
    return flow_csv.ingest(spark, f"{folder}/b", out).select("scenario", *log.drop("scenario").columns)


def flow_csv_mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs whose headers differ in order and case, read together."""
    folder = fresh(spark, "logs")
    log = flows(spark, sf_dir, True)
    names = [header for header, _, _ in FLOW_COLUMNS]
    flow_csv.write_log(log.where("dir = '->'"), f"{folder}/a")
    flow_csv.write_log(log.where("dir <> '->'"), f"{folder}/b", [n.upper() if i % 2 else n.lower() for i, n in enumerate(reversed(names))])
    return flow_csv.read_flows(spark, [f"{folder}/a", f"{folder}/b"])


def flow_log_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs with different headers, read by the data source in many ranges."""
    folder = fresh(spark, "logs")
    log = flows(spark, sf_dir, True)
    names = [header for header, _, _ in FLOW_COLUMNS]
    flow_csv.write_log(log.where("dir = '->'"), f"{folder}/a")
    flow_csv.write_log(log.where("dir <> '->'"), f"{folder}/b", [n.upper() if i % 2 else n.lower() for i, n in enumerate(reversed(names))])
    return flow_csv.scan_flows(spark, [f"{folder}/a", f"{folder}/b"])


def flow_csv_concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part files put together with their headers, beside an empty file."""
    folder, joined = fresh(spark, "parts"), fresh(spark, "joined")
    log = flows(spark, sf_dir)
    # four parts at least; a task may read several, so each has a quarter of the rows a task should read
    flow_csv.write_log(log.repartition(max(4, -(-4 * log.count() // PARTITION_ROWS))), folder)
    parts = spark.read.text(folder).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))
    # about two parts to a file, however many there are
    n = max(2, len(spark.read.text(folder).inputFiles()) // 2)
    parts.repartition(n, "file").sortWithinPartitions("file", "line").select("value").write.text(f"{joined}/all")
    parts.select("value").limit(0).write.text(f"{joined}/none")
    return flow_csv.read_flows(spark, [f"{joined}/all", f"{joined}/none"]).drop("scenario")


def bracketed_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host pairs of a CSV that puts brackets around hosts and calls its columns otherwise."""
    folder = fresh(spark, "pairs")
    boxed = [F.concat(F.lit("["), c, F.lit("]")).alias(n) for c, n in (("src_addr", "Source"), ("dst_addr", "Destination"))]
    flow_csv.write_csv(flows(spark, sf_dir).select("tot_pkts", *boxed), folder)
    return flow_csv.read_pairs(spark, folder).select("src_addr", "dst_addr")


def _stored_and_read(table: DataFrame, name: str, parts: list[str] | None = None) -> DataFrame:
    folder = fresh(table.sparkSession, name)
    flow_csv.write_table(table, folder, parts)
    return flow_csv.read_table(table.sparkSession, folder).select(table.columns)


def role_table_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_and_read(fixed_roles(flows(spark, sf_dir)), "roles")


def role_sizes_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_and_read(role_sizes(spark, sf_dir), "sizes")


def role_edges_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_and_read(role_edges_by_scenario(spark, sf_dir), "role-edges")


def degree_hist_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense histogram written, and read without its empty cells."""
    folder = fresh(spark, "histogram")
    flow_csv.write_table(_hist2d(spark, sf_dir, dense=True), folder)
    return flow_csv.read_histogram(spark, folder)


def attr_hist_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder per attribute; an attribute without values has none."""
    return _stored_and_read(attr_hist_all(spark, sf_dir), "attributes", ["attribute"])


def bot_profile_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh(spark, "profile")
    flow_csv.write_profile(fixed_profile(spark, sf_dir), folder)
    names = ["role", "n_bots", "in_min", "in_max", "out_min", "out_max"]
    read = spark.read.option("header", True).csv(folder)
    return read.select(*[F.col(c).cast("int" if c == "role" else "long").alias(c) for c in names])


def features_csv_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table as CSV with a header, read back by name."""
    table, folder = node_features(spark, sf_dir), fresh(spark, "features")
    flow_csv.write_csv(table, folder)
    kinds = dict(table.dtypes)
    read = spark.read.option("header", True).csv(folder)
    return read.select(*[F.col(c).cast(kinds[c]).alias(c) for c in table.columns])


def _ranked_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a written folder with their place in the concatenation of its files."""
    lines = spark.read.text(folder).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))
    return running_total(cut(lines), F.lit(1), ["file", "line"], name="rank")


def flows_csv_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and day of every flow of the written CSV; lines of a header are left out first."""
    folder = fresh(spark, "ordered")
    log = flows(spark, sf_dir).select(F.date_format("start_time", "yyyy-MM-dd").alias("StartTime"), "src_addr", "dst_addr", "tot_bytes")
    flow_csv.write_flows_csv(log, folder)
    lines = spark.read.text(folder).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))
    rows = running_total(cut(lines.where("value not like 'StartTime%'")), F.lit(1), ["file", "line"], name="rank")
    return rows.select("rank", F.substring_index("value", ",", 1).alias("day"))


def distribution_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and value of every line of a written distribution."""
    folder = fresh(spark, "distribution")
    flow_csv.write_distribution(graph.flow_degrees(flows(spark, sf_dir)), folder, "degree")
    return _ranked_lines(spark, folder).select("rank", F.col("value").cast("long").alias("value"))


def flow_degrees_null_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.flow_degrees(dirty_flows(spark, sf_dir))


def attr_hist_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(histograms.attr_histograms(dirty_flows(spark, sf_dir)), "p", "lo", "hi")


def role_edges_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six roles where four are expected."""
    log = dirty_flows(spark, sf_dir)
    hosts = graph.flow_degrees(log).select(F.col("id").alias("node"), (F.col("id").cast("long") % 6).cast("int").alias("role"))
    return rounded(params.role_edges(log, cut(hosts), N_ROLES), "p_trans", "p_joint")


def port_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty_flows(spark, sf_dir).groupBy("sport").agg(F.count("*").alias("n")).withColumn("port", port_number(F.col("sport")))


def roles_kmeans_by_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.cluster_roles(cut(features.node_features(flows(spark, sf_dir, True))), N_ROLES, seed=0)


def bot_role_by_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role of each log's mean bot among that log's own centres."""
    log = flows(spark, sf_dir, True)
    table = cut(features.node_features(log))
    centres = cut(roles.fit_centroids(cut(roles.zscore(table)), N_ROLES))
    profile = roles.bot_role(roles.bot_profile(log, table), roles.feature_stats(table), centres)
    return profile.select("scenario", "role", "n_bots")


def validation_seven(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validate.full_report(*half_flows(spark, sf_dir)), "score")


def flow_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows in each interval of the log's own histograms."""
    log = flows(spark, sf_dir)
    counts = cut(histograms.attribute_counts(log))
    return placing.value_bins(counts, cut(histograms.quantile_histograms(counts)))


def role_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = flows(spark, sf_dir)
    return placing.role_offsets(params.role_degrees(log, fixed_roles(log)))


def role_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty hosts of every role."""
    log = flows(spark, sf_dir)
    return placing.role_sample(cut(params.role_degrees(log, fixed_roles(log))), 20)


def harmonic_hll_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each host's sketched value lies within five standard errors of the exact one."""
    edge_list = stored_edges(spark, sf_dir)
    exact = distance.harmonic_exact(edge_list).withColumnRenamed("harmonic", "exact")
    near = F.abs(F.col("harmonic") - F.col("exact")) <= 5 * F.col("exact") / 256 + 1e-3
    return distance.harmonic_sketch(edge_list).join(exact, "id").select("id", near.alias("near"))


def triangle_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the estimate from three tenths of the edges lies within five deviations of the exact number."""
    edge_list = stored_edges(spark, sf_dir, True)
    told = estimates.triangle_estimate(edge_list)
    exact = triangles.triangles(edge_list).groupBy("scenario").agg((F.sum("triangles") / 3).alias("exact"))
    near = F.abs(F.col("triangles") - F.col("exact")) <= 5 * F.sqrt("variance")
    return told.join(exact, "scenario").select("scenario", F.col("exact").cast("long").alias("exact"), near.alias("near"))


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """States of all scenarios, stored one scenario after the other."""
    folder, log = fresh(spark, "states"), flows(spark, sf_dir, True)
    for scenario in ("A", "N", "R"):
        sketches.add_states(log.where(F.col("scenario") == scenario), folder)
    return sketches.read_states(spark, folder)


def attr_hist_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every interval of the histograms from merged sketches holds the share of values that it says."""
    found = cut(sketches.sketch_histograms(sketches.merged_attributes(_states(spark, sf_dir)[0])))
    counts = histograms.attribute_counts(flows(spark, sf_dir)).where("value is not null")
    edges = found.groupBy("attribute").agg(F.sort_array(F.collect_list("lo")).alias("lows"))  # at most 100 each
    bin_ = F.greatest(F.size(F.filter("lows", lambda e: e < F.col("value"))), F.lit(1))
    exact = counts.join(F.broadcast(edges), "attribute").groupBy("attribute", bin_.alias("bin")).agg(F.sum("n").alias("there"))
    bound = 2 * (sketches.RANK_ERROR + 1 / sketches.GRID)
    exact = counts.groupBy("attribute").agg(F.sum("n").alias("rows")).join(exact, "attribute")
    joined = found.join(exact, ["attribute", "bin"], "full")
    near = F.coalesce(F.abs(F.col("p") - F.col("there") / F.col("rows")) <= bound, F.col("p") <= bound, F.lit(False))
    return joined.groupBy("attribute").agg(F.max("total").alias("n"), F.min(near).alias("within"))


def distinct_hosts_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sketched numbers of hosts of each scenario, and of those that stayed or are new, are near the exact ones."""
    told = sketches.host_changes(_states(spark, sf_dir)[1])
    hosts = cut(graph.nodes(graph.flow_edges(flows(spark, sf_dir, True))))
    order = Window.orderBy("scenario")  # a row for each scenario
    follows = hosts.select("scenario").distinct().select("scenario", F.lag("scenario").over(order).alias("before"))
    earlier = hosts.select(F.col("scenario").alias("before"), "id", F.lit(1).alias("was"))
    now = hosts.join(F.broadcast(follows), "scenario").join(earlier, ["before", "id"], "left")
    exact = now.groupBy("scenario").agg(F.count("*").alias("hosts"), F.count("was").alias("stayed"))
    near = lambda a, b: (F.abs(F.col(a) - b) <= sketches.COUNT_ERROR * F.col("n_together")).alias(a)
    return told.join(exact, "scenario").select("scenario", near("n_hosts", F.col("hosts")), near("n_stayed", F.col("stayed")), near("n_new", F.col("hosts") - F.col("stayed")))


def queries() -> dict[str, Query]:
    return {
        "edges_distinct": on_edges(lambda e: e),
        "nodes": on_edges(graph.nodes),
        "graph_size": on_edges(graph.graph_size),
        "in_degree": on_edges(graph.in_degree),
        "out_degree": on_edges(graph.out_degree),
        "total_degree": on_edges(graph.total_degree),
        "avg_neighbor_degree": on_edges(
            lambda e: rounded(graph.avg_neighbor_degree(e), "average_neighbor_degree"), stored=True
        ),
        "avg_successor_degree": on_edges(
            lambda e: rounded(graph.avg_successor_degree(e), "avg_successor_degree"), stored=True
        ),
        "avg_successor_degree_parallel": lambda s, d: rounded(
            graph.avg_successor_degree(graph.flow_edges(flows(s, d)), parallel=True), "avg_successor_degree"
        ),
        "triangles": on_edges(triangles.triangles, stored=True),
        "clustering_directed": on_edges(
            lambda e: rounded(triangles.clustering_coefficient(e), "clustering_coefficient"), stored=True
        ),
        "clustering_undirected": on_edges(
            lambda e: rounded(triangles.clustering_coefficient(e, "undirected"), "clustering_coefficient"), stored=True
        ),
        "k_core": on_edges(peeling.k_core, stored=True),
        "core_sizes": on_edges(lambda e: peeling.core_sizes(peeling.k_core(e)), stored=True),
        "core_number": on_edges(peeling.core_number, stored=True),
        "pagerank_static": on_edges(lambda e: rounded(pagerank.pagerank_static(e), "pagerank"), stored=True),
        "pagerank_converged": on_edges(lambda e: rounded(pagerank.pagerank_converged(e), "pagerank"), stored=True),
        "harmonic_bounded": on_edges(lambda e: rounded(distance.harmonic_exact(e), "harmonic", digits=4), stored=True),
        "harmonic_in": on_edges(
            lambda e: rounded(distance.harmonic_exact(e, None, "in"), "harmonic"), stored=True
        ),
        "harmonic_hll": on_edges(distance.harmonic_sketch, stored=True),
        "betweenness": on_edges(lambda e: rounded(distance.betweenness(e), "betweenness"), stored=True),
        "betweenness_pivots": on_edges(
            lambda e: rounded(distance.betweenness(e, n_pivots=64), "betweenness"), stored=True
        ),
        "basic_features": on_edges(
            lambda e: rounded(features.basic_features(e), "average_neighbor_degree"), stored=True
        ),
        "node_features": node_features,
        "node_features_by_scenario": node_features_by_scenario,
        "flow_degrees": lambda s, d: graph.flow_degrees(flows(s, d)),
        "bot_hosts": lambda s, d: roles.bot_hosts(flows(s, d)),
        "missing_bots": missing_bots,
        "missing_bots_large": missing_bots_large,
        "bot_profile": bot_profile,
        "bot_role": bot_role,
        "bot_role_unscaled": bot_role_unscaled,
        "bot_candidates": bot_candidates,
        "features_scaled": features_scaled,
        "role_assign": role_assign,
        "roles_kmeans": roles_kmeans,
        "role_sizes": role_sizes,
        "scenario_size": scenario_size,
        "role_edges": role_edges,
        "role_edges_by_scenario": role_edges_by_scenario,
        "degree_bins": degree_bins,
        "degree_hist2d": degree_hist2d,
        "degree_hist2d_dense": degree_hist2d_dense,
        "degree_hist2d_by_scenario": degree_hist2d_by_scenario,
        "attr_summary": attr_summary,
        "attr_hist_categorical": attr_hist_categorical,
        "attr_hist_quantile": attr_hist_quantile,
        "attr_hist_all": attr_hist_all,
        "attr_hist_by_scenario": attr_hist_by_scenario,
        "hist_cumulative": hist_cumulative,
        "degree_distribution": degree_distribution,
        "hist_equal_width": hist_equal_width,
        "hist_intersection": hist_intersection,
        "validation_report": validation_report,
        "validation_halves": validation_halves,
        "synth_nodes": synth_nodes,
        "synth_nodes_by_scenario": synth_nodes_by_scenario,
        "stub_supply": stub_supply,
        "synth_roles": synth_roles,
        "synth_edges": synth_edges,
        "synth_attrs": synth_attrs,
        "synth_labels": synth_labels,
        "sample_flows": sample_flows,
        "flows_by_time": flows_by_time,
        "flow_csv_roundtrip": flow_csv_roundtrip,
        **{
            q.__name__: q
            for q in (
                flow_csv_many_scenarios,
                flow_csv_mixed_headers,
                flow_csv_concatenated,
                flow_log_source,
                bracketed_hosts,
                role_table_stored,
                role_sizes_stored,
                role_edges_stored,
                degree_hist_stored,
                attr_hist_stored,
                bot_profile_stored,
                features_csv_stored,
                flows_csv_ordered,
                distribution_stored,
                flow_degrees_null_ends,
                attr_hist_dirty,
                role_edges_dirty,
                port_numbers,
                roles_kmeans_by_scenario,
                bot_role_by_scenario,
                validation_seven,
                flow_bins,
                role_offsets,
                role_sample,
                harmonic_hll_bound,
                triangle_estimate,
                attr_hist_sketch,
                distinct_hosts_overlap,
            )
        },
    }
