"""Histograms of flow attributes: categories, or equal-frequency intervals for many values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostweave.functions.columns import epoch_seconds, port_number
from hostweave.operators.scale import by, cut, is_small, join_small, running_total
from hostweave.sources.schema import ATTRIBUTES

# Parts into which the ranks of an attribute are divided when values are looked up.
RANK_PARTS = 4096


def attribute_counts(flows: DataFrame) -> DataFrame:
    """(attribute, label, value, n) for every attribute in one pass; nulls are counted under a null label.

    Values are counted as they are, and only the distinct ones are turned into
    labels and numbers.
    """
    keys = by(flows)
    types = dict(flows.dtypes)

    def raw(name: str, kind: str):
        text = F.col(name) if kind in ("text", "port") else F.lit(None).cast("string")
        number = F.unix_micros(name) if kind == "time" else F.col(name)
        number = F.lit(None).cast("double") if kind in ("text", "port") else number.cast("double")
        return F.struct(F.lit(name).alias("attribute"), text.alias("text"), number.alias("number"))

    counted = (
        flows.select(*keys, F.explode(F.array(*[raw(name, kind) for name, kind in ATTRIBUTES])).alias("a"))
        .select(*keys, "a.*")
        .groupBy(*keys, "attribute", "text", "number")
        .agg(F.count("*").alias("n"))
    )
    times = F.col("attribute").isin([name for name, kind in ATTRIBUTES if kind == "time"])
    ports = F.col("attribute").isin([name for name, kind in ATTRIBUTES if kind == "port"])
    whole = F.col("attribute").isin([name for name, _ in ATTRIBUTES if types[name] in ("int", "bigint")])
    moment = F.timestamp_micros(F.col("number").cast("long"))
    label = (
        F.when(times, moment.cast("string"))
        .when(whole, F.col("number").cast("long").cast("string"))
        .otherwise(F.coalesce("text", F.col("number").cast("string")))
    )
    value = F.when(times, epoch_seconds(moment)).when(ports, port_number(F.col("text"))).otherwise(F.col("number"))
    return counted.select(*keys, "attribute", label.alias("label"), value.alias("value"), "n")


def attribute_summary(counts: DataFrame) -> DataFrame:
    """Rows, non-null rows and distinct values before conversion, per attribute."""
    return counts.groupBy(*by(counts), "attribute").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("label").isNotNull(), F.col("n"))), F.lit(0)).alias("n_present"),
        F.count("label").alias("n_distinct"),
    )


def _is_text() -> Column:
    return F.col("attribute").isin([name for name, kind in ATTRIBUTES if kind == "text"])


def categorical_histograms(counts: DataFrame, max_values: int = 100) -> DataFrame:
    """Attributes of text, and others with few values: each value with its share of all rows, most frequent first.

    Nulls are counted among the rows. Text may have any number of values, so bins are numbered by running totals.
    """
    keys = [*by(counts), "attribute"]
    few = attribute_summary(counts).where(_is_text() | (F.col("n_distinct") <= max_values)).select(*keys, "n_rows")
    values = join_small(counts.where("label is not null"), few, keys).withColumn("rare", -F.col("n"))
    return running_total(values, F.lit(1), ["rare", "label"], keys, name="place").select(
        *keys,
        (F.col("place") + 1).cast("int").alias("bin"),
        "label",
        F.lit(None).cast("double").alias("lo"),
        F.lit(None).cast("double").alias("hi"),
        "n",
        F.col("n_rows").alias("total"),
    )


def quantile_histograms(counts: DataFrame, max_values: int = 100, max_bins: int = 100) -> DataFrame:
    """Numeric attributes with many values: the most equal-frequency intervals, up to ``max_bins``, with distinct edges.

    Values are counted first, ranks are running totals of these counts, and an
    edge is interpolated between the values at two neighbouring ranks. The
    count of an interval follows from the ranks too, so values are read once.
    """
    keys = [*by(counts), "attribute"]
    many = attribute_summary(counts).where(~_is_text() & (F.col("n_distinct") > max_values)).select(*keys)
    values = (
        join_small(counts.where("value is not null"), many, keys)
        .groupBy(*keys, "value")
        .agg(F.sum("n").alias("n"))
    )
    ranked = cut(running_total(values, "n", ["value"], keys)).withColumn("upto", F.col("before") + F.col("n"))
    totals = ranked.groupBy(*keys).agg(F.sum("n").alias("total"))

    # fractions k/q of the sorted rows, as exact integer positions: (max_bins + 1)(max_bins + 2) / 2 per attribute
    points = (
        totals.withColumn("q", F.explode(F.sequence(F.lit(1), F.lit(max_bins))))
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("q"))))
        .withColumn("at", (F.col("total") - 1) * F.col("k"))
        .withColumn("rank", F.expr("at div q"))
        .withColumn("part", (F.col("at") % F.col("q")) / F.col("q"))
    )
    width = F.greatest(F.lit(1), F.ceil(F.col("total") / RANK_PARTS))
    needed = (
        points.select(*keys, "total", F.explode(F.array("rank", F.least(F.col("rank") + 1, F.col("total") - 1))).alias("r"))
        .distinct()
        .withColumn("cell", F.floor(F.col("r") / width))
        .drop("total")
    )
    cells = join_small(ranked, totals, keys).select(
        *keys,
        "value",
        "before",
        "upto",
        F.explode(F.sequence(F.floor(F.col("before") / width), F.floor((F.col("upto") - 1) / width))).alias("cell"),
    )
    needed = cut(needed)
    found = cut(
        cells.join(F.broadcast(needed) if is_small(needed) else needed, [*keys, "cell"])
        .where("r >= before and r < upto")
        .select(*keys, "r", "value", "upto")
    )
    low = found.select(*keys, F.col("r").alias("rank"), F.col("value").alias("v0"), F.col("upto").alias("c0"))
    high = found.select(*keys, (F.col("r") - 1).alias("rank"), F.col("value").alias("v1"), F.col("upto").alias("c1"))
    edge = F.when(F.col("part") > 0, F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("part")).otherwise(F.col("v0"))
    edges = (
        points.join(low, [*keys, "rank"])
        .join(high, [*keys, "rank"], "left")
        .withColumn("edge", edge)
        .withColumn("below", F.when(F.col("edge") >= F.col("v1"), F.col("c1")).otherwise(F.col("c0")))
        .select(*keys, "q", "k", "edge", "below", "total")
    )
    # at most max_bins + 1 rows per window group
    step = Window.partitionBy(*keys, "q").orderBy("k")
    whole = Window.partitionBy(*keys, "q")
    bins = (
        edges.withColumn("lo", F.lag("edge").over(step))
        .withColumn("n", F.col("below") - F.coalesce(F.when(F.col("k") > 1, F.lag("below").over(step)), F.lit(0)))
        .withColumn("same", F.max(F.when(F.col("lo") == F.col("edge"), 1).otherwise(0)).over(whole))
        .where("same = 0 or q = 1")
    )
    best = bins.groupBy(*keys).agg(F.max("q").alias("q"))
    return (
        bins.where("k >= 1")
        .join(best, [*keys, "q"], "left_semi")
        .select(
            *keys,
            F.col("k").alias("bin"),
            F.lit(None).cast("string").alias("label"),
            "lo",
            F.col("edge").alias("hi"),
            "n",
            "total",
        )
    )


def attr_histograms(flows: DataFrame, max_values: int = 100, max_bins: int = 100) -> DataFrame:
    """Histogram of every attribute: text by value, numbers by value or interval as their number of values calls for."""
    counts = cut(attribute_counts(flows))
    return with_share(
        categorical_histograms(counts, max_values).unionByName(quantile_histograms(counts, max_values, max_bins))
    )


def with_share(histogram: DataFrame) -> DataFrame:
    return histogram.withColumn("p", F.col("n") / F.col("total"))


def cumulative(histogram: DataFrame) -> DataFrame:
    """Share below a bin and up to it."""
    keys = [*by(histogram), "attribute"]
    summed = running_total(histogram, "n", ["bin"], keys, bucket=F.floor(F.col("bin") / 10_000))
    return (
        summed.withColumn("cum_lo", F.col("before") / F.col("total"))
        .withColumn("cum_hi", (F.col("before") + F.col("n")) / F.col("total"))
        .drop("before")
    )
