"""Helpers that keep jobs whole when keys are hot, tables grow or executors are lost."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

# Rows of one key that may share a task; a key with more is split.
HOT_ROWS = 1_000_000
# A table with at most this many rows may be broadcast.
BROADCAST_ROWS = 200_000
# Rows per partition aimed at for tables that are read once per round.
PARTITION_ROWS = 2_000_000
# Rows written out by one explode call.
BLOCK_ROWS = 100_000


def by(df: DataFrame) -> list[str]:
    """The scenario key, if the table has one."""
    return ["scenario"] if "scenario" in df.columns else []


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder; a temporary one only in local mode, where tasks run in this process.

    Checkpoints that nothing refers to any more are removed.
    """
    sc = spark.sparkContext
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.match(r"local(\[|$)", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="hostweave-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write the table to the checkpoint folder and go on from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def cut_and_see(df: DataFrame, **values: Column) -> tuple[DataFrame, dict]:
    """``cut``, and aggregates of the table that come out of the same job."""
    seen = Observation()
    stored = cut(df.observe(seen, *[value.alias(name) for name, value in values.items()]))
    return stored, seen.get


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def partitions_for(spark: SparkSession, rows: int) -> int:
    """Partition count for a table of this size, at least one per core."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // PARTITION_ROWS))


def hot_keys(counts: DataFrame, on: Sequence[str], n: str = "n", hot_rows: int | None = None) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and the number of parts to split each into.

    There are at most rows / hot_rows of them, which bounds their broadcast.
    """
    limit = hot_rows or HOT_ROWS
    return counts.where(F.col(n) > limit).select(*on, F.ceil(F.col(n) / limit).cast("int").alias("splits"))


def salted(big: DataFrame, on: Sequence[str], hot: DataFrame, salt_by: Sequence[str]) -> DataFrame:
    """Add ``salt``: rows of a hot key are dealt out by a hash of ``salt_by``, so a retry deals the same."""
    salt = F.pmod(F.xxhash64(*salt_by), F.col("splits")).cast("int")
    return (
        big.join(F.broadcast(hot), list(on), "left")
        .withColumn("salt", F.coalesce(salt, F.lit(0)))
        .drop("splits")
    )


def spread(small: DataFrame, on: Sequence[str], hot: DataFrame) -> DataFrame:
    """Repeat the rows of a hot key once per salt."""
    return (
        small.join(F.broadcast(hot), list(on), "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("splits", F.lit(1)) - 1)))
        .drop("splits")
    )


def skew_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    hot: DataFrame,
    salt_by: Sequence[str],
    how: str = "inner",
) -> DataFrame:
    """Equi-join in which the rows of a hot key are shared out over several tasks."""
    left, right = salted(big, on, hot, salt_by), spread(small, on, hot)
    return left.join(right, [*on, "salt"], how).drop("salt")


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join to a table with a few rows per scenario (roles, attributes, properties).

    Without scenarios the caller's parameters bound it and it is broadcast.
    With scenarios its size is checked; a large one is repeated over salts
    instead, because its few keys would each hold a large share of ``big``.
    """
    if "scenario" in on:
        small = cut(small)
        if not is_small(small):
            splits = partitions_for(big.sparkSession, 0)
            salt = F.pmod(F.xxhash64(*big.columns), F.lit(splits)).cast("int")
            repeated = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
            return big.withColumn("salt", salt).join(repeated, [*on, "salt"], how).drop("salt")
    return big.join(F.broadcast(small), list(on), how)


def with_row(df: DataFrame, one: DataFrame, prefix: str = "") -> DataFrame:
    """Add the columns of a one-row-per-scenario table to every row."""
    keys = by(one)
    values = [c for c in one.columns if c not in keys]
    if keys:
        return join_small(df, one.select(*keys, *[F.col(c).alias(prefix + c) for c in values]), keys)
    row = one.select(F.struct(*values).alias("r")).scalar()
    return df.withColumns({prefix + c: row.getField(c) for c in values})


def expand(df: DataFrame, n: str, index: str) -> DataFrame:
    """One row per 0..n-1 for every input row, numbered in ``index``.

    A row may stand for billions of rows, so it is first divided into blocks,
    the blocks are spread over as many partitions as their rows need, and each
    block is expanded there. ``df`` is read twice, so pass a stored table.
    """
    keys = [c for c in df.columns if c != n]
    rows = df.agg(F.sum(n)).first()[0] or 0
    size = F.lit(BLOCK_ROWS)
    last = F.floor((F.col(n) - 1) / size)
    blocks = (
        df.where(F.col(n) > 0)
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .repartition(partitions_for(df.sparkSession, rows), *keys, "block")
    )
    first = F.col("block") * size
    stop = F.least(first + size, F.col(n).cast("long")) - 1
    return blocks.withColumn(index, F.explode(F.sequence(first, stop))).drop("block", n)


def running_total(
    df: DataFrame,
    n: str | Column,
    order: Sequence[str],
    group: Sequence[str] = (),
    bucket: Column | None = None,
    name: str = "before",
) -> DataFrame:
    """Sum of ``n`` over the earlier rows of the group, without one task per group.

    The group is cut into ordered buckets, bucket sums are added up in a small
    table, and only rows of one bucket are added up together. ``bucket`` must
    grow with ``order``; without it the table is range partitioned and written
    out, so that both passes see the same buckets.
    """
    group = list(group)
    df = df.withColumn("_n", n if isinstance(n, Column) else F.col(n))
    if bucket is None:
        # as many buckets as the rows need, whatever the session's number of partitions
        df, seen = cut_and_see(df, n=F.count("*"))
        parts = partitions_for(df.sparkSession, seen["n"])
        df = cut(df.repartitionByRange(parts, *group, *order).withColumn("_bucket", F.spark_partition_id()))
        if seen["n"] > PARTITION_ROWS:
            # few buckets share a task, and their number does not grow with the rows
            df = df.repartition(4 * parts, *group, "_bucket")
    else:
        df = df.withColumn("_bucket", bucket)
    cells = [*group, "_bucket"]
    earlier = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    offsets = (
        df.groupBy(*cells)
        .agg(F.sum("_n").alias("_sum"))
        .withColumn(
            "_offset",
            F.coalesce(
                F.sum("_sum").over(earlier.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .drop("_sum")
    )
    local = Window.partitionBy(*cells).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_local", F.coalesce(F.sum("_n").over(local), F.lit(0)))
        .join(offsets, cells)
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_n", "_bucket", "_local", "_offset")
    )


class Wires:
    """Directed links over which values travel from ``nbr`` to ``id``, round after round.

    The links are partitioned and sorted by sender once and kept, so that a
    round moves only the senders' values. Links of a hot sender are dealt out
    over several partitions, and its value is repeated for each of them. Lost
    partitions are rebuilt from ``links``, which must come from a stored table.
    ``counts`` has the links (n) per sender (nbr), if they are known already.
    """

    def __init__(self, links: DataFrame, hot_rows: int | None = None, counts: DataFrame | None = None):
        spark = links.sparkSession
        self.by = by(links)
        self.key = [*self.by, "nbr"]
        if counts is None:
            counts = links.groupBy(*self.key).agg(F.count("*").alias("n"))
        rows, top = counts.agg(F.sum("n"), F.max("n")).first()
        self.hot = None
        self.on = self.key
        if (top or 0) > (hot_rows or HOT_ROWS):
            self.hot = cut(hot_keys(counts, self.key, hot_rows=hot_rows))
            self.on = [*self.key, "salt"]
            links = salted(links, self.key, self.hot, ["id"])
        parts = partitions_for(spark, rows or 0)
        self.links = links.repartition(parts, *self.on).sortWithinPartitions(*self.on).persist()
        # a filled cache tells the planner its partitioning, so that rounds do not shuffle the links again
        self.links.count()

    def carry(self, state: DataFrame, *values: str, of_link: Sequence[str] = ()) -> DataFrame:
        """One row (id, values of the sender, columns ``of_link`` of the link) per link whose sender is in ``state``."""
        sent = state.select(*self.by, F.col("id").alias("nbr"), *values)
        if self.hot is not None:
            sent = spread(sent, self.key, self.hot)
        return self.links.join(sent, self.on).select(*self.by, "id", *values, *of_link)

    def close(self) -> None:
        self.links.unpersist()

    def __enter__(self) -> Wires:
        return self

    def __exit__(self, *_) -> None:
        self.close()
