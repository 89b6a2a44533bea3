"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

A source's weight is its share of all words. No source is repeated more than ``epochs`` times: sources whose share is
more are clamped there, and what they leave is shared out among the others by weight, until none is above. A source that
is repeated 2.3 times takes all its documents twice, and once more those first in a seeded order whose words add up to
0.3 of it. The order is that of a hash of id and text, so reruns agree, and the third time is one cut-off per source. Rows
that are equal in both share a place in the order; those at the cut-off are numbered, and as many as fit are taken.

The running sums behind the cut-offs go over hash buckets of each source in two passes, so no task holds a source.

Defined cases: a null or empty text has size 0 and is taken as often as its source is whole; a null source is one of its
own and comes last; null ids count as one, and equal ids are told apart by their texts; of rows equal in id and text any
are taken, but as many in every run; without any words all targets are 0. Only id, source and text are read, apart from
``repeated``, which keeps all columns, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostweave.llm import kernel
from hostweave.llm.storage import small_batches, stored
from hostweave.operators.scale import running_total

WEIGHTS = (1, 2, 3)
EPOCHS = 3
SEED = 11


def source_key(source: str = "source") -> Column:
    """The source as a text without nulls, null last."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))


def order_key(key: str, seed: int) -> Column:
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}:"), text).cast("binary"))


def sizes(documents: DataFrame, key: str = "doc_id", source: str = "source", seed: int = SEED) -> DataFrame:
    """(doc_id, from, turn, size): words of every row, its source and its place in the order."""

    @kernel.task
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in kernel.pieces(kernel.as_text(batch.column("text"))):
                n = np.diff(kernel.words(data, offsets).first)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("from"), part.column("turn"), pa.array(n)], ["doc_id", "from", "turn", "size"])

    kind = documents.schema[key].dataType.simpleString()
    rows = small_batches(documents).select(F.col(key).alias("doc_id"), source_key(source).alias("from"), order_key(key, seed).alias("turn"), "text")
    return rows.mapInArrow(counted, f"doc_id {kind}, `from` string, turn string, size long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Add weight and target to (from, source_size, place); the fill level is found by a few sums."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int")).cast("long")
    sources = stored(sources.withColumn("weight", weight).withColumn("cap", epochs * F.col("source_size")), "sources")
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while words:
        above = F.col("weight") * F.lit(level) >= F.col("cap") if clamped >= 0 else F.lit(False)
        row = sources.agg(
            F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)), F.count_if(above)
        ).first()
        if row[2] == clamped or not row[1]:
            break
        level, clamped = (words - row[0]) / row[1], row[2]
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("cap").cast("double")))


def plan(described: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(from, source_size, target, whole, rest, last, edge) of every source.

    Documents are taken ``whole`` times, and once more up to the place ``last``; of the rows at the place ``edge``, which
    are equal, some are. ``rest`` is what is to be taken once more, in words.
    """
    totals = stored(described.groupBy("from").agg(F.sum("size").alias("source_size")), "totals")
    placed = running_total(totals, F.lit(1), ["from"], name="place")
    rate = F.col("target") / F.col("source_size")
    filled = targets(placed.select("from", "source_size", "place"), weights, epochs).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.least(F.floor(rate), F.lit(epochs))).otherwise(F.lit(0)).cast("long")
    )
    filled = stored(filled.withColumn("rest", F.when(F.col("whole") < epochs, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(F.lit(0.0))), "filled")
    partly = described.join(filled.where("rest > 0").select("from", "place", "rest"), "from")
    # rows with one place in the order are one step; they have the same text
    steps = stored(partly.groupBy("place", "rest", "turn").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "steps")
    bucket = F.conv(F.substring("turn", 1, 3), 16, 10).cast("int")
    ahead = running_total(steps, "size", ["turn"], ["place"], bucket).withColumn("each", F.col("size") / F.col("n"))
    begins = F.col("before") + F.col("each") / 2 <= F.col("rest")
    ends = F.col("before") + F.col("each") * (F.col("n") - 1) + F.col("each") / 2 <= F.col("rest")
    last = ahead.groupBy("place").agg(F.max(F.when(ends, F.col("turn"))).alias("last"), F.max(F.when(begins & ~ends, F.struct("turn", "before"))).alias("edge"))
    return stored(filled.join(last, "place", "left").select("from", "source_size", "target", "whole", "rest", "last", "edge"), "plan")


def with_copies(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Add the plan's columns and ``copies``, how often each row is taken, to rows with (from, turn, size).

    Equal rows at a cut-off are numbered in two passes: by the partition that they are read from, then within it.
    """
    joined = rows.join(planned, "from")
    more = F.when(F.col("turn") <= F.col("last"), F.lit(1)).otherwise(F.lit(0))
    if planned.where("edge IS NOT NULL").isEmpty():
        return joined.withColumn("copies", (F.col("whole") + more).cast("long"))
    at_edge = F.coalesce(F.col("turn") == F.col("edge.turn"), F.lit(False))
    edge = stored(joined.where(at_edge).withColumn("part", F.spark_partition_id()), "edge")
    numbered = running_total(edge, F.lit(1), ["turn"], ["from"], F.col("part"), "ahead")
    fits = F.col("edge.before") + F.col("ahead") * F.col("size") + F.col("size") / 2 <= F.col("rest")
    some = numbered.withColumn("copies", (F.col("whole") + fits.cast("int")).cast("long")).drop("part", "ahead")
    return joined.where(~at_edge).withColumn("copies", (F.col("whole") + more).cast("long")).unionByName(some)


def mix(documents: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    described = stored(sizes(documents, seed=seed), "sizes")
    taken = with_copies(described, plan(described, weights, epochs))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def repeated(documents: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: every row of documents, all columns, as many times as it is taken."""
    described = stored(sizes(documents, seed=seed), "sizes")
    planned = plan(described, weights, epochs)
    # the size counts only where equal rows are numbered, and follows from their place there
    edges = described.join(planned.where("edge IS NOT NULL").select("from", "edge"), "from").where("turn = edge.turn")
    sized = stored(edges.groupBy("from").agg(F.max("size").alias("size")), "edge_sizes")
    # a row's own columns are kept apart, so that they can have any name
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), source_key().alias("from"), order_key("doc_id", seed).alias("turn"))
    taken = with_copies(rows.join(sized, "from", "left"), planned)
    return taken.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")
