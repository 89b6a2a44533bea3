"""Pairs of texts whose sets of word 5-grams overlap, by MinHash bands and exact verification.

Every text gets a key (a hash of its whole n-gram set) and a MinHash signature in bands, the number of bands and rows
chosen for the recall wanted at the threshold. Texts with the same set form a class, and only classes go on. Classes
that share a band meet in a bucket; buckets with the same members are looked at once. A bucket is verified in blocks on
the full sets by counting common n-grams, and each pair is counted in the first bucket that it shares. Pairs are not
written out: a class gets the number of its links, and links are passed on as local stars, from which groups (connected
components) are made.

Defined cases: a null or empty text has no n-grams, is linked with nothing and is a class and group of its own; a text of
one to four words has one n-gram of all its words; repeated rows are in one class and are links of each other; a null id
is kept (the smallest id of a class or group is null only if all its ids are). Only doc_id and text are read, apart
from ``one_of_each``, which keeps all columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostweave.llm import kernel
from hostweave.llm.components import components
from hostweave.llm.storage import small_batches, stored
from hostweave.operators.scale import HOT_ROWS, hot_keys, partitions_for, skew_join

N, THRESHOLD = 5, 0.8
# Chance that a pair right at the threshold shares no band, and most hash functions.
MISS, MOST_HASHES = 1e-4, 128
# Classes and n-grams in a block of a bucket.
BLOCK_CLASSES, BLOCK_GRAMS = 300, 1_000_000
# Columns of the count matrix at once.
COLUMNS = 4_096


def band_shape(threshold: float = THRESHOLD, miss: float = MISS, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows per band): the most rows, so the fewest false candidates, that keep ``miss`` within ``most`` hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        p = threshold**rows
        if p >= 1:
            bands = 1
        elif p < 1e-9:
            break
        else:
            bands = math.ceil(math.log(miss) / math.log1p(-p))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _factors(n: int) -> np.ndarray:
    return kernel.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of all texts, ascending within each text, and where each text's start."""
    h, doc = kernel.shingle_hashes(data, offsets, n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[fresh], doc[fresh]
    return h, np.searchsorted(doc, np.arange(len(offsets)), "left")


def set_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128-bit key of each set as two columns; sets are given as in ``gram_sets``, none empty."""
    sums = [np.add.reduceat(kernel.mix(h ^ np.uint64(salt)), first) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return np.stack(sums, 1)


def signatures(h: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (sets x bands) of non-empty sets."""
    out = np.zeros((len(first), bands), np.uint64)
    factors = _factors(bands * rows)
    mixers = _factors(rows + 1)
    for band in range(bands):
        total = np.full(len(first), np.uint64(band + 1)) * mixers[rows]
        for row in range(rows):
            # the high bits of the product order the n-grams, and differ for each factor
            least = np.minimum.reduceat(h * factors[band * rows + row], first)
            total = kernel.mix(total + least * mixers[row])
        out[:, band] = total
    return out


def describe(documents: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, tag, key, size, bands) of every row; tag is a hash of the text, key null without words."""

    @kernel.task
    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in kernel.pieces(kernel.as_text(batch.column("text"))):
                h, first = gram_sets(data, offsets, n)
                size = np.diff(first)
                some = np.flatnonzero(size)
                keys: list[bytes | None] = [None] * (b - a)
                signs: list[list[int]] = [[]] * (b - a)
                if len(some):
                    raw = set_keys(h, first[some]).astype(">u8").tobytes()
                    found = signatures(h, first[some], bands, rows).view(np.int64).tolist()
                    for j, i in enumerate(some.tolist()):
                        keys[i], signs[i] = raw[16 * j : 16 * j + 16], found[j]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        batch.column("tag").slice(a, b - a),
                        pa.array(keys, pa.binary()),
                        pa.array(size),
                        pa.array(signs, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "tag", "key", "size", "bands"],
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows_ = small_batches(documents).select("doc_id", F.xxhash64("text").alias("tag"), "text")
    return rows_.mapInArrow(described, f"doc_id {kind}, tag long, key binary, size long, bands array<long>")


def _id(column: str = "doc_id"):
    """The id for joins: a null meets a null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def full_sets(documents: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(key, grams) of the classes in ``wanted`` (key, doc_id, tag), from the text of one document each."""

    @kernel.task
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in kernel.pieces(kernel.as_text(batch.column("text"))):
                h, first = gram_sets(data, offsets, n)
                raw = [h[s:e].tobytes() for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(a, b - a), pa.array(raw, pa.binary())], ["key", "grams"])

    texts = documents.select(_id().alias("id"), F.xxhash64("text").alias("tag"), "text")
    # repeated rows are merged before they move, so each class has one set
    texts = texts.groupBy("id", "tag").agg(F.first("text").alias("text"))
    # the classes grow with the input, so they are never broadcast
    return texts.join(wanted.hint("merge"), ["id", "tag"]).select("key", "text").mapInArrow(made, "key binary, grams binary")


class Unit:
    """Classes of one block (or of two blocks, left against right) that are compared."""

    def __init__(self, keys: list[bytes], grams: list[bytes], side: np.ndarray, weight: np.ndarray, buckets: list[np.ndarray], bucket: int, across: bool):
        """``across``: only classes of different sides are compared."""
        order = sorted(range(len(keys)), key=keys.__getitem__)
        order = [i for k, i in enumerate(order) if k == 0 or keys[i] != keys[order[k - 1]]]  # repeated rows
        self.keys = [keys[i] for i in order]
        self.grams = [np.frombuffer(grams[i], np.uint64) for i in order]
        self.side, self.weight, self.buckets, self.bucket = side[order], weight[order], [buckets[i] for i in order], bucket
        self.across = across

    def links(self, threshold: float) -> list[dict]:
        """A row for each class with a new link: their number, and the smallest class it is connected with by them."""
        m = len(self.keys)
        if m < 2:
            return []
        # pairs that an earlier bucket has looked at are left to it
        fresh = shared_counts([b[b < self.bucket] for b in self.buckets]) == 0
        if self.across:
            fresh &= self.side[:, None] != self.side[None, :]
        np.fill_diagonal(fresh, False)
        if not fresh.any():
            return []
        size = np.fromiter(map(len, self.grams), np.int64, m)
        common = shared_counts(self.grams)
        fresh &= common / (size[:, None] + size[None, :] - common) >= threshold
        root = np.arange(m)
        while True:
            new = np.minimum(root, np.where(fresh, root[None, :], m).min(1))
            new = new[new]
            if (new == root).all():
                break
            root = new
        return [
            {"key": self.keys[i], "n_classes": int(fresh[i].sum()), "n_linked": int(self.weight[fresh[i]].sum()), "root": self.keys[int(root[i])]}
            for i in np.flatnonzero(fresh.any(1)).tolist()
        ]


def shared_counts(lists: list[np.ndarray]) -> np.ndarray:
    """Number of values that each two lists share; values are distinct within a list."""
    m = len(lists)
    size = np.fromiter(map(len, lists), np.int64, m)
    if m == 2:
        both = np.intersect1d(lists[0], lists[1], assume_unique=True).size
        return np.array([[size[0], both], [both, size[1]]])
    out = np.zeros((m, m), np.int64)
    owner = np.repeat(np.arange(m), size)
    _, column, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    number = np.cumsum(count > 1) - 1
    owner, column = owner[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((m, min(COLUMNS, int(column[hi - 1]) + 1 - at)), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        out += (part @ part.T).astype(np.int64)
    return out


def verify(units: DataFrame, threshold: float) -> DataFrame:
    """Compare the classes of each unit; ``units`` is partitioned and sorted by unit."""

    @kernel.task
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.binary()), ("n_classes", pa.int64()), ("n_linked", pa.int64()), ("root", pa.binary())])
        held: list[dict] = []
        out: list[dict] = []

        def close() -> None:
            if held:
                unit = Unit(
                    [r["key"] for r in held],
                    [r["grams"] for r in held],
                    np.array([r["side"] for r in held]),
                    np.array([r["weight"] for r in held]),
                    [np.array(r["buckets"]) for r in held],
                    held[0]["bucket"],
                    held[0]["left"] != held[0]["right"],
                )
                out.extend(unit.links(threshold))
                held.clear()

        for batch in batches:
            for row in (r for at in range(0, batch.num_rows, 256) for r in batch.slice(at, 256).to_pylist()):
                if held and (row["bucket"], row["left"], row["right"]) != (held[0]["bucket"], held[0]["left"], held[0]["right"]):
                    close()
                held.append(row)
            if len(out) > 1_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return units.mapInArrow(compared, "key binary, n_classes long, n_linked long, root binary")


def groups(documents: DataFrame, n: int = N, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """(doc_id, tag, key, class_id, class_size, n_links, group_id, group_key) of every row of documents.

    ``n_links`` counts the other rows with a similarity of at least ``threshold``, copies included. ``group_id`` is the
    smallest id that is reached over links.
    """
    spark = documents.sparkSession
    bands, rows = band_shape(threshold, miss)
    described = stored(describe(documents, n, bands, rows), "signatures")
    some = described.where("key IS NOT NULL")
    classes = stored(
        some.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("weight"), F.min(F.struct(_id().alias("id"), "tag")).alias("one")),
        "classes",
    )
    # buckets of classes; rows of one class are merged before they move
    member = stored(some.select("key", "size", F.explode("bands").alias("bucket")).distinct(), "members")
    buckets = (
        member.groupBy("bucket")
        .agg(F.count("*").alias("m"), F.sum("size").alias("grams"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"))
        .where("m > 1")
        .groupBy("m", "grams", "x", "y")
        .agg(F.min("bucket").alias("bucket"))
    )
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_CLASSES), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    kept = stored(buckets.select("bucket", blocks.alias("blocks")), "buckets")
    member = stored(member.join(kept, "bucket").select("key", "bucket", "blocks"), "members")
    # at most as many buckets per class as there are bands
    lists = member.groupBy("key").agg(F.sort_array(F.collect_list("bucket")).alias("buckets"))
    wanted = stored(lists.join(classes, "key").select("key", "buckets", "weight", "one.id", "one.tag"), "wanted")
    sets = stored(full_sets(documents, wanted.select("key", "id", "tag"), n).join(wanted.select("key", "buckets", "weight").hint("merge"), "key"), "sets")
    own = F.pmod(F.xxhash64("key", F.lit(2)), F.col("blocks")).cast("int")
    units = (
        member.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "bucket", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), partitions_for(spark, kept.count() * 50))
    placed = units.join(sets.hint("merge"), "key").repartition(parts, "bucket", "left", "right").sortWithinPartitions("bucket", "left", "right")
    found = stored(verify(placed, threshold), "links")
    linked = found.groupBy("key").agg(F.sum("n_classes").alias("n_classes"), F.sum("n_linked").alias("n_linked"))
    joined = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    whole = classes.join(linked, "key", "left").join(joined.withColumnRenamed("id", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    whole = stored(whole, "classes")
    smallest = whole.groupBy("root").agg(F.min("class_id").alias("group_id"))
    named = stored(
        whole.join(smallest, "root").select(
            "key", "class_id", F.col("weight").alias("class_size"), (F.col("weight") - 1 + F.coalesce("n_linked", F.lit(0))).alias("n_links"), "group_id", F.col("root").alias("group_key")
        ),
        "named",
    )
    # rows without words have no key and meet nothing; rows of a large class are dealt out
    told = described.select("doc_id", "tag", "key").withColumn("_part", F.spark_partition_id())
    hot = hot_keys(classes.select("key", "weight"), ["key"], "weight")
    met = skew_join(told.where("key IS NOT NULL"), named, ["key"], hot, ["doc_id", "tag", "_part"])
    alone = told.where("key IS NULL").select(
        "doc_id", "tag", "key", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("group_id"), F.lit(None).cast("binary").alias("group_key")
    )
    return met.select(alone.columns).unionByName(alone)


def one_of_each(documents: DataFrame, n: int = N, threshold: float = THRESHOLD, hot_rows: int | None = None) -> DataFrame:
    """Rows of documents, all columns, without those linked to one with a smaller id, directly or over others.

    Of each group the row with the smallest id stays, null last, then by a hash of the text; of rows equal in both, one.
    """
    found = stored(groups(documents, n, threshold).where("key IS NOT NULL").select("doc_id", _id().alias("id"), "tag", "group_key"), "groups")
    rank = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "tag", "id")
    best = found.groupBy("group_key").agg(F.min(rank).alias("best"), F.count("*").alias("n")).where("n > 1")
    best = stored(best.select("group_key", "best.id", "best.tag"), "best")
    # rows to leave out, and rows of which one copy stays
    same = stored(found.groupBy("id", "tag", "group_key").agg(F.count("*").alias("rows")), "same")
    verdict = same.join(best.select("group_key", F.col("id").alias("best_id"), F.col("tag").alias("best_tag")), "group_key")
    stays = (F.col("id") == F.col("best_id")) & (F.col("tag") == F.col("best_tag"))
    verdict = stored(verdict.where(~stays | (F.col("rows") > 1)).select("id", "tag", stays.alias("stays"), "rows"), "verdict")
    # a row's own columns are kept apart, so that they can have any name
    own = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    rows = documents.select(_id().alias("id"), F.xxhash64("text").alias("tag"), own)
    # rows that repeat very often are settled without moving them: tasks keep one each; there are few such rows
    often = F.col("rows") > (hot_rows or HOT_ROWS)
    hot = stored(verdict.where(often).select("id", "tag", "stays"), "hot")
    few, once = rows, None
    if not hot.isEmpty():
        few = rows.join(F.broadcast(hot), ["id", "tag"], "left_anti")
        once = rows.join(F.broadcast(hot.where("stays")), ["id", "tag"], "left_semi").groupBy("id", "tag").agg(F.first("row").alias("row")).select("row.*")
    # other texts are moved once, by the same plan at any size; repeated rows meet there as well
    nth = F.row_number().over(Window.partitionBy("id", "tag").orderBy("id"))
    joined = few.join(verdict.where(~often).select("id", "tag", "stays").hint("merge"), ["id", "tag"], "left").withColumn("nth", nth)
    kept = joined.where("stays IS NULL OR (stays AND nth = 1)").select("row.*")
    return kept if once is None else kept.unionByName(once)
