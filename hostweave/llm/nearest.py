"""Approximate nearest neighbours by cosine over balanced posting lists.

Centroids come from a bounded sample of vectors (``SAMPLE_VECTORS``), halved again and again along its widest spread, so
that lists are equally long on the sample. Every vector goes to the list of its nearest centroid, and to the lists of
others almost as near (at most ``REPLICAS``, none nearer to a chosen centroid than to the vector). Centroids are searched
by a best-first walk over a neighbour graph that each task holds in memory. A query reads the lists whose centroids are
within a ratio of the nearest one's distance, and compares itself with all vectors in them, in double precision.

Equal vectors are one entry with their smallest ids, as many as a result can need. Long lists are cut into parts and
many queries of a list into blocks, so no task holds a whole list; results of all parts are merged by query.

Defined cases: vectors that are null, zero, hold null or non-finite components or have another length than most take no
part, as do rows without id; rows equal in id and vector count once; with fewer than ``k`` candidates all are returned;
equal scores go by id; an empty table gives no rows. Only id and vector are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostweave.llm import kernel, sampling
from hostweave.llm.storage import stored

# Bounds of the index: vectors it is fitted on, and lists.
SAMPLE_VECTORS, MOST_LISTS = 32_768, 4_096
# Lists a vector may be in, and how much farther than the nearest the others may be.
REPLICAS, REPLICA_RATIO = 6, 1.15
# Neighbours of a centroid in the graph, width of the search, and centroids opened at once.
DEGREE, BEAM, OPENED = 24, 96, 8
# Lists of a query: at least, and those within this ratio of the nearest centroid's distance.
LEAST_LISTS, PROBE_RATIO = 12, 1.35
# Vectors of a part of a list, queries of a block, and vectors compared at once.
PART_VECTORS, BLOCK_QUERIES, STEP_VECTORS = 20_000, 2_000, 4_096


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): vectors that take part, as the bytes of doubles; rows that are equal once."""
    size = F.size(vector)
    common = vectors.where(F.col(vector).isNotNull()).groupBy(size.alias("n")).count().orderBy(F.desc("count"), "n").first()
    length = common["n"] if common else 0

    @kernel.task
    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            flat = column.flatten()
            x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)  # null becomes nan
            x = x + 0.0  # no negative zeros
            with np.errstate(over="ignore"):
                norm = (x * x).sum(1)
            good = np.isfinite(x).all(1) & np.isfinite(norm) & (norm > 0)
            raw = x[good].tobytes()
            step = 8 * length
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").filter(pa.array(good)), pa.array([raw[i : i + step] for i in range(0, len(raw), step)], pa.binary())], ["id", "v"]
            )

    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (size == length) & F.lit(length > 0))
    return rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(cleaned, "id long, v binary").distinct()


def matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Directions of the vectors, in single precision for the index."""
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def balanced_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Means of a power of two of equal parts of the sample, by halving along the direction of two means."""
    parts = [np.arange(len(x))]
    while 2 * len(parts) <= lists:
        new = []
        for part in parts:
            if len(part) < 2:
                new.append(part)
                continue
            y = x[part]
            a, b = y[0], y[np.argmin(y @ y[0])]
            for _ in range(6):
                nearer = y @ a >= y @ b
                if nearer.all() or not nearer.any():
                    break
                a, b = y[nearer].mean(0), y[~nearer].mean(0)
            order = np.argsort(y @ (a - b), kind="stable")
            new += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
        if len(new) == len(parts):
            break
        parts = new
    means = np.stack([x[p].mean(0) for p in parts if len(p)]) if len(x) else x
    size = np.sqrt((means * means).sum(1, keepdims=True))
    return (means / np.where(size > 0, size, 1)).astype(np.float32)


@dataclass
class Graph:
    """Centroids, the nearest others of each, and where searches start."""

    centroids: np.ndarray
    near: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray, degree: int = DEGREE) -> Graph:
        n = len(centroids)
        degree = min(degree, n - 1)
        near = np.zeros((n, 2 * degree), np.int64)
        for at in range(0, n, 512):
            likeness = centroids[at : at + 512] @ centroids.T
            likeness[np.arange(len(likeness)), np.arange(at, at + len(likeness))] = -np.inf
            top = np.argsort(-likeness, 1, kind="stable")
            near[at : at + 512, :degree] = top[:, :degree]
            # and some at all distances, so that far groups are connected
            far = np.unique(np.geomspace(degree + 1, max(n - 1, 1), degree).astype(np.int64) - 1) if degree else np.zeros(0, np.int64)
            far = np.resize(far, degree) if len(far) else far
            near[at : at + 512, degree:] = top[:, far]
        entries = np.unique(np.linspace(0, n - 1, min(n, 32)).astype(np.int64))
        return cls(centroids, near, entries)

    def search(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroids found for each direction, nearest first, and their distances."""
        n, c = len(x), len(self.centroids)
        beam = min(beam, c)
        ids = np.full((n, beam), -1)
        likeness = np.full((n, beam), -np.inf, np.float32)
        opened = np.ones((n, beam), bool)
        seen = np.zeros((n, c), bool)
        rows = np.arange(n)

        def merge(new: np.ndarray, live: np.ndarray) -> None:
            """Take new centroids (of the rows ``live``; -1 for none) into the beams."""
            nonlocal ids, likeness, opened
            value = np.where(new >= 0, np.einsum("nd,nkd->nk", x[live], self.centroids[new], optimize=False), -np.inf)
            all_ids, all_like = np.concatenate([ids[live], new], 1), np.concatenate([likeness[live], value], 1)
            all_open = np.concatenate([opened[live], new < 0], 1)
            order = np.argsort(-all_like, 1, kind="stable")[:, :beam]
            ids[live], likeness[live], opened[live] = (np.take_along_axis(a, order, 1) for a in (all_ids, all_like, all_open))

        start = np.repeat(self.entries[None], n, 0)
        seen[:, self.entries] = True
        merge(start, rows)
        while True:
            live = np.flatnonzero((~opened).any(1))
            if not len(live):
                break
            turn = np.argsort(opened[live], 1, kind="stable")[:, :OPENED]  # unopened ones in order of likeness
            fresh = ~np.take_along_axis(opened[live], turn, 1)
            at = np.take_along_axis(ids[live], turn, 1)
            opened[live[:, None], turn] = True
            new = np.where(fresh[:, :, None], self.near[np.maximum(at, 0)], -1).reshape(len(live), -1)
            new = np.sort(new, 1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            known = seen[live[:, None], np.maximum(new, 0)]
            new[known] = -1
            r, k = np.nonzero(new >= 0)
            seen[live[r], new[r, k]] = True
            if len(r):
                width = int((new >= 0).sum(1).max())
                new = -np.sort(-new, 1)[:, :width]
                merge(new, live)
        return ids, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * likeness))

    def lists(self, x: np.ndarray, replicas: int = REPLICAS, ratio: float = REPLICA_RATIO) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every list that a vector goes to."""
        ids, far = self.search(x, max(16, 2 * replicas))
        limit = far[:, :1] * ratio
        taken = np.zeros(ids.shape, bool)
        taken[:, 0] = True
        for j in range(1, ids.shape[1]):
            near = (ids[:, j] >= 0) & (far[:, j] <= limit[:, 0]) & (taken.sum(1) < replicas)
            # not if a chosen centroid is nearer to this one than the vector is
            for i in range(j):
                between = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.centroids[ids[:, i]] * self.centroids[ids[:, j]]).sum(1)))
                near &= ~taken[:, i] | (between >= far[:, j])
            taken[:, j] = near
        row, j = np.nonzero(taken)
        return row, ids[row, j]

    def probes(self, x: np.ndarray, least: int = LEAST_LISTS, ratio: float = PROBE_RATIO) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every list that a query reads."""
        ids, far = self.search(x)
        near = far <= far[:, :1] * ratio
        near[:, :least] = True
        row, j = np.nonzero(near & (ids >= 0))
        return row, ids[row, j]


@dataclass
class Index:
    graph: Graph | None
    postings: DataFrame  # list, v, ids


def build(vectors: DataFrame, k: int, sample: int = SAMPLE_VECTORS, most_lists: int = MOST_LISTS) -> Index:
    """Index all ``vectors`` (id, v); of equal vectors the k + 1 smallest ids are kept."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    entries = stored(vectors.withColumn("_rank", rank).where(F.col("_rank") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    n = entries.count()
    if not n:
        return Index(None, entries.select(F.lit(0).alias("list"), "v", "ids"))
    # a bounded sample in hash order
    raw = sampling.below(entries.select("v", F.xxhash64("v").alias("h")), "h", sample).orderBy("h", "v").limit(sample).select("v").toArrow()
    x = unit(matrix(raw.column("v").combine_chunks()))
    lists = 1 << max(0, round(math.log2(min(most_lists, max(1.0, 2.0 * math.sqrt(n)), max(1, len(x) // 8)))))
    graph = Graph.build(balanced_centroids(x, lists))

    @kernel.task
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                row, list_ = graph.lists(unit(matrix(part.column("v"))))
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(list_.astype(np.int32)), taken.column("v"), taken.column("ids")], ["list", "v", "ids"])

    return Index(graph, stored(entries.select("v", "ids").mapInArrow(placed, "list int, v binary, ids array<long>"), "postings"))


def compare(units: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best ``k`` of each query in each unit. Units are sorted, queries first."""

    @kernel.task
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        unit_, names, q, norm = None, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0)
        best: list[list[tuple[float, int]]] = []

        def results() -> Iterator[pa.RecordBatch]:
            rows = [(int(name), vec, -score) for name, found in zip(names, best, strict=True) for score, vec in found]
            if rows:
                a, b, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], schema=schema)

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("list", "part", "block")), strict=True))
            kinds = np.array(batch.column("kind").to_pylist())
            start = 0
            while start < len(keys):
                stop = start + 1
                while stop < len(keys) and keys[stop] == keys[start] and kinds[stop] == kinds[start] and stop - start < STEP_VECTORS:
                    stop += 1
                if keys[start] != unit_:
                    yield from results()
                    unit_, names, q, norm, best = keys[start], np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), []
                part = batch.slice(start, stop - start)
                x = matrix(part.column("v"))
                if kinds[start] == 0:
                    names = np.concatenate([names, [i[0] for i in part.column("ids").to_pylist()]])
                    q = x if not len(q) else np.concatenate([q, x])
                    norm = np.sqrt((q * q).sum(1))
                    best += [[] for _ in range(len(x))]
                elif len(q):
                    ids = part.column("ids").to_pylist()
                    size = np.sqrt((x * x).sum(1))
                    rough = (q @ x.T) / norm[:, None] / size[None, :]
                    # k + 1 entries give k others; rounding in the product must not decide
                    wanted = min(k + 1, rough.shape[1])
                    floor = -np.partition(-rough, wanted - 1, 1)[:, wanted - 1] - 1e-9
                    kth = np.array([-b[-1][0] if len(b) == k else -2.0 for b in best]) - 1e-9
                    a, b = np.nonzero(rough >= np.maximum(floor, kth)[:, None])
                    score = np.clip((q[a] * x[b]).sum(1) / (norm[a] * size[b]), -1.0, 1.0)
                    for i, j, s in zip(a.tolist(), b.tolist(), score.tolist(), strict=True):
                        best[i] += [(-s, vec) for vec in ids[j] if vec != names[i]]
                    for i in np.unique(a).tolist():
                        best[i] = sorted(set(best[i]))[:k]
                start = stop
        yield from results()

    return units.mapInArrow(compared, "query_id long, vec_id long, score double")


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found of every query (id, v)."""
    spark = queries.sparkSession
    graph = index.graph
    if graph is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    @kernel.task
    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                row, list_ = graph.probes(unit(matrix(part.column("v"))))
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(list_.astype(np.int32)), taken.column("id"), taken.column("v")], ["list", "id", "v"])

    probes = stored(queries.mapInArrow(probed, "list int, id long, v binary"), "probes")
    # at most MOST_LISTS rows each
    sizes = index.postings.groupBy("list").agg(F.ceil(F.count("*") / PART_VECTORS).cast("int").alias("parts"))
    asked = probes.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("blocks"))
    plan = F.broadcast(stored(sizes.join(asked, "list"), "plan"))

    def among(n: str, key: str) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(3)), F.col(n)).cast("int")

    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["list", "part", "block", "kind", "v", "ids"]
    asking = probes.join(plan, "list").withColumns({"block": among("blocks", "id"), "kind": F.lit(0), "ids": F.array("id")}).withColumn("part", every("parts"))
    held = index.postings.join(plan, "list").withColumns({"part": among("parts", "v"), "kind": F.lit(1)}).withColumn("block", every("blocks"))
    units = asking.select(columns).union(held.select(columns)).repartition("list", "part", "block").sortWithinPartitions("list", "part", "block", "kind")
    found = compare(units, k).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of every row whose id is divisible by ``every``, among all other rows."""
    rows = stored(usable(vectors, key, vector), "usable")
    return search(build(rows, k), rows.where(F.col("id") % every == 0), k)
