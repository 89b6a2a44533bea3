"""Removal of byte strings that stand in the corpus more than once, by a distributed merge sort of suffixes.

A string of ``LENGTH`` bytes that starts at i has an anchor: the place of the least hash of SEED_BYTES bytes among its
first WIDTH places. Equal strings have their anchors at equal offsets, so only suffixes that start at anchors are sorted,
about one in WIDTH / 2. An anchor's context are all bytes of the strings that have it.

1. Anchors are described by a hash of the bytes that any equal string must share from the anchor on (``near``), and one
   of the whole context (``full``). Counts by ``near`` tell which can have a partner at all.
2. If all anchors with one ``near`` have the same context, their strings are repeated, and nothing more is needed.
   Else one document per context gives the suffix: each bucket of documents sorts its suffixes, front-codes the run and
   sends it to the part of its ``near``.
3. A part merges its runs with a loser tree that never compares known prefixes again. The lengths of the common prefixes
   that come out of the merge, with the bytes before the anchors, tell for every offset whether the string there is
   equal to another one.
4. The verdicts go back to the documents by bucket, which mark and cut out the covered bytes.

A ``near`` with more than HOT_CONTEXTS contexts is not sent to one part: its strings are hashed one by one and counted.
That gives the same result, and spreads such a group over all tasks.

Defined cases: a null or empty text has no bytes; texts shorter than LENGTH stay whole; repeated rows repeat each other;
rows without id are treated like others. Kept bytes need not be valid UTF-8, so they are hashed or returned as binary.
Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.llm import kernel
from hostweave.llm.storage import small_batches, stored, table_bytes
from hostweave.llm.suffix_runs import encode_run, merge_runs

LENGTH = 200
# Places among which a string's anchor is, and bytes that are hashed for it; both fit into a string.
WIDTH, SEED_BYTES = 150, 32
# Bytes of documents in a bucket, suffixes in a part, and contexts of one ``near`` that may meet in a part.
BUCKET_BYTES, PART_SUFFIXES, HOT_CONTEXTS = 8 << 20, 50_000, 50_000
# Starts of one text that are looked at together.
SEGMENT = 1 << 20

_FULL = np.uint64(0x9FB21C651E98DF25)


class Anchors:
    """Anchors of the strings that start in a range of places, as arrays."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, length: int = LENGTH, width: int = WIDTH, seed: int = SEED_BYTES):
        """``starts`` are ascending; each has ``length`` bytes after it in its text."""
        self.sums = kernel.prefix_hash(data)
        n = len(data) - seed + 1
        at = np.arange(max(n, 0))
        least = (kernel.range_hash(self.sums, at, at + seed) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
        reach = 1
        while 2 * reach <= width:
            least[:-reach] = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if width > reach:
            least[: -(width - reach)] = np.minimum(least[: -(width - reach)], least[width - reach :])
        anchor = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(starts))[: len(first)] - 1
        self.at = anchor[first]
        self.low, self.high = starts[first], starts[last]  # first and last start of its strings
        self.near = kernel.range_hash(self.sums, self.at, self.at + length - width + 1)
        self.full = kernel.mix(kernel.range_hash(self.sums, self.low, self.high + length) + (self.at - self.low).astype(np.uint64) * _FULL)


def _segments(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first byte, bytes, starts relative to it) in which a piece's strings are looked at."""
    size = np.maximum(np.diff(offsets) - length + 1, 0)
    if len(data) <= 2 * SEGMENT:
        yield 0, data, np.concatenate([np.arange(a, a + n) for a, n in zip(offsets[:-1], size, strict=True) if n] or [np.zeros(0, np.int64)])
        return
    for a, n in zip(offsets[:-1].tolist(), size.tolist(), strict=True):
        for s in range(0, n, SEGMENT):
            many = min(SEGMENT, n - s)
            yield a + s, data[a + s : a + s + many + length - 1], np.arange(many)


def _bucketed(documents: DataFrame, buckets: int) -> DataFrame:
    return small_batches(documents).select(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(buckets)).cast("int").alias("bucket"), "doc_id", "text")


def describe(rows: DataFrame, length: int) -> DataFrame:
    """(bucket, near, full, n) of the anchors, n 2 if the context stands more than once; equal ones of a batch once."""

    @kernel.task
    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            for a, _, data, offsets in kernel.pieces(kernel.as_text(batch.column("text"))):
                for first, part, starts in _segments(data, offsets, length):
                    if not len(starts):
                        continue
                    found = Anchors(part, starts, length)
                    doc = np.searchsorted(offsets, first + found.low, "right") - 1
                    b = bucket[a + doc]
                    order = np.lexsort((found.full, found.near, b))
                    b, near, full = b[order], found.near[order], found.full[order]
                    fresh = np.ones(len(b), bool)
                    fresh[1:] = (b[1:] != b[:-1]) | (near[1:] != near[:-1]) | (full[1:] != full[:-1])
                    at = np.flatnonzero(fresh)
                    n = np.minimum(np.diff(np.append(at, len(b))), 2)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(b[at]), pa.array(near[at].view(np.int64)), pa.array(full[at].view(np.int64)), pa.array(n.astype(np.int32))],
                        ["bucket", "near", "full", "n"],
                    )

    return rows.select("bucket", "text").mapInArrow(described, "bucket int, near long, full long, n int")


def _by_bucket(rows: DataFrame, notes: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Documents of each bucket after the notes for it, in one partition and that order."""
    none = lambda kind: F.lit(None).cast(kind)
    key = rows.schema["doc_id"].dataType.simpleString()
    noted = notes.select("bucket", F.lit(0).alias("kind"), none(key).alias("doc_id"), none("string").alias("text"), *columns)
    texts = rows.select("bucket", F.lit(1).alias("kind"), "doc_id", "text", *[none(kind).alias(name) for name, kind in columns.items()])
    return noted.union(texts).repartition("bucket").sortWithinPartitions("bucket", "kind")


def _runs_of(values: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(values)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True) if len(values) else ()


class Notes:
    """Notes of one bucket, found by (near, full)."""

    def __init__(self, names: list[str]):
        self.names, self.parts = names, []

    def add(self, batch: pa.RecordBatch) -> None:
        self.parts.append([batch.column(n).to_numpy(zero_copy_only=False) for n in ["near", "full", *self.names]])
        self.key = None

    def find(self, near: np.ndarray, full: np.ndarray) -> np.ndarray:
        """Row of each anchor's note, -1 without one."""
        if self.key is None:
            columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
            key = kernel.mix(columns[0].view(np.uint64) ^ kernel.mix(columns[1].view(np.uint64)))
            order = np.argsort(key, kind="stable")
            self.key, self.columns = key[order], [c[order] for c in columns[2:]]
        key = kernel.mix(near ^ kernel.mix(full))
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)


def _walk(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, Notes | None, pa.RecordBatch | None]]:
    """(bucket, notes, documents) for each run of documents; documents None at the end of a bucket."""
    bucket, notes = None, None
    for batch in batches:
        buckets, kinds = batch.column("bucket").to_numpy(), batch.column("kind").to_numpy()
        for a, b in _runs_of(buckets * 2 + kinds):
            if buckets[a] != bucket:
                if bucket is not None:
                    yield bucket, notes, None
                bucket, notes = int(buckets[a]), None
            part = batch.slice(a, b - a)
            if kinds[a] == 0:
                notes = notes or Notes(names)
                notes.add(part)
            else:
                yield bucket, notes, part
    if bucket is not None:
        yield bucket, notes, None


def sorted_runs(placed: DataFrame, parts: int, length: int) -> DataFrame:
    """(part, run): front-coded sorted runs of the suffixes asked for, and for hot ones their strings' hashes.

    A load is near and full (8 bytes each), the bytes before the anchor, and the number of those.
    """

    @kernel.task
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("run", pa.binary()), ("x", pa.int64()), ("y", pa.int64()), ("near", pa.int64()), ("full", pa.int64()), ("offset", pa.int32())])
        entries: dict[int, list[tuple[bytes, bytes]]] = {}
        held, done = 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if entries:
                rows = [{"part": part, "run": encode_run(sorted(found))} for part, found in sorted(entries.items())]
                entries.clear()
                yield pa.RecordBatch.from_pylist(rows, schema)
            held = 0

        for _, notes, documents in _walk(batches, ["hot"]):
            if documents is None:
                done = set()
                if held > 16 << 20:
                    yield from flush()
                continue
            if notes is None:
                continue
            for _, _, data, offsets in kernel.pieces(kernel.as_text(documents.column("text"))):
                for _, part, starts in _segments(data, offsets, length):
                    if not len(starts):
                        continue
                    found = Anchors(part, starts, length)
                    row = notes.find(found.near, found.full)
                    raw = part.tobytes()
                    for i in np.flatnonzero(row >= 0).tolist():
                        r = int(row[i])
                        if r in done:
                            continue
                        done.add(r)
                        at, low, high = int(found.at[i]), int(found.low[i]), int(found.high[i])
                        near, full = found.near[i : i + 1], found.full[i : i + 1]
                        if notes.columns[0][r]:
                            s = np.arange(low, high + 1)
                            x = kernel.range_hash(found.sums, s, s + length)
                            y = kernel.range_hash(kernel.prefix_hash(part[low : high + length], kernel.BYTE_VALUES[::-1]), s - low, s - low + length)
                            k = len(s)
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.array(x.view(np.int64)), pa.array(y.view(np.int64)),
                                    pa.array(np.repeat(near.view(np.int64), k)), pa.array(np.repeat(full.view(np.int64), k)), pa.array((at - s).astype(np.int32)),
                                ],
                                schema=schema,
                            )
                            continue
                        load = near.tobytes() + full.tobytes() + raw[low:at]
                        suffix = raw[at : high + length]
                        entries.setdefault(int(near[0] % np.uint64(parts)), []).append((suffix, load))
                        held += len(suffix) + len(load)
                if held > 64 << 20:
                    yield from flush()
        yield from flush()

    return placed.mapInArrow(made, "part int, run binary, x long, y long, near long, full long, offset int")


def equal_offsets(shared: np.ndarray, left: list[bytes], low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest offset of each sorted suffix at which its string equals that of another one, or -1.

    ``shared`` is the common prefix with the suffix before, ``left`` the bytes before each anchor, ``low`` and ``high``
    the offsets that each has.
    """
    n = len(left)
    least, most = np.full(n, -1), np.full(n, -1)
    size = np.fromiter(map(len, left), np.int64, n)
    flat = np.frombuffer(b"".join(left), np.uint8)
    end = np.cumsum(size)
    before = np.zeros(n, np.int64)  # names of the bytes before the anchor, as far as the offset goes
    live = np.arange(n)
    widest = int(high.max()) if n else -1
    for offset in range(widest + 1):
        if offset:
            live = live[size[live] >= offset]
            before = before.copy()
            _, before[live] = np.unique(before[live] * 256 + flat[end[live] - offset], return_inverse=True)
        if len(live) < 2:
            break
        run = np.cumsum(shared < length - offset)[live]
        _, where, count = np.unique(run * (n + 1) + before[live], return_inverse=True, return_counts=True)
        twice = live[count[where] > 1]
        twice = twice[(low[twice] <= offset) & (offset <= high[twice])]
        most[twice] = offset
        twice = twice[least[twice] < 0]
        least[twice] = offset
    return least, most


def merged(runs: DataFrame, length: int) -> DataFrame:
    """(near, full, low, high): the offsets at which contexts have strings that others have; runs are sorted by part."""

    @kernel.task
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: list[bytes]) -> Iterator[pa.RecordBatch]:
            shared, loads, sizes = [], [], []
            for common, suffix, load in merge_runs(held):
                shared.append(common)
                loads.append(load)
                sizes.append(len(suffix))
            left = [load[16:] for load in loads]
            low = length - np.array(sizes)
            high = np.fromiter(map(len, left), np.int64, len(left))
            a, b = equal_offsets(np.array(shared), left, low, high, length)
            on = np.flatnonzero(a >= 0)
            names = np.frombuffer(b"".join(loads[i][:16] for i in on.tolist()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(a[on].astype(np.int32)), pa.array(b[on].astype(np.int32))], ["near", "full", "low", "high"]
            )

        part, held = None, []
        for batch in batches:
            for p, run in zip(batch.column("part").to_pylist(), batch.column("run").to_pylist(), strict=True):
                if p != part and held:
                    yield from close(held)
                    held = []
                part = p
                held.append(run)
        if held:
            yield from close(held)

    return runs.mapInArrow(made, "near long, full long, low int, high int")


def _cut(placed: DataFrame, key: str, length: int, keep: bool) -> DataFrame:
    """Documents without the covered bytes; ``placed`` has each bucket's verdicts before its documents."""

    @kernel.task
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, notes, documents in _walk(batches, ["low", "high"]):
            if documents is None:
                continue
            for a, b, data, offsets in kernel.pieces(kernel.as_text(documents.column("text"))):
                step = np.zeros(len(data) + 1, np.int32)
                for first, part, starts in _segments(data, offsets, length) if notes is not None else ():
                    if not len(starts):
                        continue
                    found = Anchors(part, starts, length)
                    row = notes.find(found.near, found.full)
                    on = np.flatnonzero(row >= 0)
                    low, high = (c[row[on]] for c in notes.columns)
                    # -1: all of the context's strings
                    start = np.where(high < 0, found.low[on], found.at[on] - high)
                    end = np.where(low < 0, found.high[on], found.at[on] - low) + length
                    np.add.at(step, first + start, 1)
                    np.add.at(step, first + end, -1)
                gone = np.cumsum(step[:-1]) > 0
                spans, _ = kernel.runs(gone, offsets)
                removed = kernel.count_in(gone, offsets[:-1], offsets[1:])
                kept = [data[s:e][~gone[s:e]].tobytes() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                columns = [
                    documents.column("doc_id").slice(a, b - a),
                    pa.array(np.diff(offsets)),
                    pa.array(removed.astype(np.int64)),
                    pa.array(np.diff(np.searchsorted(spans, offsets)).astype(np.int64)),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                ]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.binary())] if keep else [])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep else [])])

    return placed.mapInArrow(made, f"doc_id {key}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep)


def remove_repeats(documents: DataFrame, length: int = LENGTH, keep: bool = False, hot: int = HOT_CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, and the kept bytes if asked for."""
    spark = documents.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * tasks, table_bytes(documents) // BUCKET_BYTES)
    rows = _bucketed(documents, buckets)
    # anchors that share a near with others; counts come from all documents
    counts = (
        describe(rows, length)
        .groupBy("near")
        .agg(F.sum("n").alias("times"), F.min("full").alias("one"), F.max("full").alias("other"))
        .where("times > 1")
        .select("near", (F.col("one") == F.col("other")).alias("same"))
    )
    counts = stored(counts, "near")
    paired = stored(describe(rows, length).join(counts, "near"), "anchors")
    several = paired.where("NOT same").groupBy("near", "full").agg(F.sum("n").alias("times"), F.min("bucket").alias("bucket"))
    several = stored(several, "contexts")
    crowded = several.groupBy("near").agg(F.count("*").alias("m")).where(F.col("m") > hot).select("near", F.lit(True).alias("hot"))
    crowded = stored(crowded, "crowded")
    asked = several.join(crowded, "near", "left").select("bucket", "near", "full", F.coalesce("hot", F.lit(False)).alias("hot"))
    parts = max(tasks, -(-several.count() // PART_SUFFIXES))
    sent = stored(sorted_runs(_by_bucket(rows, asked, {"near": "long", "full": "long", "hot": "boolean"}), parts, length), "runs")
    runs = sent.where("run IS NOT NULL").select("part", "run").repartition("part").sortWithinPartitions("part")
    found = merged(runs, length)
    strings = sent.where("run IS NULL").select("x", "y", "near", "full", "offset")
    twice = strings.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y")
    counted = strings.join(twice, ["x", "y"]).groupBy("near", "full").agg(F.min("offset").alias("low"), F.max("offset").alias("high"))
    whole = several.where("times > 1").select("near", "full", F.lit(-1).alias("low"), F.lit(-1).alias("high"))
    partly = found.union(counted).join(several.where("times = 1").select("near", "full"), ["near", "full"])
    verdicts = stored(partly.union(whole), "verdicts")
    notes = paired.where("same").select("bucket", "near", "full", F.lit(-1).alias("low"), F.lit(-1).alias("high"))
    notes = notes.union(paired.where("NOT same").join(verdicts, ["near", "full"]).select("bucket", "near", "full", "low", "high"))
    # one note for each bucket
    notes = notes.distinct()
    key = documents.schema["doc_id"].dataType.simpleString()
    return _cut(_by_bucket(rows, notes, {"near": "long", "full": "long", "low": "int", "high": "int"}), key, length, keep)
