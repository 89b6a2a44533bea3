"""Token ids as length-delimited binary records with masked checksums and a separate offset index.

``write`` encodes documents, puts them in ascending id order and writes one pair of files per range of ids:

- ``part-NNNNN.rec``: records one after the other, each framed as
  length (uint64), masked CRC-32C of those 8 bytes (uint32), payload, masked CRC-32C of the payload (uint32);
- ``part-NNNNN.idx``: the byte offset of every record and the end of the file (uint64).

A payload is a 16-byte header (key as int64, number of ids as uint32, width of an id in bytes as uint16, 1 as uint16 if
the key is null) and the ids. Everything is little-endian. ``read`` goes through the files in order, ``read_shuffled`` in
a seeded order by way of the index. Both check every checksum and raise on damage.

Files go to a folder that all executors share, under any address that pyarrow's file systems know. A task writes under
a name of its own and renames when done, so retried and duplicated tasks leave one whole file.

Defined cases: a null or empty text has the end id alone; a null key is written as null and comes first; rows with the
same key stay apart, in the order of a hash of their texts; an empty table gives no records. Only key and text are read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostweave.llm import kernel
from hostweave.llm.storage import new_folder, small_batches, stored, table_bytes
from hostweave.operators.scale import running_total

# Bytes of input per file aimed at.
SHARD_BYTES = 32 << 20
# Different words that a task remembers the ids of.
CACHE_WORDS = 1 << 20
HEADER = struct.Struct("<qIHH")
FRAME = 8 + 4 + HEADER.size + 4

# --- checksums -----------------------------------------------------------------------------------------------------

POLYNOMIAL = 0x82F63B78  # CRC-32C, reflected
BLOCK = 64


def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1).astype(np.uint32)
    ahead = [one]
    for _ in range(BLOCK - 1):
        ahead.append((ahead[-1] >> 8) ^ one[ahead[-1] & 255])
    # images of the 32 single bits under BLOCK zero bytes, then twice as many, and so on
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(BLOCK):
        bits = (bits >> 8) ^ one[bits & 255]
    shifts = []
    for _ in range(40):
        table = np.zeros((4, 256), np.uint32)
        for byte in range(4):
            for bit in range(8):
                table[byte] ^= np.where(np.arange(256) >> bit & 1, bits[8 * byte + bit], 0).astype(np.uint32)
        shifts.append(table)
        bits = _apply(table, bits)
    return np.stack(ahead), shifts


def _apply(table: np.ndarray, value: np.ndarray) -> np.ndarray:
    return table[0][value & 255] ^ table[1][value >> 8 & 255] ^ table[2][value >> 16 & 255] ^ table[3][value >> 24]


_AHEAD, _SHIFTS = _tables()


def crc32c(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32C of byte ranges of at least 4 bytes, all at once.

    The checksum is linear in the bytes: ranges are cut into blocks counted from their ends, blocks are summed up by
    table, and neighbouring sums are folded pairwise.
    """
    n = end - start
    blocks = -(-n // BLOCK)
    owner = np.repeat(np.arange(len(n)), blocks)
    first = np.cumsum(blocks) - blocks
    back = blocks[owner] - 1 - (np.arange(len(owner)) - first[owner])  # blocks between this one and the range's end
    b = end[owner] - back * BLOCK
    a = np.maximum(b - BLOCK, start[owner])
    sums = np.zeros(len(owner), np.uint32)
    for j in range(BLOCK):  # bytes from the block's end; the first four of a range are inverted
        at = b - 1 - j
        inside = at >= a
        value = data[np.maximum(at, 0)]
        value = np.where(at < start[owner] + 4, ~value, value)
        sums ^= np.where(inside, _AHEAD[j][value], np.uint32(0))
    level = 0
    while len(sums) > len(n):
        odd = back & 1 == 1
        folded = np.zeros(len(n) and int((-(-blocks // 2)).sum()), np.uint32)
        blocks = -(-blocks // 2)
        first = np.cumsum(blocks) - blocks
        place = first[owner] + blocks[owner] - 1 - (back >> 1)
        folded[place[~odd]] = sums[~odd]
        folded[place[odd]] ^= _apply(_SHIFTS[level], sums[odd])
        owner = np.repeat(np.arange(len(n)), blocks)
        back = blocks[owner] - 1 - (np.arange(len(owner)) - first[owner])
        sums, level = folded, level + 1
    return ~sums


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated and shifted, so that checksums of data that hold checksums stay good."""
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


# --- ids -----------------------------------------------------------------------------------------------------------


class Ragged:
    """Lists of ids by 64-bit key, kept up to a number of keys."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(0, np.uint64)
        self.row = np.zeros(0, np.int64)
        self.start = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def rows(self, key: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is missing."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.row[at], -1)

    def add(self, key: np.ndarray, lists: list[list[int]]) -> None:
        """Add missing keys, given in ascending order."""
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))
        at = np.searchsorted(self.key, key)
        self.row = np.insert(self.row, at, len(self.start) - 1 + np.arange(len(key)))
        self.key = np.insert(self.key, at, key)
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, flat])

    def gather(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lists of the rows, end to end, and the size of each."""
        size = self.start[row + 1] - self.start[row]
        ahead = np.cumsum(size) - size
        return self.ids[np.repeat(self.start[row] - ahead, size) + np.arange(int(size.sum()))], size


_LEADS = np.isin(np.arange(256), [0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3])


def odd_space(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts with white space beyond the six plain characters, which cannot be cut into words independently."""
    at = np.flatnonzero(_LEADS[data])
    lead = data[at]
    second, third = (data[np.minimum(at + k, max(len(data) - 1, 0))] for k in (1, 2))
    hit = lead < 0x20
    hit |= (lead == 0xC2) & ((second == 0x85) | (second == 0xA0))
    hit |= (lead == 0xE1) & ((second == 0x9A) | (second == 0xA0))
    hit |= (lead == 0xE2) & ((second == 0x80) | (second == 0x81)) & (third >= 0x80)
    hit |= (lead == 0xE3) & (second == 0x80) & (third == 0x80)
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, at[hit], "right") - 1] = True
    return out


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the ranges that a byte-level BPE with the usual word pattern encodes independently.

    A word goes with one blank before it. Other white space stands alone: as one unit at the end of a text or before a
    blank, else its last character apart.
    """
    found = kernel.words(data, offsets)
    own = np.zeros(len(data) + 1, bool)
    own[offsets] = True
    blank = (found.start > 0) & ~own[found.start] & (data[np.maximum(found.start - 1, 0)] == 0x20)
    start = found.start - blank
    # gaps: from the end of a word or text start to the next unit or text end
    before = np.concatenate([found.end, offsets[:-1]])  # a word that ends where the next text starts comes first
    order = np.argsort(before, kind="stable")
    before = before[order]
    after = np.concatenate([start, offsets[1:]])
    after.sort()
    # text by text there is one gap more than words, so both lists pair up
    doc = np.concatenate([found.doc, np.arange(len(offsets) - 1)])[order]
    size = after - before
    last = after == offsets[doc + 1]
    plain = (size == 1) | last | (data[np.minimum(after, len(data) - 1)] == 0x20) if len(data) else size == 1
    whole = (size > 0) & plain
    parted = (size > 0) & ~plain
    starts = np.concatenate([start, before[whole], before[parted], after[parted] - 1])
    ends = np.concatenate([found.end, after[whole], after[parted] - 1, after[parted]])
    docs = np.concatenate([found.doc, doc[whole], doc[parted], doc[parted]])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order], docs[order]


class Encoder:
    """Encodes pieces of texts with a tokenizers file; remembers the ids of words."""

    def __init__(self, path: str, end_id: int, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        self.cache = Ragged(limit)
        # how a byte-level vocabulary writes bytes; words of Latin letters go to the model without the pattern
        settings = json.loads(self.tokenizer.to_str())
        self.added = [token["content"].encode() for token in settings["added_tokens"]]
        self.plain = settings["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4

    def lists(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def units(self, texts: list[str]) -> list[list[int]]:
        """Ids of single units; a blank, Latin letters and at most one full stop or comma need no pattern."""
        model, letters, out, other = self.tokenizer.model, self.letters, [], []
        for i, text in enumerate(texts):
            tail = text[-1] if text[-1] in ".," else ""
            word = text[:-1] if tail else text
            bare = word[1:] if word[:1] == " " else word
            if self.plain and bare.isalpha() and max(bare) < "\u0250":
                ids = [token.id for token in model.tokenize(word.encode().decode("latin-1").translate(letters))]
                if tail:
                    ids.append(model.token_to_id(tail))
                out.append(ids)
            else:
                out.append([])
                other.append(i)
        if other:
            for i, ids in zip(other, self.lists([texts[i] for i in other]), strict=True):
                out[i] = ids
        return out

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with the end id, and the number per text."""
        start, end, doc = units(data, offsets)
        key, first, where = np.unique(kernel.range_hash(kernel.prefix_hash(data), start, end), return_index=True, return_inverse=True)
        row = self.cache.rows(key)
        if (row < 0).any():
            if len(self.cache.key) + len(key) > self.cache.limit:
                self.cache.clear()
                row[:] = -1
            new = row < 0
            raw = data.tobytes()
            at = first[new]
            self.cache.add(key[new], self.units([raw[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]))
            row = self.cache.rows(key)
        flat, size = self.cache.gather(row[where])
        count = np.bincount(doc, size, len(offsets) - 1).astype(np.int64)
        odd = odd_space(data, offsets)
        whole = data.tobytes() if self.added else b""
        for content in self.added:  # white space before such a token ends like a text
            at = whole.find(content)
            while at >= 0:
                i = int(np.searchsorted(offsets, at, "right")) - 1
                odd[i] = True
                at = whole.find(content, int(offsets[i + 1]))
        if odd.any():  # these texts are encoded whole
            parts = np.split(flat, np.cumsum(count)[:-1])
            at = np.flatnonzero(odd)
            raw = [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in at]
            for i, ids in zip(at, self.lists(raw), strict=True):
                parts[i] = np.array(ids, np.uint32)
            count = np.fromiter(map(len, parts), np.int64, len(parts))
            flat = np.concatenate(parts)
        ids = np.insert(flat, np.cumsum(count), np.uint32(self.end_id))
        return ids, count + 1


def encoder(path: str, end_id: int) -> Encoder:
    """The encoder of this process; tasks that follow each other share what it remembers."""
    return kernel.keep(("encoder", path, end_id), lambda: Encoder(path, end_id))


# --- records -------------------------------------------------------------------------------------------------------


def frames(keys: list[int | None], ids: np.ndarray, count: np.ndarray, width: int) -> tuple[bytes, np.ndarray]:
    """Framed records and the size of each in bytes."""
    size = FRAME + count * width
    first = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    heads = np.zeros(len(keys), np.dtype([("length", "<u8"), ("crc", "<u4"), ("key", "<i8"), ("n", "<u4"), ("width", "<u2"), ("null", "<u2")]))
    heads["length"] = size - 16
    heads["key"] = [k or 0 for k in keys]
    heads["null"] = [k is None for k in keys]
    heads["n"], heads["width"] = count, width
    lengths = np.ascontiguousarray(heads["length"]).view(np.uint8)
    at = np.arange(len(keys)) * 8
    heads["crc"] = masked(crc32c(lengths, at, at + 8))
    out[first[:, None] + np.arange(heads.itemsize)] = heads.view(np.uint8).reshape(len(keys), -1)
    cells = out.view("<u2" if width == 2 else "<u4")  # a frame is a multiple of either width
    ahead = np.cumsum(count) - count
    cells[np.repeat((first + heads.itemsize) // width - ahead, count) + np.arange(len(ids))] = ids
    crc = masked(crc32c(out, first + 12, first + size - 4)).astype("<u4")
    out[(first + size - 4)[:, None] + np.arange(4)] = crc.view(np.uint8).reshape(-1, 4)
    return out.tobytes(), size


def parse(raw: np.ndarray, first: np.ndarray, size: np.ndarray, name: str = "") -> tuple[list[int | None], list[np.ndarray]]:
    """Keys and ids of whole records at the given ranges; raises if a checksum differs."""
    heads = np.ascontiguousarray(raw[first[:, None] + np.arange(12 + HEADER.size)]).view(
        np.dtype([("length", "<u8"), ("crc", "<u4"), ("key", "<i8"), ("n", "<u4"), ("width", "<u2"), ("null", "<u2")])
    )[:, 0]
    tails = np.ascontiguousarray(raw[(first + size - 4)[:, None] + np.arange(4)]).view("<u4")[:, 0]
    if (heads["length"].astype(np.int64) != size - 16).any():
        raise ValueError(f"{name}: a record's length does not fit")
    if (heads["crc"] != masked(crc32c(raw, first, first + 8))).any() or (tails != masked(crc32c(raw, first + 12, first + size - 4))).any():
        raise ValueError(f"{name}: a record's checksum does not fit")
    keys = [None if null else int(k) for k, null in zip(heads["key"], heads["null"], strict=True)]
    body = first + 12 + HEADER.size
    ids = [raw[a : a + n * w].view("<u2" if w == 2 else "<u4") for a, n, w in zip(body.tolist(), heads["n"].tolist(), heads["width"].tolist(), strict=True)]
    return keys, ids


def open_folder(address: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"file:/|/", address):
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", address)
    return pafs.FileSystem.from_uri(address)


@dataclass(frozen=True)
class Files:
    """A written folder; ``shards`` has (shard, records, ids, bytes) of every pair of files."""

    folder: str
    shards: DataFrame


def partitions(df: DataFrame, each: int = SHARD_BYTES) -> int:
    """Ranges to write, by the size of the table that the planner knows."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, min(-(-table_bytes(df) // each), 1_000_000))


def write(documents: DataFrame, tokenizer: str, folder: str | None = None, key: str = "doc_id", end_id: int = 0) -> Files:
    """Encode every text with the tokenizers file and write the records in ascending key order."""
    spark = documents.sparkSession
    folder = folder or new_folder(spark, "records")
    tie = F.xxhash64("text")
    rows = small_batches(documents).select(F.col(key).cast("long").alias("key"), "text")
    ordered = rows.repartitionByRange(partitions(documents), "key", tie).sortWithinPartitions("key", tie)

    @kernel.task
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next(batches, None)
        if batch is None:
            return
        encode = encoder(tokenizer, end_id)
        shard = TaskContext.get().partitionId()
        files, base = open_folder(folder)
        files.create_dir(base, recursive=True)
        own = f"{base}/.{uuid.uuid4().hex}"
        sizes, total_ids = [], 0
        with files.open_output_stream(own + ".rec") as out:
            while batch is not None:
                keys = batch.column("key").to_pylist()
                for a, b, data, offsets in kernel.pieces(kernel.as_text(batch.column("text"))):
                    ids, count = encode(data, offsets)
                    raw, size = frames(keys[a:b], ids, count, encode.width)
                    out.write(raw)
                    sizes.append(size)
                    total_ids += len(ids)
                batch = next(batches, None)
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        if not len(size):
            files.delete_file(own + ".rec")
            return
        with files.open_output_stream(own + ".idx") as out:
            out.write(np.concatenate([[0], np.cumsum(size)]).astype("<u8").tobytes())
        for kind in ("rec", "idx"):
            files.move(f"{own}.{kind}", f"{base}/part-{shard:05d}.{kind}")
        yield pa.RecordBatch.from_pylist([{"shard": shard, "records": len(size), "ids": total_ids, "bytes": int(size.sum())}])

    return Files(folder, stored(ordered.mapInArrow(written, "shard long, records long, ids long, bytes long"), "shards"))


def _each_shard(files: Files, use: Callable, schema: str, shards: DataFrame | None = None) -> DataFrame:
    """Run ``use`` (shard, folder, file system, further columns of ``shards``) over the shards, each read by one task."""
    folder = files.folder
    n = max(1, files.shards.count())

    @kernel.task
    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from use(shard, *open_folder(folder), *more)

    shards = files.shards.select("shard") if shards is None else shards
    return shards.repartition(min(n, 100_000), "shard").mapInArrow(opened, schema)


def _offsets(files: pafs.FileSystem, base: str, shard: int) -> np.ndarray:
    with files.open_input_stream(f"{base}/part-{shard:05d}.idx") as f:
        return np.frombuffer(f.read(), "<u8").astype(np.int64)


def _groups(files: pafs.FileSystem, base: str, shard: int) -> Iterator[tuple[int, list[int | None], list[np.ndarray]]]:
    """Records of one file in order, some MB at a time: first position, keys, ids."""
    at = _offsets(files, base, shard)
    name = f"{base}/part-{shard:05d}.rec"
    with files.open_input_stream(name) as f:
        i = 0
        while i < len(at) - 1:
            j = min(max(int(np.searchsorted(at, at[i] + (4 << 20), "right")) - 1, i + 1), len(at) - 1)
            raw = np.frombuffer(f.read(int(at[j] - at[i])), np.uint8)
            keys, ids = parse(raw, at[i:j] - at[i], at[i + 1 : j + 1] - at[i:j], name)
            yield i, keys, ids
            i = j


def read(files: Files) -> DataFrame:
    """(shard, position, key, ids) of every record, in order within each shard."""

    def use(shard: int, fs: pafs.FileSystem, base: str) -> Iterator[pa.RecordBatch]:
        for i, keys, ids in _groups(fs, base, shard):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * len(keys), pa.int32()),
                    pa.array(np.arange(i, i + len(keys))),
                    pa.array(keys, pa.int64()),
                    pa.array([x.tolist() for x in ids], pa.list_(pa.int32())),
                ],
                ["shard", "position", "key", "ids"],
            )

    return _each_shard(files, use, "shard int, position long, key long, ids array<int>")


def read_shuffled(files: Files, seed: int) -> DataFrame:
    """(shard, turn, key, ids): each shard's records in an order drawn from seed and shard, found by the index."""

    def use(shard: int, fs: pafs.FileSystem, base: str) -> Iterator[pa.RecordBatch]:
        at = _offsets(fs, base, shard)
        order = np.random.Generator(np.random.Philox(key=[seed, shard])).permutation(len(at) - 1)
        with fs.open_input_file(f"{base}/part-{shard:05d}.rec") as f:
            for turn, i in enumerate(order.tolist()):
                raw = np.frombuffer(f.read_at(int(at[i + 1] - at[i]), int(at[i])), np.uint8)
                keys, ids = parse(raw, np.zeros(1, np.int64), at[i + 1 : i + 2] - at[i], f"part-{shard:05d}.rec")
                yield pa.RecordBatch.from_pylist(
                    [{"shard": shard, "turn": turn, "key": keys[0], "ids": ids[0].tolist()}],
                    pa.schema([("shard", pa.int32()), ("turn", pa.int64()), ("key", pa.int64()), ("ids", pa.list_(pa.int32()))]),
                )

    return _each_shard(files, use, "shard int, turn long, key long, ids array<int>")


def digests(files: Files) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every record, from the files: ids before it over all shards, number of its
    ids, and the plain CRC-32 of its ids as uint32."""

    def use(shard: int, fs: pafs.FileSystem, base: str, before: int) -> Iterator[pa.RecordBatch]:
        for _, keys, ids in _groups(fs, base, shard):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array(before + np.cumsum(n) - n),
                    pa.array(n),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                ],
                ["key", "start", "n_tokens", "ids_crc32"],
            )
            before += int(n.sum())

    # a few numbers for each file
    bases = stored(running_total(files.shards.select("shard", "ids"), "ids", ["shard"], bucket=F.floor(F.col("shard") / 1024)).select("shard", "before"), "bases")
    return _each_shard(files, use, "key long, start long, n_tokens long, ids_crc32 long", bases)


def tokenizer_path(spark: SparkSession, name: str) -> str:
    """Place of a public tokenizer file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
