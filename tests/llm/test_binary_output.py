import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hostweave.llm import binary_output as B
from hostweave.llm import kernel
from tests.llm.helpers import documents, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "b", " ", "  ", "\n", "\t", "é", "don't", "'s", "123", "!?", " ", "<|endoftext|>", "日本", "\x1c", "\r\n", "😀", " x", "word, ", "Naïve."]


def slow_crc(raw):
    c = 0xFFFFFFFF
    for x in raw:
        c ^= x
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_crc32c():
    assert slow_crc(b"123456789") == 0xE3069283
    data = np.frombuffer(random.Random(1).randbytes(3000), np.uint8)
    start, end = np.array([0, 10, 500, 0, 1000, 64]), np.array([4, 500, 2999, 3000, 1064, 129])
    assert B.crc32c(data, start, end).tolist() == [slow_crc(data[a:b].tobytes()) for a, b in zip(start, end, strict=True)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    found = [(i * 3, "".join(rng.choice(BITS) for _ in range(rng.randrange(25)))) for i in range(400)]
    found += [(5, None), (7, ""), (None, "no id"), (None, None), (8, "twice"), (8, "twice"), (8, "other"), (-4, "minus"), (11, prose(rng, 40_000))]
    rng.shuffle(found)
    return found


@pytest.fixture(scope="module")
def files(spark, rows):
    return B.write(documents(spark, rows), PATH)


def plain(rows):
    tokenizer = Tokenizer.from_file(PATH)
    return [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows]


def test_reads_back_what_the_library_encodes(files, rows):
    found = sorted(((r.key, r.ids) for r in B.read(files).collect()), key=repr)
    assert found == sorted(plain(rows), key=repr)


def test_digests(files, rows):
    found = sorted(B.digests(files).collect(), key=lambda r: r.start)
    keys = [r.key for r in found]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    start = 0
    for r in found:
        assert r.start == start
        start += r.n_tokens
    want = sorted((repr(i), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in plain(rows))
    assert sorted((repr(r.key), r.n_tokens, r.ids_crc32) for r in found) == want


def test_shuffled_reads(files, rows):
    a, b, c = ([(r.shard, r.turn, r.key, r.ids) for r in B.read_shuffled(files, seed).orderBy("shard", "turn").collect()] for seed in (1, 1, 2))
    assert a == b != c
    assert sorted(map(repr, (r[2:] for r in a))) == sorted(repr(x) for x in plain(rows))


def test_frames_on_disk(files):
    fs, base = B.open_folder(files.folder)
    shard = files.shards.first()
    with fs.open_input_stream(f"{base}/part-{shard.shard:05d}.rec") as f:
        raw = f.read()
    with fs.open_input_stream(f"{base}/part-{shard.shard:05d}.idx") as f:
        index = np.frombuffer(f.read(), "<u8")
    assert len(raw) == shard.bytes == index[-1] and len(index) == shard.records + 1
    mask = lambda c: ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF
    at = 0
    while at < len(raw):
        length, crc = struct.unpack_from("<QI", raw, at)
        assert at in index and crc == mask(slow_crc(raw[at : at + 8]))
        if length < 3000:
            assert struct.unpack_from("<I", raw, at + 12 + length)[0] == mask(slow_crc(raw[at + 12 : at + 12 + length]))
        at += 16 + length


def test_damage_is_found():
    raw, size = B.frames([1, None], np.array([5, 6, 7], np.uint32), np.array([2, 1]), 4)
    first = np.cumsum(size) - size
    keys, ids = B.parse(np.frombuffer(raw, np.uint8), first, size)
    assert keys == [1, None] and [i.tolist() for i in ids] == [[5, 6], [7]]
    for at in (0, 9, 13, 30, len(raw) - 1):
        bad = bytearray(raw)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            B.parse(np.frombuffer(bytes(bad), np.uint8), first, size)


def test_small_cache_gives_the_same():
    texts = ["".join(random.Random(i).choice(BITS) for _ in range(30)) for i in range(50)]
    data, offsets = kernel.buffers(kernel.as_text(__import__("pyarrow").array(texts)))
    data = data[: offsets[-1]]
    a, b = B.Encoder(PATH, 0), B.Encoder(PATH, 0, limit=4)
    for x, y in zip(a(data, offsets), b(data, offsets), strict=True):
        assert x.tolist() == y.tolist()
    assert b(data, offsets)[0].tolist() == a(data, offsets)[0].tolist()


def test_empty_table(spark):
    empty = B.write(documents(spark, []), PATH)
    assert empty.shards.count() == 0 and B.read(empty).count() == 0 and B.digests(empty).count() == 0
