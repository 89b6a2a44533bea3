import hashlib
import random
from collections import Counter

import pytest

from hostweave.llm import suffix_dedup as D
from hostweave.llm import suffix_runs as R
from tests.llm.helpers import documents, prose


def plain(rows, length=200):
    raws = [(t or "").encode() for _, t in rows]
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (k, _), r in zip(rows, raws, strict=True):
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((k, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    passage = [prose(rng, 70, 900) for _ in range(4)]
    texts = [None, "", "short", "x" * 199, "y" * 200, "z" * 201, "ab" * 400, "q" * 5000, "é" * 150, passage[0][:200], passage[0][:199], passage[1], passage[1]]
    for _ in range(60):
        part = rng.choice(passage)
        a = rng.randrange(0, 150)
        texts.append(prose(rng, rng.randrange(0, 60), 900) + rng.choice(["", " ", "\n"]) + part[a : a + rng.choice([150, 199, 200, 201, 250, 400])] + prose(rng, rng.randrange(0, 60), 900))
    near = prose(rng, 300, 900)
    for _ in range(25):
        at = rng.randrange(len(near))
        texts.append(near[:at] + "#" + near[at + 1 :])
    texts.append(prose(rng, 20_000, 900) + near)
    return [*enumerate(texts), (3, texts[3]), (20, texts[20]), (None, texts[21]), (None, None)]


@pytest.mark.parametrize("hot", [D.HOT_CONTEXTS, 3, 0])
def test_against_all_windows(spark, rows, hot):
    found = D.remove_repeats(documents(spark, rows), hot=hot).collect()
    assert Counter(tuple(r) for r in found) == plain(rows)


def test_long_texts_are_cut_into_segments(spark, rows, monkeypatch):
    monkeypatch.setattr(D, "SEGMENT", 300)
    monkeypatch.setattr(D.kernel.pieces, "__defaults__", (1000,))
    # only on the driver: the tasks' functions are looked at directly
    data, offsets = D.kernel.buffers(D.kernel.as_text(__import__("pyarrow").array([t for _, t in rows])))
    data = data[: offsets[-1]]
    starts = []
    for first, part, s in D._segments(data, offsets, 200):
        assert len(s) == 0 or s[-1] + 200 <= len(part)
        starts += (first + s).tolist()
    want = [i for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for i in range(a, b - 199)]
    assert starts == want


def test_kept_bytes(spark):
    text = prose(random.Random(1), 80, 900)
    found = {r.doc_id: r for r in D.remove_repeats(documents(spark, [(1, "A" + text), (2, text + "B"), (3, "own")]), keep=True).collect()}
    assert [bytes(found[i].kept) for i in (1, 2, 3)] == [b"A", b"B", b"own"]


def test_runs_and_merge():
    rng = random.Random(4)
    word = lambda: bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12)))
    for k in (1, 2, 3, 7):
        runs = [sorted((word(), bytes([i, j])) for j in range(rng.randrange(0, 30))) for i in range(k)]
        for run in runs:
            assert [(s, load) for _, s, load in R.decode_run(R.encode_run(run))] == run
        merged = list(R.merge_runs([R.encode_run(r) for r in runs]))
        assert [s for _, s, _ in merged] == sorted(s for r in runs for s, _ in r)
        assert Counter((s, load) for _, s, load in merged) == Counter(e for r in runs for e in r)
        for (_, a, _), (shared, b, _) in zip(merged, merged[1:], strict=False):
            assert shared == R.common_prefix(a, b)


def test_known_prefixes_are_not_compared_again(monkeypatch):
    looked = []
    whole = R.common_prefix

    def counting(a, b, known=0):
        n = whole(a, b, known)
        assert a[:known] == b[:known]
        looked.append(n - known)
        return n

    runs = [R.encode_run([(b"p" * 500 + bytes([c]), b"") for c in range(i, 200, 4)]) for i in range(4)]
    monkeypatch.setattr(R, "common_prefix", counting)
    assert len(list(R.merge_runs(runs))) == 200
    # the long prefix is looked at once for each pairing at the start, later only what comes after it
    assert sum(looked) < 6 * 500


def test_empty_table(spark):
    assert D.remove_repeats(documents(spark, [])).count() == 0
