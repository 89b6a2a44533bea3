import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece

from hostweave.llm import kernel
from hostweave.llm import sentencepiece_sampling as S
from tests.llm.helpers import documents, prose

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["the cat", "", None, "é日\n x", "aaa", "  two  spaces ", "a", "\n\n", "\t", "naïve café 日本語 😀", "▁", "x" * 3000, "\x00", "a b"]


@pytest.fixture(scope="module")
def sampler():
    return S.Sampler(MODEL, 3)


def every(pieces, word):
    """All segmentations of a short word and their log-probabilities."""
    raw, out = (" " + word).encode(), []
    by_text = defaultdict(list)
    for i, text in enumerate(pieces.text):
        if text and not pieces.processor.is_byte(i):
            by_text[text].append(i)

    def go(at, ids, log):
        if at == len(raw):
            out.append((tuple(ids), log))
        for end in range(at + 1, len(raw) + 1):
            for i in by_text[raw[at:end]]:
                go(end, [*ids, i], log + float(pieces.weight[i]))

    go(0, [], 0.0)
    total = math.log(sum(math.exp(v) for _, v in out))
    return {ids: v - total for ids, v in out}


def draw(sampler, texts, seeds):
    out = []
    for a, b, data, offsets in kernel.pieces(kernel.as_text(pa.array(texts, pa.string()))):
        for rank, (which, ids, count, log, value, inclusion) in enumerate(S._drawn(sampler, data, offsets, seeds[a:b])):
            cut = np.concatenate([[0], np.cumsum(count)])
            out += [(a + int(t), rank, tuple(ids[s:e].tolist()), float(x), float(v), float(q)) for t, s, e, x, v, q in zip(which, cut[:-1], cut[1:], log, value, inclusion, strict=True)]
    return out


def test_samples_are_distinct_ordered_and_decode(sampler):
    found = defaultdict(list)
    for t, _, ids, log, value, inclusion in draw(sampler, TEXTS, np.arange(len(TEXTS)).astype(np.uint64)):
        found[t].append((ids, value))
        assert bytes(sampler.pieces.decode(np.array(ids, np.int64))[1:]).decode() == (TEXTS[t] or "")
        assert log <= 1e-6 and inclusion <= 1e-9
    assert set(found) == set(range(len(TEXTS)))
    for t, samples in found.items():
        ids, values = zip(*samples, strict=True)
        assert len(set(ids)) == len(ids) and list(values) == sorted(values, reverse=True)
    assert len(found[1]) == len(found[2]) == 1 and len(found[0]) == 3


def test_probabilities_against_enumeration(sampler):
    exact = every(sampler.pieces, "onee")
    n = 30_000
    found = draw(sampler, ["onee"] * n, kernel.mix(np.arange(n).astype(np.uint64)))
    first, second = (Counter(ids for _, r, ids, *_ in found if r == rank) for rank in (0, 1))
    for _, _, ids, log, *_ in found[:200]:
        assert log == pytest.approx(exact[ids], abs=1e-3)
    p = {ids: math.exp(v) for ids, v in exact.items()}
    q = {j: sum(p[i] * p[j] / (1 - p[i]) for i in p if i != j) for j in p}
    for want, got in ((p, first), (q, second)):
        for ids, x in want.items():
            assert abs(got[ids] / n - x) <= 5 * math.sqrt(x * (1 - x) / n) + 1e-3


def test_inclusion_scores_are_unbiased(sampler):
    # the sum of probability / inclusion over the drawn has the mean 1
    n = 20_000
    total = sum(math.exp(log - q) for _, r, _, log, _, q in draw(sampler, ["onee"] * n, kernel.mix(np.arange(7, n + 7).astype(np.uint64))))
    assert total / n == pytest.approx(1, abs=0.05)


def test_the_batch_does_not_matter(sampler):
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(1, 80)) for _ in range(40)]
    seeds = kernel.mix(np.arange(40).astype(np.uint64))
    whole = draw(sampler, texts, seeds)
    alone = [(i, *r[1:]) for i, t in enumerate(texts) for r in draw(S.Sampler(MODEL, 3) if i < 2 else sampler, [t], seeds[i : i + 1])]
    assert sorted(whole) == sorted(alone)


def test_small_cache_gives_the_same(sampler):
    texts = [prose(random.Random(i), 10) for i in range(20)]
    seeds = np.arange(20).astype(np.uint64)
    other = S.Sampler(MODEL, 3)
    other.lattices.most_words = 3
    assert draw(other, texts[:10], seeds[:10]) + [(t + 10, *r) for t, *r in draw(other, texts[10:], seeds[10:])] == draw(sampler, texts[:10], seeds[:10]) + [
        (t + 10, *r) for t, *r in draw(sampler, texts[10:], seeds[10:])
    ]


def test_tables(spark):
    rows = [*enumerate(TEXTS), (0, TEXTS[0]), (None, "no id"), (99, prose(random.Random(1), 20_000))]
    docs = documents(spark, rows)
    made = S.sample(docs, MODEL, 2).collect()
    again = S.sample(docs.repartition(3), MODEL, 2).collect()
    key = lambda r: (repr(r.key), r.sample, r.ids)
    assert sorted(made, key=key) == sorted(again, key=key)
    digest = sorted((repr(r.key), r.sample, r.n_pieces, r.ids_crc32, r.round_trip) for r in S.digests(docs, MODEL, 2).collect())
    assert digest == sorted((repr(r.key), r.sample, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()), True) for r in made)
    assert S.sample(documents(spark, []), MODEL).count() == 0


def test_encode_and_decode(spark):
    texts = [t for t in TEXTS if t != "▁"]  # the model itself reads this sign as a blank
    docs = documents(spark, list(enumerate(texts)))
    encoded = S.encode(docs, MODEL)
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert {r.key: r.ids for r in encoded.collect()} == {i: processor.encode(t or "") for i, t in enumerate(texts)}
    decoded = {r.key: r.decoded for r in S.decode(encoded, MODEL).collect()}
    assert decoded == {i: t or "" for i, t in enumerate(texts)}


def test_own_segmentations_are_in_the_lattice(sampler):
    for word in ("cats", "onee", "there"):
        assert tuple(sampler.pieces.processor.encode(word)) in every(sampler.pieces, word)
