import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from hostweave.llm import periodic_runs as R
from tests.llm.helpers import WORD, documents, prose


def all_runs(words):
    """(start, length, period) by definition: for every start and period, as far as the period goes."""
    found = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def want(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    told = "".join(f"{s},{size},{q}\n" for s, size, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(told), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def sequences(rng):
    for _ in range(400):
        n, kinds = rng.randrange(120), rng.choice([1, 2, 2, 3, 5, 30])
        words = [rng.randrange(kinds) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = rng.randrange(1, n - a + 1)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        yield words
    yield [bin(i).count("1") % 2 for i in range(700)]  # no three copies side by side, and powers of two cancel out
    a, b = [0], [0, 1]
    while len(b) < 500:
        a, b = b, b + a
    yield b
    yield [x for i in range(200) for x in (i, i + 1)]  # falls apart from one end


def test_runs_of_short_sequences():
    rng = random.Random(2)
    all_words = list(sequences(rng))
    first = np.concatenate([[0], np.cumsum([len(w) for w in all_words])])
    found = R.find(np.array([x for w in all_words for x in w], np.int64), first)
    got = Counter(zip(found.start.tolist(), found.size.tolist(), found.period.tolist(), strict=True))
    assert got == Counter((int(f) + s, size, q) for f, w in zip(first, all_words, strict=False) for s, size, q in all_runs(w))


def test_segments_are_stable_and_hold_every_run(monkeypatch):
    """Whether all segments are looked at together or splits are followed up one by one, the result is the same."""
    rng = random.Random(3)
    for words in sequences(rng):
        w, first = np.array(words, np.int64), np.array([0, len(words)])
        wide = R.segments(w, first)
        with monkeypatch.context() as m:
            m.setattr(R, "WIDE_ROUNDS", 0)
            assert R.segments(w, first) == wide
        for a, b in wide:
            assert b - a >= 12 and min(Counter(words[a:b]).values()) >= 2
        assert all(any(a <= s and s + size <= b for a, b in wide) for s, size, _ in all_runs(words))


def test_a_segment_that_falls_apart_word_by_word():
    n = 100_000
    words = np.array([x for i in range(n // 2) for x in (i + 1, i)])  # the only single word is the second one
    assert R.segments(words, np.array([0, n])) == R.segments(words[::-1].copy(), np.array([0, n])) == []


def test_a_misleading_hash_costs_time_only(monkeypatch):
    rng = random.Random(4)
    words = np.array([rng.randrange(2) for _ in range(300)], np.int64)
    monkeypatch.setattr(R.Ranges, "reach", lambda self, x, y, most, back: most)
    found = R.find(words, np.array([0, 300]))
    assert list(zip(found.start.tolist(), found.size.tolist(), found.period.tolist(), strict=True)) == sorted(all_runs(words.tolist()), key=lambda r: (r[0], r[2]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    found = []
    for i in range(300):
        words = prose(rng, rng.randrange(150), 60).split()
        if i % 4 == 1 and words:
            part = words[: rng.randrange(1, 20)]
            words[5:5] = part * rng.randrange(2, 14)
        found.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    odd = [None, "", " \n", "é", "a " * 5000, "a b " * 6, "x" * 50_000, "a a " * 20, prose(rng, 6000, 40)]
    found += [(1000 + i, t) for i, t in enumerate(odd)]
    return [*found, found[1], found[1], (None, "null id " * 10)]


def test_digests(spark, rows):
    got = R.digests(documents(spark, rows), planted=True).collect()
    expected = [want(i, t) for i, t in rows]
    assert Counter(tuple(r) for r in got) == Counter(expected)
    assert sum(e[1] > 0 for e in expected) > 60


def test_collapsed(spark, rows):
    got = {r.key: r for r in R.collapsed(documents(spark, rows)).collect()}
    for i, text in rows:
        runs = all_runs(WORD.findall(text or "")) if len(text or "") < 3000 else None
        if runs is not None:
            assert sorted((r.start, r.length, r.period) for r in got[i].runs) == sorted(runs)
    assert got[1005].text == "a b" and got[1004].text == "a" and got[1000].text == ""


def test_small_chunks(spark, rows, monkeypatch):
    monkeypatch.setattr(R, "PAIRS", 50)
    for doc_id, text in rows[:60]:
        words = np.unique(np.array(["", *WORD.findall(text)]), return_inverse=True)[1][1:]
        found = R.find(words, np.array([0, len(words)]))
        assert sorted(zip(found.start.tolist(), found.size.tolist(), found.period.tolist(), strict=True)) == all_runs(words.tolist()), doc_id


def test_empty_table(spark):
    empty = documents(spark, [])
    assert R.digests(empty).count() == 0 and R.collapsed(empty).count() == 0
