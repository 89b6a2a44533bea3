"""Runs of words that repeat with a period, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q (words q apart are the same), at least max(12, 2q) long,
that no neighbouring word extends. All of them are found in two steps:

- Splitting. Every word of a run of two periods or more stands at least twice in it. So a word that stands once in the
  segment looked at is in no run, and splits the segment; the parts are split again until nothing changes. A word stands
  once if the places where it stands before and after lie outside. The first rounds look at all segments at once; then a
  split is followed up from its smaller part only, so that n words take at most n log n steps whatever their order.
- Scanning by lags. Where a run has period q, at least K = max(q, 12 - q) places in a row equal those q further on, so
  they cover a block of (K + 1) // 2 places that begins at a multiple of that. For every lag only those blocks are
  compared, by hashes of ranges, n log n of them for n words. Blocks that agree are extended to both sides by halving;
  what is long enough is compared word by word. Lags go from small to large, and blocks within a known run of a divisor
  of the lag are passed over. If a hash should ever have misled, all lags of the segment are compared plainly.

``planted`` rewrites a text's words from some place on as copies of the first p of them, chosen by the crc of its id.

Defined cases: a null or empty text has no words, no runs and the hash of nothing; a row without an id stays as it is;
texts of fewer than 12 words have no runs; repeated rows are looked at each; an empty table gives no rows. Only id and
text are read, so further columns may have any name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.llm import distinct, kernel
from hostweave.llm.storage import small_batches

# Least number of words in a run.
LEAST = 12
# Bytes of text looked at together, and comparisons made together.
PIECE_BYTES, PAIRS = 1 << 19, 1 << 19
# Rounds in which all segments are looked at together.
WIDE_ROUNDS = 6


@dataclass
class Runs:
    """Runs by start, then period: first word, number of words and period."""

    start: np.ndarray
    size: np.ndarray
    period: np.ndarray


def neighbours(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where each word stands before and after in its text; -1 and the number of all words if nowhere."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[order]
    same = (words[order][1:] == words[order][:-1]) & (text[1:] == text[:-1])
    before, after = np.full(n, -1), np.full(n, n)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def segments(words: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches within a text, of LEAST words at least, in which every word stands twice or more."""
    n = len(words)
    before, after = neighbours(words, first)
    places = np.arange(n)
    alive = np.ones(n, bool)
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    low = high = places
    for _ in range(WIDE_ROUNDS):
        start, end = _stretches(alive, edge)
        long = end - start >= LEAST
        start, end = start[long], end[long]
        keep = np.zeros(n, bool)
        at = distinct.ranges(start, end - start)
        low, high = np.repeat(start, end - start), np.repeat(end, end - start)
        keep[at] = (before[at] >= low) | (after[at] < high)
        if np.array_equal(keep, alive):
            return list(zip(start.tolist(), end.tolist(), strict=True))
        alive = keep
    start, end = _stretches(alive, edge)
    return _settled(before, after, [s for s in zip(start.tolist(), end.tolist(), strict=True) if s[1] - s[0] >= LEAST])


def _stretches(alive: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begins, ends = alive.copy(), alive.copy()
    begins[1:] &= ~alive[:-1] | edge[1:-1]
    ends[:-1] &= ~alive[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _settled(before: np.ndarray, after: np.ndarray, parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Split until stable. Only words of the smaller side of a split, and those next to them, can have become single."""
    out = []
    work = []
    for a, b in parts:
        work.append((a, b, (a + np.flatnonzero((before[a:b] < a) & (after[a:b] >= b))).tolist()))
    while work:
        a, b, single = work.pop()
        single = [x for x in single if a <= x < b and before[x] < a and after[x] >= b]
        if b - a < LEAST:
            continue
        if not single:
            out.append((a, b))
            continue
        x, rest = single[0], single[1:]
        small = (a, x) if x - a <= b - x - 1 else (x + 1, b)
        for i in range(*small):
            for j in (i, int(before[i]), int(after[i])):
                if a <= j < b and j != x:
                    lo, hi = (a, x) if j < x else (x + 1, b)
                    if before[j] < lo and after[j] >= hi:
                        rest.append(j)
        work.append((a, x, [j for j in rest if j < x]))
        work.append((x + 1, b, [j for j in rest if j > x]))
    return sorted(out)


class Ranges:
    """Tells whether ranges of words are equal.

    ``alike`` is quick and can be wrong where words are arranged as their powers of two cancel out; ``same`` counts modulo
    two primes and is wrong by chance alone, about once in 2**62 times.
    """

    def __init__(self, words: np.ndarray):
        values = kernel.mix(words.astype(np.uint64) + np.uint64(1))
        up, self.down = kernel.powers(len(words) + 1)
        self.quick = np.concatenate([np.zeros(1, np.uint64), np.cumsum((values | np.uint64(1)) * up[: len(words)])])
        self.exact = []
        for prime, base, shift in PRIMES:
            powers = _powers(prime, base, len(words) + 1)
            sums = np.cumsum((values >> np.uint64(shift)).astype(np.int64) % prime * powers[: len(words)] % prime)
            self.exact.append((prime, powers, np.concatenate([[0], sums])))

    def alike(self, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.quick[x + size] - self.quick[x]) * self.down[x] == (self.quick[y + size] - self.quick[y]) * self.down[y]

    def same(self, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For y behind x."""
        out = np.ones(len(x), bool)
        for prime, powers, sums in self.exact:
            out &= (sums[x + size] - sums[x]) % prime * powers[y - x] % prime == (sums[y + size] - sums[y]) % prime
        return out

    def reach(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many places from x and y on (before them, if ``back``) are equal, at most ``most``, by halving."""
        known, open_ = np.zeros_like(most), most.copy()
        while (known < open_).any():
            half = (known + open_ + 1) // 2
            same = self.same(x - half, y - half, half) if back else self.same(x, y, half)
            known = np.where(same, half, known)
            open_ = np.where(same, open_, half - 1)
        return known


# Two primes below 2**31, a base and the bits of a word's value for each.
PRIMES = ((2_147_483_647, 1_000_003, 2), (2_147_483_629, 998_244_353, 33))


def _powers(prime: int, base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), prime) % prime])
    return out[:n]


def _lag_groups(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(segment, lag) of all lags, from small to large, in groups of a bounded number of comparisons."""
    top = int(sizes.max()) // 2 if len(sizes) else 0
    lag = 1
    while lag <= top:
        there = np.flatnonzero(sizes >= 2 * lag)
        each = 2 * int(sizes[there].sum()) // max(lag, LEAST - lag) + len(there)
        n = max(1, min(PAIRS // max(each, 1), lag, top - lag + 1))  # lags at most double, so that runs found help the next
        lags = np.arange(lag, lag + n)
        segment, which = np.repeat(there, n), np.tile(lags, len(there))
        fits = sizes[segment] >= np.maximum(LEAST, 2 * which)
        yield segment[fits], which[fits]
        lag += n


def plain_runs(words: np.ndarray) -> set[tuple[int, int, int]]:
    """(start, end, period) of all runs, by comparing the words at every lag."""
    found: dict[tuple[int, int], int] = {}
    for lag in range(1, len(words) // 2 + 1):
        same = np.concatenate([[False], words[lag:] == words[:-lag], [False]])
        a, b = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:])
        for s, e in zip(a.tolist(), (b + lag).tolist(), strict=True):
            if e - s >= max(LEAST, 2 * lag):
                found.setdefault((s, e), lag)
    return {(s, e, q) for (s, e), q in found.items()}


def scan(words: np.ndarray, parts: list[tuple[int, int]]) -> Runs:
    """All runs in the given segments."""
    found: dict[tuple[int, int], int] = {}
    if parts:
        from_, to = np.array(parts).T
        ranges = Ranges(words)
        # the known run that reaches furthest over each place, and its period
        known_end, known_period = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)
        misled: set[int] = set()
        for segment, lag in _lag_groups(to - from_):
            block = (np.maximum(lag, LEAST - lag) + 1) // 2
            count = (to[segment] - from_[segment] - lag) // block
            for a, b in _chunks(count):
                n = count[a:b]
                s, q, w = (np.repeat(v[a:b], n) for v in (segment, lag, block))
                x = from_[s] + (np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)) * w
                hit = ranges.alike(x, x + q, w) & ~((known_end[x] >= x + q + w) & (q % known_period[x] == 0))
                s, q, x = s[hit], q[hit], x[hit]
                if not len(s):
                    continue
                left = ranges.reach(x, x + q, x - from_[s], True)
                right = ranges.reach(x, x + q, to[s] - x - q, False)
                start, end = x - left, x + q + right
                long = end - start >= np.maximum(LEAST, 2 * q)
                rows = np.unique(np.stack([start[long], end[long], q[long], s[long]], 1), axis=0)
                for i, e, k, part in sorted(rows.tolist(), key=lambda r: r[2]):
                    if (i, e) in found:
                        continue
                    lo, hi = int(from_[part]), int(to[part])
                    exact = np.array_equal(words[i : e - k], words[i + k : e]) and (i == lo or words[i - 1] != words[i + k - 1]) and (e == hi or words[e] != words[e - k])
                    if not exact:
                        misled.add(part)
                        continue
                    found[i, e] = k
                    further = known_end[i:e] < e
                    known_end[i:e][further], known_period[i:e][further] = e, k
        for part in misled:
            lo, hi = int(from_[part]), int(to[part])
            found = {r: q for r, q in found.items() if not lo <= r[0] < hi}
            found |= {(lo + s, lo + e): q for s, e, q in plain_runs(words[lo:hi])}
    rows = np.array(sorted((s, q, e - s) for (s, e), q in found.items()), np.int64).reshape(-1, 3)
    return Runs(rows[:, 0], rows[:, 2], rows[:, 1])


def _chunks(count: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose counts sum up to PAIRS or that are alone."""
    ends, a = np.cumsum(count), 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
        yield a, b
        a = b


def find(words: np.ndarray, first: np.ndarray) -> Runs:
    """All runs of many texts, whose words begin at ``first``; words are numbers."""
    return scan(words, segments(words, first))


def rewritten(doc_id: object, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a text of n words, if its id has it rewritten."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    return np.where(place < a, place, a + (place - a) % p)


@dataclass
class Collapsed:
    """Texts of a piece after rewriting: the words' numbers and bytes, their runs, and which words stay."""

    words: np.ndarray
    first: np.ndarray
    runs: Runs
    kept: np.ndarray
    data: np.ndarray  # every original word with a blank after it
    at: np.ndarray  # where they begin
    place: np.ndarray  # original word of each word

    def text(self, i: int) -> bytes:
        """The kept words of text i, joined by blanks."""
        a, b = int(self.first[i]), int(self.first[i + 1])
        place = self.place[a:b][self.kept[a:b]]
        if not len(place):
            return b""
        if place[-1] - place[0] == len(place) - 1 and (np.diff(place) == 1).all():
            return self.data[self.at[place[0]] : self.at[place[-1] + 1] - 1].tobytes()
        return self.data[distinct.ranges(self.at[place], self.at[place + 1] - self.at[place])][:-1].tobytes()


def collapse(keys: list, data: np.ndarray, offsets: np.ndarray, planted: bool) -> Collapsed:
    texts, first = distinct.words(data, offsets)
    words, _ = distinct.numbered(texts)
    place = np.arange(len(words))
    if planted:
        for i, key in enumerate(keys):
            new = rewritten(key, int(first[i + 1] - first[i]))
            if new is not None:
                place[first[i] : first[i + 1]] = first[i] + new
        words = words[place]
    runs = find(words, first)
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, runs.start + runs.period, 1)
    np.add.at(drop, runs.start + runs.size, -1)
    flat, size = np.frombuffer(texts.buffers()[2] or b"", np.uint8), np.diff(np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1])
    spaced = np.insert(flat[: int(size.sum())], np.cumsum(size), 0x20)
    return Collapsed(words, first, runs, np.cumsum(drop[:-1]) == 0, spaced, np.concatenate([[0], np.cumsum(size + 1)]), place)


def _table(documents: DataFrame, key: str, planted: bool, rows, schema: str) -> DataFrame:
    kind = documents.schema[key].dataType.simpleString()

    @kernel.task
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b, data, offsets in kernel.pieces(kernel.as_text(batch.column(1)), PIECE_BYTES):
                made = collapse(keys[a:b], data, offsets, planted)
                columns = rows(made, b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns.values()], ["key", *columns])

    return small_batches(documents).select(F.col(key).alias("key"), "text").mapInArrow(told, f"key {kind}, {schema}")


def collapsed(documents: DataFrame, key: str = "doc_id", planted: bool = False) -> DataFrame:
    """(key, runs, text) of every row: structs of start, length and period in words, and the words that stay."""

    def rows(made: Collapsed, n: int) -> dict[str, pa.Array]:
        each = np.searchsorted(made.runs.start, made.first)
        doc = np.repeat(np.arange(n), np.diff(each))
        fields = [pa.array(v, pa.int64()) for v in (made.runs.start - made.first[doc], made.runs.size, made.runs.period)]
        runs = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
        return {"runs": pa.ListArray.from_arrays(pa.array(each.astype(np.int32)), runs), "text": pa.array([made.text(i).decode() for i in range(n)], pa.string())}

    return _table(documents, key, planted, rows, "runs array<struct<start:long,length:long,period:long>>, text string")


def digests(documents: DataFrame, key: str = "doc_id", planted: bool = False) -> DataFrame:
    """Number of runs, the greatest run and hashes of all runs and of the collapsed text, for every row."""

    def rows(made: Collapsed, n: int) -> dict[str, pa.Array]:
        each = np.searchsorted(made.runs.start, made.first).tolist()
        first, start, size, period = made.first.tolist(), made.runs.start.tolist(), made.runs.size.tolist(), made.runs.period.tolist()
        best: list[tuple | None] = []
        hashes = []
        for i in range(n):
            own = [(start[r] - first[i], size[r], period[r]) for r in range(each[i], each[i + 1])]
            best.append(min(own, key=lambda r: (-r[1], r[0], r[2])) if own else None)
            hashes.append(hashlib.sha256("".join("%d,%d,%d\n" % r for r in own).encode()).hexdigest())
        column = lambda f: pa.array([None if r is None else f(r) for r in best], pa.int64())
        return {
            "n_runs": pa.array(np.diff(each).astype(np.int64)),
            "start": column(lambda r: r[0]),
            "length": column(lambda r: r[1]),
            "period": column(lambda r: r[2]),
            "exponent_milli": column(lambda r: 1000 * r[1] // r[2]),
            "runs_sha256": pa.array(hashes, pa.string()),
            "collapsed_sha256": pa.array([hashlib.sha256(made.text(i)).hexdigest() for i in range(n)], pa.string()),
        }

    return _table(documents, key, planted, rows, "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
