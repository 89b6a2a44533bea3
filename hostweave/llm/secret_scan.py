"""Secrets in texts: three fixed patterns, and a conditional random field that tags what looks like them.

Texts are cut into tokens (runs of letters and digits, and runs of other characters without white space). The field tags
each as secret begin, inside or outside from its shape, the tokens and words around it and features of the whole text.

It learns from fragments of texts around what the patterns find in the whole table, at most ``FRAGMENTS`` of them in hash
order. So that it learns secrets and not the patterns, each stands in the sample again: with other words before it
and a value drawn anew in another alphabet and length, and as a value of its own with a prefix or nothing before it. What is no secret comes from as many documents: a random place, the longest token, and a place where a long word, an
address, a date or a number was put in. Fitting reads the texts three times and brings fragments alone to the driver;
scanning is one pass without a shuffle. Of a span that touches the patterns' spans the parts outside them are added.

Defined cases: a null or empty text has no spans; repeated rows are scanned each; without any pattern match in the table
the field adds nothing. Only the id and text columns are read. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.llm import crf, kernel, sampling
from hostweave.llm.storage import small_batches

# Bound of what the field is fitted on: fragments around matches, and as many documents for the others.
FRAGMENTS = 2_000
# Tokens of a window, and bytes of a fragment on either side.
WINDOW = 24
MARGIN = 240
# Matches of a text that can be fragments, and most secrets that are drawn into the place of one.
MATCHES = 4
MOST_DRAWN = 60

KINDS = ("assign", "access", "hex", "field")
PATTERNS = (
    (re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I), 2, 6),
    (re.compile(rb"AKIA[A-Z0-9]+"), 0, 20),
    (re.compile(rb"[0-9a-f]+"), 0, 24),
)
HINTS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
# Words before a token that hint at a secret.
CONTEXT = (
    "password passwd pwd passphrase secret token key apikey api auth authorization bearer credential credentials access "
    "private signature session"
).split()

BEGIN, INSIDE, OUTSIDE = 0, 1, 2

_is = lambda characters: np.isin(np.arange(256), np.frombuffer(characters, np.uint8))
LOWER_CASE, UPPER_CASE, DIGIT = _is(bytes(range(97, 123))), _is(bytes(range(65, 91))), _is(b"0123456789")
HEX = DIGIT | _is(b"abcdef")
VOWEL = _is(b"aeiouyAEIOUY")
BEYOND = np.arange(256) >= 128
SOLID = LOWER_CASE | UPPER_CASE | DIGIT | BEYOND
CLASS = np.select([LOWER_CASE | BEYOND, UPPER_CASE, DIGIT], [1, 2, 3], 0)
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
WORD_VALUES = kernel.BYTE_VALUES[LOWERED]
MARK = np.zeros(256, np.int64)  # kinds of punctuation
for _k, _group in enumerate((b"=", b":", b"\"'", b"-_", b"+/", b".", b",;", b"@", b"()[]{}<>", b"#*$%&|"), 1):
    MARK[np.frombuffer(_group, np.uint8)] = _k
LENGTHS = np.array([2, 3, 4, 6, 8, 12, 16, 20, 24, 32, 40])
_CONTEXT = np.sort(np.array([kernel.hash_text(w, WORD_VALUES) for w in CONTEXT], np.uint64))

# Values that each slot of a token's features can take.
_N = len(LENGTHS) + 1
COARSE = np.array([6, 12, 16])
_C = len(COARSE) + 1
CHANGES = np.array([1, 2, 4, 7, 11])
_H = len(CHANGES) + 1
SLOTS = (16 * _N, 16 * _C, 5 * _C, 5 * _C, 5 * _C, 2 * _C, 12, 12, 6, 4, 16, 16, 4, 4, 4, 3, 2 * _C, 16 * _H, 5 * 16 * _C, 12 * 16)
FIRST = np.concatenate([[0], np.cumsum(SLOTS)])


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes of what the patterns find; a match that is too short is passed over."""
    return [(k, m.start(), m.end()) for k, (pattern, group, least) in enumerate(PATTERNS) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


def hinted(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts in which a pattern can match."""
    out = np.zeros(len(offsets) - 1, bool)
    start, end = kernel.runs(HEX[data], offsets)
    out[np.searchsorted(offsets, start[end - start >= 24], "right") - 1] = True
    raw = data.tobytes()
    for where, words in ((raw, (b"AKIA",)), (raw.lower(), HINTS)):
        for word in words:
            at = where.find(word)
            while at >= 0:
                i = int(np.searchsorted(offsets, at, "right")) - 1
                out[i] = True
                at = where.find(word, int(offsets[i + 1]))
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first token of each text): runs of solid characters and runs of marks."""
    solid = SOLID[data]
    start, end = kernel.runs(solid, offsets)
    more, more_end = kernel.runs(~solid & ~kernel.SPACE[data], offsets)
    start, end = np.concatenate([start, more]), np.concatenate([end, more_end])
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    return start, end, np.searchsorted(start, offsets, "left")


def _fifths(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.minimum(4, 5 * part // np.maximum(whole, 1))


def of_text(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features of each whole text: how common digits, signs of assignment and line ends are."""
    chars = np.maximum(np.diff(offsets), 1)
    per = lambda flags: kernel.count_in(flags, offsets[:-1], offsets[1:]) / chars
    return np.stack(
        [
            np.searchsorted([0.005, 0.03, 0.15], per(DIGIT[data])),
            np.searchsorted([0.0005, 0.003, 0.02], per((data == 0x3D) | (data == 0x3A))),
            np.searchsorted([0.002, 0.02], per(data == 0x0A)),
        ],
        1,
    )


def active(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Active feature of every token in every slot; ``whole`` has the features of the texts."""
    n = len(start)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    size = end - start
    length, coarse = np.searchsorted(LENGTHS, size, "right"), np.searchsorted(COARSE, size, "right")
    code = CLASS[data]
    lower, upper, digit = (kernel.count_in(code == c, start, end) for c in (1, 2, 3))
    marks = size - lower - upper - digit
    shape = (lower > 0) + 2 * (upper > 0) + 4 * (digit > 0) + 8 * (marks > 0)
    change = np.zeros(len(data), bool)
    change[1:] = code[1:] != code[:-1]
    changes = kernel.count_in(change, np.minimum(start + 1, end), end)
    head = MARK[data[start]] if n else np.zeros(0, np.int64)
    tail = MARK[data[end - 1]] if n else np.zeros(0, np.int64)
    kind = np.where(marks > 0, 1 + head, 0)
    ending = np.where(marks > 0, 1 + tail, 0)

    def moved(values: np.ndarray, by: int, none: int) -> np.ndarray:
        """The value ``by`` tokens before (after, if negative) in the same text."""
        out = np.full(n, none)
        if by > 0:
            same = doc[by:] == doc[:-by]
            out[by:][same] = values[:-by][same]
        else:
            same = doc[:by] == doc[-by:]
            out[:by][same] = values[-by:][same]
        return out

    word = kernel.range_hash(kernel.prefix_hash(data, WORD_VALUES), start, end)
    at = np.minimum(np.searchsorted(_CONTEXT, word), len(_CONTEXT) - 1)
    speaks = (_CONTEXT[at] == word).astype(int)
    near = np.select([moved(speaks, 1, 0) > 0, moved(speaks, 2, 0) > 0, moved(speaks, 3, 0) > 0, (moved(speaks, 4, 0) + moved(speaks, 5, 0)) > 0], [1, 2, 3, 4], 0)
    gap_before = np.where(start > 0, kernel.SPACE[data[np.maximum(start - 1, 0)]], True) if n else np.zeros(0, bool)
    gap_after = kernel.SPACE[data[np.minimum(end, len(data) - 1)]] if n else np.zeros(0, bool)
    long_near = np.minimum(3, np.maximum(moved(length, 1, 0), moved(length, -1, 0)) // 3)
    digits, equals, breaks = whole[doc].T
    slots = (
        shape * _N + length,
        shape * _C + coarse,
        _fifths(changes, size) * _C + coarse,
        _fifths(digit, size) * _C + coarse,
        _fifths(kernel.count_in(VOWEL[data], start, end), size) * _C + coarse,
        (kernel.count_in(HEX[data], start, end) == size) * _C + coarse,
        moved(ending, 1, 11),
        moved(kind, -1, 11),
        near,
        gap_before * 2 + gap_after,
        moved(shape, 1, 0),
        moved(shape, -1, 0),
        long_near,
        digits,
        equals,
        breaks,
        (kernel.count_in(BEYOND[data], start, end) > 0) * _C + coarse,
        shape * _H + np.searchsorted(CHANGES, changes, "right"),
        (near * 16 + shape) * _C + coarse,
        moved(ending, 1, 11) * 16 + shape,
    )
    return np.stack([np.minimum(s, SLOTS[i] - 1) + FIRST[i] for i, s in enumerate(slots)], 1).astype(np.int64)


def labelled(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Labels from the patterns: of an assignment its value is the secret."""
    out = np.full(len(start), OUTSIDE)
    for i in np.flatnonzero(hinted(data, offsets)):
        raw = data[offsets[i] : offsets[i + 1]].tobytes()
        for pattern, group, least in PATTERNS:
            for m in pattern.finditer(raw):
                a, b = m.start(group) + offsets[i], m.end(group) + offsets[i]
                if b - a >= least:
                    lo, hi = np.searchsorted(end, a, "right"), np.searchsorted(start, b, "left")
                    out[lo:hi] = INSIDE
                    out[lo : lo + 1] = BEGIN
    return out


def _key(h: int, i: int) -> int:
    """A hash for the i-th place of a text."""
    return int(kernel.mix(np.array([(h ^ (i * kernel.BASE)) & (2**64 - 1)], np.uint64)).view(np.int64)[0])


_FRAGMENT = "key long, text binary, start int, end int, span int, whole array<int>"


def _fragment(key: int, raw: bytes, start: int, end: int, span: int, whole: np.ndarray) -> dict:
    """The bytes around a place; ``start`` and ``end`` are counted in them, ``span`` is where a match as a whole begins."""
    a = max(0, span - MARGIN)
    while a and raw[a] & 0xC0 == 0x80:
        a -= 1
    b = min(len(raw), end + MARGIN)
    while b < len(raw) and raw[b] & 0xC0 == 0x80:
        b += 1
    return {"key": key, "text": raw[a:b], "start": start - a, "end": end - a, "span": span - a, "whole": whole.tolist()}


def _matches(texts: DataFrame, bound: int | None = None, keys_only: bool = False) -> DataFrame:
    """Fragments around the first matches of every text in (h, text) whose key is below ``bound``."""

    @kernel.task
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("h").to_numpy()
            out = []
            for a, _, data, offsets in kernel.pieces(kernel.as_text(batch.column("text"))):
                for i in np.flatnonzero(hinted(data, offsets)).tolist():  # few texts can have one
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    found = sorted((m.start(), m.start(group), m.end(group)) for pattern, group, least in PATTERNS for m in pattern.finditer(raw) if m.end(group) - m.start(group) >= least)
                    whole = None
                    for j, (span, start, end) in enumerate(found[:MATCHES]):
                        key = _key(int(hashes[a + i]), j)
                        if keys_only:
                            out.append({"key": key})
                        elif bound is None or key < bound:
                            whole = of_text(data[offsets[i] : offsets[i + 1]], np.array([0, len(raw)]))[0] if whole is None else whole
                            out.append(_fragment(key, raw, start, end, span, whole))
            if out:
                kind = pa.list_(pa.int32())
                fields = [("key", pa.int64()), ("text", pa.binary()), ("start", pa.int32()), ("end", pa.int32()), ("span", pa.int32()), ("whole", kind)]
                yield pa.RecordBatch.from_pylist(out, pa.schema(fields[:1] if keys_only else fields))

    return texts.mapInArrow(cut, "key long" if keys_only else _FRAGMENT)


def _others(texts: DataFrame) -> DataFrame:
    """Fragments around a drawn place and the longest token of every text in (h, text)."""

    @kernel.task
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("h").to_numpy()
            out = []
            for a, b, data, offsets in kernel.pieces(kernel.as_text(batch.column("text"))):
                start, end, first = tokens(data, offsets)
                whole = of_text(data, offsets)
                for i in range(b - a):
                    lo, hi = int(first[i]), int(first[i + 1])
                    if lo == hi:
                        continue
                    h = int(hashes[a + i])
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    for j, t in enumerate((lo + _key(h, 9) % (hi - lo), lo + int(np.argmax(end[lo:hi] - start[lo:hi])))):
                        x, y = int(start[t] - offsets[i]), int(end[t] - offsets[i])
                        out.append(_fragment(_key(h, j), raw, x, min(y, x + MARGIN), x, whole[i]))
            if out:
                kind = pa.list_(pa.int32())
                fields = [("key", pa.int64()), ("text", pa.binary()), ("start", pa.int32()), ("end", pa.int32()), ("span", pa.int32()), ("whole", kind)]
                yield pa.RecordBatch.from_pylist(out, pa.schema(fields))

    return texts.mapInArrow(cut, _FRAGMENT)


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Alphabets that values are drawn in, and what may stand before a value.
ALPHABETS = (_DIGITS + "abcdef", _DIGITS + "ABCDEF", _DIGITS + _LOWER, _DIGITS + _UPPER, _DIGITS + _LOWER + _UPPER, _DIGITS + _LOWER + _UPPER, _DIGITS + _LOWER + _UPPER + "-_", _DIGITS + _LOWER + _UPPER + "+/")
SIGNS = ("=", ": ", " = ", ":", " ", ' = "', "='", " is ")


def _drawn(rng: np.random.Generator, alphabet: str, n: int) -> str:
    return "".join(alphabet[k] for k in rng.integers(0, len(alphabet), n))


def _value(rng: np.random.Generator, least: int, most: int) -> str:
    """A value with letters and digits or in mixed case, of a length drawn evenly by its logarithm."""
    n = int(np.exp(rng.uniform(np.log(least), np.log(most + 1))))
    while True:
        value = _drawn(rng, ALPHABETS[rng.integers(len(ALPHABETS))], n)
        if any(c.isalpha() for c in value) and (any(c.isdigit() for c in value) or value[1:].lower() != value[1:] and value.upper() != value):
            return value


def _secret(rng: np.random.Generator, own: bool) -> tuple[str, str, str]:
    """What stands before a drawn secret, the secret, and what stands behind it."""
    if own:  # nothing but its prefix, if it has one, tells of it
        prefix = _drawn(rng, _LOWER, int(rng.integers(2, 5))) + "_-"[rng.integers(2)] if rng.random() < 0.4 else ""
        return "", prefix + _value(rng, 20, 64), ""
    word = CONTEXT[rng.integers(len(CONTEXT))]
    word = (word, word.upper(), word.capitalize(), f"my_{word}", f"{CONTEXT[rng.integers(len(CONTEXT))]} {word}")[rng.integers(5)]
    sign = SIGNS[rng.integers(len(SIGNS))]
    return word + sign, _value(rng, 16 if sign == " " or sign == " is " else 6, 48), sign[-1] if sign[-1] in "\"'" else ""


def _harmless(rng: np.random.Generator, words: list[str]) -> str:
    """A long word, an address, a date or a number that is no secret, some after words that often come before one."""
    some = [w for w in words if w.isalpha()] or ["word"]
    pick = lambda: some[rng.integers(len(some))]
    n = lambda k: _drawn(rng, _DIGITS, k)
    context = CONTEXT[rng.integers(len(CONTEXT))]
    made = (
        lambda: "".join(pick() for _ in range(int(rng.integers(2, 7)))),
        lambda: "-".join(pick() for _ in range(int(rng.integers(2, 5)))),
        lambda: "".join(pick().capitalize() for _ in range(int(rng.integers(2, 4)))) + n(int(rng.integers(0, 3))),
        lambda: f"https://{pick()}.{pick()}.com/{pick()}/{pick()}{n(3)}?{pick()}={n(5)}",
        lambda: f"{pick()}.{n(2)}@mail{n(1)}.{pick()}.com",
        lambda: f"/{pick()}/{pick()}_{n(2)}/{pick()}.txt",
        lambda: f"20{n(2)}-{n(2)}-{n(2)}T{n(2)}:{n(2)}:{n(2)}",
        lambda: n(int(rng.integers(4, 24))),
        lambda: f"+{n(2)} {n(3)}-{n(3)}-{n(4)}",
        lambda: f"v{n(1)}.{n(2)}.{n(1)}-{pick()}{n(1)}",
        lambda: f"{pick()}{n(int(rng.integers(1, 5)))}",
        lambda: f"#{_drawn(rng, ALPHABETS[0], 6)}",
        lambda: f"{context} {pick()}",
        lambda: f"{context}: {pick()} {pick()}",
        lambda: f"{context} = {n(int(rng.integers(1, 5)))}",
        lambda: "###" + pick() + "***",
        lambda: f"{pick().upper()} {pick()[:2].upper()}-{pick()[:2].upper()} {n(1)}.{n(1)}",
        lambda: pick().upper() * int(rng.integers(1, 4)),
    )
    return made[rng.integers(len(made))]()


def _training(fragments: list, secret: bool, drawn: int = 2) -> Iterator[tuple[bytes, int, int | None, int | None, list]]:
    """(text, place, start and end of a drawn secret, features of the text) of all windows of the fragments."""
    for f in fragments:
        text, start, end, span, whole = bytes(f.text), f.start, f.end, f.span, list(f.whole)
        yield text, start, None, None, whole
        rng = np.random.Generator(np.random.Philox(key=f.key & (2**64 - 1)))
        if secret:
            for k in range(drawn):
                before, value, behind = (v.encode() for v in _secret(rng, k % 2 == 1))
                # the rest of a quoted value's quotes goes as well
                rest = text[end:].lstrip(b"\"'") if text[end : end + 1] in (b'"', b"'") else text[end:]
                at = span + len(before)
                yield text[:span] + before + value + behind + rest, at, at, at + len(value), whole
        elif f.key & 1:
            put = _harmless(rng, text.decode("utf-8", "ignore").split()).encode()
            yield text[:start] + put + b" " + text[start:], start, None, None, whole


def _window(text: bytes, place: int, start: int | None, end: int | None, whole: list) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    a, b, first = tokens(data, offsets)
    label = labelled(data, offsets, a, b)
    if start is not None:
        lo, hi = np.searchsorted(b, start, "right"), np.searchsorted(a, end, "left")
        label[lo:hi] = INSIDE
        label[lo : lo + 1] = BEGIN
    x = active(data, offsets, a, b, first, np.array([whole]))
    t = max(0, int(np.searchsorted(b, place, "right")) - WINDOW // 2)
    return x[t : t + WINDOW], label[t : t + WINDOW]


def fit(documents: DataFrame, rows: int = FRAGMENTS) -> crf.Chain:
    """Fit on windows around ``rows`` matches in all documents and in as many documents besides, both in hash order."""
    texts = small_batches(documents).select("doc_id", "text")
    keys = sampling.smallest(texts, "doc_id", rows)
    # at most ``rows`` ids, one text of each
    sample = texts.join(F.broadcast(keys), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    # rows without an id are in the order of their texts
    every = texts.select(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")).alias("h"), "text")
    bound = sampling.hash_bound(_matches(every, keys_only=True), "key", rows)
    hits = _matches(every, bound).dropDuplicates(["key"]).orderBy("key").limit(rows).collect()
    if not hits:
        model = crf.Chain(np.zeros((int(FIRST[-1]), 3)), np.zeros((3, 3)))
        model.weights[:, OUTSIDE] = 1.0
        return model
    others = _others(sample.select(F.xxhash64("doc_id").alias("h"), "text")).orderBy("key").collect()
    # twice as many drawn secrets as documents, however few matches there are, but at most MOST_DRAWN of each
    drawn = max(2, min(MOST_DRAWN, 2 * rows // len(hits)))
    made = [_window(*w) for found, secret in ((hits, True), (others, False)) for w in _training(found, secret, drawn)]
    made = [m for m in made if len(m[1])]
    x = np.zeros((len(made), WINDOW, len(SLOTS)), np.int64)
    y = np.full((len(made), WINDOW), OUTSIDE)
    known = np.zeros((len(made), WINDOW), bool)
    for i, (xs, ys) in enumerate(made):
        x[i, : len(ys)], y[i, : len(ys)], known[i, : len(ys)] = xs, ys, True
    return crf.fit(x, y, known, int(FIRST[-1]), rounds=6, rate=0.15, ridge=1e-6, batches=24)


def field_spans(model: crf.Chain, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) in bytes of what the field tags."""
    start, end, first = tokens(data, offsets)
    label = crf.decode(model, model.emissions(active(data, offsets, start, end, first, of_text(data, offsets))), first)
    secret = label != OUTSIDE
    begins = np.zeros(len(label) + 1, bool)
    begins[first] = True
    opens, closes = secret.copy(), secret.copy()
    opens[1:] &= ~secret[:-1] | begins[1:-1] | (label[1:] == BEGIN)
    closes[:-1] &= ~secret[1:] | begins[1:-1] | (label[1:] == BEGIN)
    a, b = start[np.flatnonzero(opens)], end[np.flatnonzero(closes)]
    doc = np.searchsorted(offsets, a, "right") - 1
    joined = kernel.count_in(kernel.SPACE[data], a, b) == 0
    return doc[joined], a[joined], b[joined]


def outside(a: int, b: int, spans_: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a range that are in none of the spans."""
    parts = [(a, b)]
    for s, e in spans_:
        parts = [(c, d) for x, y in parts for c, d in ((x, min(y, s)), (max(x, e), y)) if c < d]
    return parts


def spans(model: crf.Chain, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """(kind, start, end) in bytes from each text's start, for texts that have any, by start and kind."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    for i in np.flatnonzero(hinted(data, offsets)).tolist():
        if found := base_spans(data[offsets[i] : offsets[i + 1]].tobytes()):
            out[i] = found
    for i, a, b in zip(*(v.tolist() for v in field_spans(model, data, offsets)), strict=True):
        base = [(s, e) for k, s, e in out.get(i, []) if k < 3]
        for c, d in outside(a - int(offsets[i]), b - int(offsets[i]), base):
            if SOLID[data[offsets[i] + c : offsets[i] + d]].any():
                out.setdefault(i, []).append((3, c, d))
    for found in out.values():
        found.sort(key=lambda s: (s[1], s[0], s[2]))
    return out


def _points(text: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans counted in code points."""
    ahead = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(k, int(ahead[a]), int(ahead[b])) for k, a, b in found]


def scan(documents: DataFrame, model: crf.Chain) -> DataFrame:
    """(doc_id, spans) of every row; spans are structs of kind, start and end."""

    @kernel.task
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for a, b, data, offsets in kernel.pieces(kernel.as_text(batch.column("text"))):
                by_text = spans(model, data, offsets)
                rows = [
                    [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in _points(data[offsets[i] : offsets[i + 1]].tobytes(), by_text[i])] if i in by_text else []
                    for i in range(b - a)
                ]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(rows, kind)], ["doc_id", "spans"])

    key = documents.schema["doc_id"].dataType.simpleString()
    return small_batches(documents).select("doc_id", "text").mapInArrow(found, f"doc_id {key}, spans array<struct<kind:string,start:int,end:int>>")


def masked(documents: DataFrame, model: crf.Chain) -> DataFrame:
    """All rows and columns of documents; every character of a secret is an asterisk."""

    @kernel.task
    def hidden(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.schema.get_field_index("text")
            changed: dict[int, str] = {}
            for a, _, data, offsets in kernel.pieces(kernel.as_text(batch.column("text"))):
                for i, found in spans(model, data, offsets).items():
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    text = list(raw.decode())
                    for _, s, e in _points(raw, found):
                        text[s:e] = "*" * (e - s)
                    changed[a + i] = "".join(text)
            if changed:
                where = np.zeros(batch.num_rows, bool)
                where[list(changed)] = True
                field = batch.schema.field(column)
                texts = pa.array([changed[i] for i in sorted(changed)], field.type)
                batch = batch.set_column(column, field, pc.replace_with_mask(batch.column(column), pa.array(where), texts))
            yield batch

    return small_batches(documents).mapInArrow(hidden, documents.schema)


def digest(spans_: str = "spans") -> dict:
    """Columns of the scan's summary: counts by pattern, the hash of the patterns' spans, and all spans as text."""
    base = F.filter(spans_, lambda s: s["kind"] != KINDS[-1])
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter(spans_, lambda s: s["kind"] == kind)).cast("long")
    return {
        "n_assign": count("assign"),
        "n_access": count("access"),
        "n_hex": count("hex"),
        "base_sha256": F.sha2(F.array_join(F.transform(base, line), ",").cast("binary"), 256),
        "spans": F.array_join(F.transform(spans_, line), ","),
    }
