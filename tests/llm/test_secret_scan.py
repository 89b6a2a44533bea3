import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from hostweave.llm import crf
from hostweave.llm import secret_scan as S
from tests.llm.helpers import documents, prose

PLAIN = (
    ("assign", re.compile(r"""(?a:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
)


def plain(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, g, n) in enumerate(PLAIN) for m in p.finditer(text or "") if len(m.group(g)) >= n]
    return [f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found)]


def test_decode_is_the_best_labelling():
    rng = np.random.default_rng(2)
    for size in (1, 2, 5, 7):
        model = crf.Chain(np.zeros((1, 3)), rng.normal(size=(3, 3)))
        scores = rng.normal(size=(2 * size, 3)) * 3
        got = crf.decode(model, scores, np.array([0, size, 2 * size]))
        for a in (0, size):
            part = scores[a : a + size]
            value = lambda y, part=part, model=model: sum(part[i, c] for i, c in enumerate(y)) + sum(model.step[x, z] for x, z in itertools.pairwise(y))
            best = max(map(value, itertools.product(range(3), repeat=size)))
            assert value(got[a : a + size].tolist()) == pytest.approx(best)


def test_fit_follows_the_gradient():
    # the label of a token is that of its only feature, except after label 0, which label 1 always follows
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (200, 8, 1))
    y = x[:, :, 0].copy()
    for t in range(1, 8):
        y[:, t] = np.where(y[:, t - 1] == 0, 1, y[:, t])
    model = crf.fit(x, y, np.ones((200, 8), bool), 3)
    flat = x.reshape(-1, 1)
    got = crf.decode(model, model.emissions(flat), np.arange(0, 1601, 8)).reshape(200, 8)
    assert (got == y).mean() > 0.98


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    made = [
        lambda: f'token = "{hexed(40)}"',
        lambda: f"password={hexed(18)}",
        lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)),
        lambda: f"API_KEY: '{hexed(30)}'",
    ]
    found = []
    for i in range(600):
        words = prose(rng, 60, 2000).split()
        if i % 3 == 0:
            words.insert(rng.randrange(60), rng.choice(made)())
        found.append((i, " ".join(words) + "é"))
    odd = [
        None, "", " ", "token=abc", "secret=token:abcdefgh", "éé Secret =  'abcdef", "TOKEN:api-key: x", "AKIA123 AKIAAKIA" + "A" * 20, "a" * 23 + " " + "b" * 24,
        "passwordpassword=1234567", "token='\"abcdefg", "ſecret=abcdefgh", "toKen=abcdefgh", "deadbeef" * 40_000, 'x"token" : "abcdef"', "apikey=a_b.c-d\napi_key=======",
    ]
    found += [(1000 + i, t) for i, t in enumerate(odd)]
    found += [found[0], (None, "password=nullid99")]
    return found


@pytest.fixture(scope="module")
def model(spark, rows):
    return S.fit(documents(spark, rows))


def test_patterns_and_order(spark, rows, model):
    found = S.scan(documents(spark, rows), model)
    result = found.select("doc_id", *[c.alias(n) for n, c in S.digest().items()]).collect()
    want = Counter((i, ",".join(plain(t)), hashlib.sha256(",".join(plain(t)).encode()).hexdigest()) for i, t in rows)
    base = lambda r: ",".join(s for s in r.spans.split(",") if s and not s.startswith("field"))
    assert Counter((r.doc_id, base(r), r.base_sha256) for r in result) == want
    for r in result:
        kinds = Counter(s.split(":")[0] for s in r.spans.split(",") if s)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])


def test_the_field_finds_others_and_leaves_prose(spark, model):
    rng = random.Random(9)
    hexed = "".join(rng.choice("0123456789abcdef") for _ in range(22))
    docs = documents(spark, [(i, prose(rng, 200, 5000)) for i in range(40)] + [(100, f"some words pwd={hexed} and more words"), (101, f'so secret_key = "{hexed[:20]}" is')])
    found = {r.doc_id: r.spans for r in S.scan(docs, model).collect()}
    assert all(not found[i] for i in range(40))
    assert [(s.kind, s.start, s.end) for s in found[100]] == [("field", 15, 15 + 22)]
    assert [(s.kind, s.start, s.end) for s in found[101]] == [("field", 17, 17 + 20)]


def test_masked(spark, rows, model):
    docs = documents(spark, rows)
    made = S.masked(docs, model)
    assert made.schema == docs.schema
    by_id = {r.doc_id: r.text for r in made.collect()}
    spans = {r.doc_id: r.spans for r in S.scan(docs, model).collect()}
    for i, text in rows:
        want = None if text is None else list(text)
        for s in spans[i]:
            want[s.start : s.end] = "*" * (s.end - s.start)
        assert by_id[i] == (None if want is None else "".join(want))


def test_matches_outside_the_sample_are_learnt(spark, rows):
    from pyspark.sql import functions as F

    rng = random.Random(10)
    plain_rows = [(i, prose(rng, 60, 2000)) for i in range(300)]
    order = [r.doc_id for r in documents(spark, plain_rows).orderBy(F.xxhash64("doc_id")).collect()]
    # the first 60 documents in hash order have no match, the others have those of ``rows``
    texts = iter(t for i, t in rows if i is not None and i < 600 and i % 3 == 0)
    docs = documents(spark, [(i, plain_rows[i][1] if k < 60 else next(texts)) for k, i in enumerate(order[:240])])
    model = S.fit(docs, rows=60)
    hexed = "".join(rng.choice("0123456789abcdef") for _ in range(22))
    found = S.scan(documents(spark, [(1, f"some words pwd={hexed} and more words")]), model).first().spans
    assert [(s.kind, s.start, s.end) for s in found] == [("field", 15, 15 + 22)]


def test_without_examples(spark):
    docs = documents(spark, [(1, "plain words only"), (2, None)])
    assert {tuple(r.spans) for r in S.scan(docs, S.fit(docs)).collect()} == {()}
    empty = documents(spark, [])
    assert S.scan(empty, S.fit(empty)).count() == 0


def planted(rng, form):
    """What stands before a secret that no pattern finds, and the secret."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    drawn = lambda n: "".join(rng.choice(letters) for _ in range(n))
    return {"bearer": ("Authorization: Bearer ", drawn(40)), "bare": ("", drawn(32)), "prefix": ("", "ghp_" + drawn(36)), "short": ("pwd=", drawn(8))}[form]


@pytest.mark.parametrize("form,least", [("bearer", 0.9), ("bare", 0.9), ("prefix", 0.9), ("short", 0.6)])
def test_forms_unlike_those_it_has_seen(spark, form, least):
    """All that the table has are ``token = "..."`` with hexadecimal values; the field finds others and leaves prose alone."""
    rng = random.Random(12)
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(1500):
        words = prose(rng, 80, 3000).split()
        if i % 10 == 0:
            words.insert(rng.randrange(80), f'token = "{hexed(40)}"')
        if i % 7 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["see https://ba.example.com/a/b1?x=22", "mail ba.12@mail.example.com", "0123456789012345", "+49 123-456-7890"]))
        rows.append((i, " ".join(words)))
    model = S.fit(documents(spark, rows))
    texts, want = [], {}
    for i in range(80):
        words = prose(rng, 60, 3000).split()
        before, secret = planted(rng, form)
        head = " ".join(words[: rng.randrange(61)])
        lead = f"{head} {before}" if head else before
        texts.append((i, f"{lead}{secret} {' '.join(words)}"))
        want[i] = (len(lead), len(lead) + len(secret))
    got = {r.doc_id: r.spans for r in S.scan(documents(spark, texts), model).collect()}
    found = sum(any(s.kind == "field" and s.start < b and s.end > a for s in got[i]) for i, (a, b) in want.items())
    assert found >= least * 80
    clean = S.scan(documents(spark, [(i, prose(rng, 80, 3000)) for i in range(2000)]), model).collect()
    assert sum(any(s.kind == "field" for s in r.spans) for r in clean) <= 2


def test_parts_beyond_the_patterns_spans():
    assert S.outside(5, 20, []) == [(5, 20)]
    assert S.outside(5, 20, [(7, 10), (12, 30)]) == [(5, 7), (10, 12)]
    assert S.outside(5, 20, [(0, 40)]) == [] and S.outside(5, 20, [(20, 30), (0, 5)]) == [(5, 20)]


def test_few_fragments_move(spark, rows):
    """However many matches there are, about as many as asked for leave the tasks, and one row of equal ones."""
    from hostweave.llm import sampling

    texts = documents(spark, [(i, f"words token={i:024x} and more") for i in range(5000)] + [(None, "token=aaaaaaaa")] * 500)
    from pyspark.sql import functions as F

    every = texts.select(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")).alias("h"), "text")
    bound = sampling.hash_bound(S._matches(every, keys_only=True), "key", 50)
    assert 50 <= S._matches(every, bound).select("key").distinct().count() <= 200
    assert sampling.smallest(texts, "doc_id", 40).collect() == texts.select("doc_id").distinct().where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id")).limit(40).collect()
    assert sampling.smallest(texts, "doc_id", 10_000).count() == 5000
