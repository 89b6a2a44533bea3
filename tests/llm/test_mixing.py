import random
from collections import defaultdict

import pytest

from hostweave.llm import mixing as M
from tests.llm.helpers import WORD, documents, prose


def fill(sizes, weights, epochs=3):
    """Targets by clamping and resharing, source by source."""
    total, clamped = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in clamped]
        left = total - sum(clamped.values())
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > epochs * sizes[s]]
        if not over:
            return clamped | share
        clamped |= {s: float(epochs * sizes[s]) for s in over}


def run(spark, rows):
    found = M.mix(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    return found, sizes, fill(sizes, weights) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    found = []
    for i in range(1500):
        source = rng.choice(["big"] * 12 + ["ä", "b", None, "z", "", "Z", "tiny"] + ["a'"])
        found.append((i, prose(rng, rng.randrange(1, 60 if source != "tiny" else 3)), source))
    found += [(5000, None, "b"), (5001, "", "empty"), (3, found[3][1], found[3][2]), (6000, "x " * 30_000, "big"), (None, "no id here", "z"), (None, "no", "z")]
    return found


def test_targets_and_taken_words(spark, rows):
    found, sizes, want = run(spark, rows)
    by_source = {sizes[s]: want[s] for s in sizes}  # sizes differ
    assert len(by_source) == len(sizes)
    taken = defaultdict(int)
    largest = defaultdict(int)
    for r in found:
        assert r.target == pytest.approx(by_source[r.source_size])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source_size] += r.taken
        largest[r.source_size] = max(largest[r.source_size], r.size)
    for size, target in by_source.items():
        assert abs(taken[size] - target) <= largest[size]


def test_reruns_agree(spark, rows):
    a, b = (sorted(M.mix(documents(spark, order)).collect(), key=repr) for order in (rows, rows[::-1]))
    assert a == b


def test_repeated_documents(spark, rows):
    docs = documents(spark, rows)
    made = M.repeated(docs)
    assert made.schema.fieldNames() == docs.schema.fieldNames()
    assert made.where("text IS NOT NULL").selectExpr(r"sum(regexp_count(text, '[^\\x20\\x09-\\x0D]+'))").first()[0] == sum(r.taken for r in M.mix(docs).collect())


@pytest.mark.parametrize("rows", [[], [(1, None, "a"), (2, "", None)], [(1, "one", "a")], [(1, "one two", None), (1, "one two", None)]])
def test_small_tables(spark, rows):
    found, _, want = run(spark, rows)
    assert sorted(r.target for r in found) == sorted(want[r[2]] for r in rows)


def test_shared_ids_keep_targets(spark):
    """A third of all ids null, and a third of the rows equal in everything: every source is near its target."""
    rng = random.Random(21)
    rows = []
    for i in range(3000):
        source = rng.choice("abcd")
        rows.append((None if i % 3 == 0 else i, "same words for all of these rows" if i % 3 == 1 else prose(rng, rng.randrange(1, 30)), source))
        if i % 3 == 1:
            rows[-1] = (None, *rows[-1][1:])
    found, sizes, want = run(spark, rows)
    by_source = {sizes[s]: want[s] for s in sizes}
    assert len(by_source) == len(sizes)
    taken = defaultdict(int)
    for r in found:
        taken[r.source_size] += r.taken
    for size, target in by_source.items():
        assert abs(taken[size] - target) <= 0.01 * target
    docs = documents(spark, rows)
    words = defaultdict(int)
    for r in M.repeated(docs).select("source", "text").collect():
        words[r.source] += len(WORD.findall(r.text or ""))
    assert words == {s: taken[sizes[s]] for s in sizes}
    assert sorted(map(str, M.mix(docs).collect())) == sorted(map(str, found))


def test_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    docs = documents(spark, [(i % 5, "some words", "ab"[i % 2]) for i in range(20)])
    for name in ("_mix_key", "from", "row", "edge", "copies", "_n", "whole", "part", "place", "last", "a b"):
        docs = docs.withColumn(name, F.lit(1))
    made = M.repeated(docs)
    assert made.dtypes == docs.dtypes and made.count() == sum(r.taken // 2 for r in M.mix(docs).collect())
