import random
from collections import Counter

import pytest

from hostweave.llm import components
from hostweave.llm import ngram_join as J
from tests.llm.helpers import documents, prose, shingles


def near(a, b):
    return bool(a and b) and len(a & b) / len(a | b) >= 0.8


def plain(rows):
    """(doc_id, n_links, group members' smallest id, class size) of every row by looking at all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = Counter()
    for i in range(len(rows)):
        for j in range(i):
            if near(sets[i], sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    low = lambda ids: min((k for k in ids if k is not None), default=None)
    out = []
    for i, (k, _) in enumerate(rows):
        same = [r[0] for r, s in zip(rows, sets, strict=True) if s == sets[i]] if sets[i] else [k]
        out.append((k, low(same), len(same), links[i], low(groups[find(i)])))
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    found = []
    for base in range(25):
        words = prose(rng, rng.randrange(6, 150), 400).split()
        for _ in range(rng.choice([1, 1, 2, 5, 20])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(50)}"
            found.append(" ".join(copy))
        if base % 5 == 0:  # a chain: each near the next, the ends far apart
            for _ in range(8):
                words = words[len(words) // 40 + 1 :] + ["y"]
                found.append(" ".join(words))
    found += [None, "", " \n", None, "one", "one", "one two", "a b c d", "a  b\nc d", "a b c d e", prose(rng, 30_000, 9000)]
    rng.shuffle(found)
    return [*enumerate(found), (3, found[3]), (None, found[4]), (None, found[5]), (None, "one")]


@pytest.mark.parametrize("block", [300, 2])
def test_links_classes_and_groups(spark, rows, block, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_CLASSES", block)
    found = J.groups(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size, r.n_links, r.group_id) for r in found) == plain(rows)


def test_repeated_rows_give_one_set(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_CLASSES", 2)
    rng = random.Random(12)
    words = prose(rng, 60, 2000).split()
    same = " ".join(words)
    rows = [(None, same)] * 20 + [(7, same)] * 5 + [(8, same + " y"), (9, "y " + same)] + [(20 + i, prose(rng, 60, 2000)) for i in range(20)]
    seen = []
    real = J.verify
    monkeypatch.setattr(J, "verify", lambda units, threshold: seen.extend(units.select("bucket", "left", "right", "key").collect()) or real(units, threshold))
    found = J.groups(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size, r.n_links, r.group_id) for r in found) == plain(rows)
    assert seen and max(Counter((r.bucket, r.left, r.right, bytes(r.key)) for r in seen).values()) == 1


def test_one_of_each_group_stays(spark, rows):
    docs = documents(spark, rows)
    left = J.one_of_each(docs)
    assert left.schema.fieldNames() == docs.schema.fieldNames()
    sets = [shingles(r.text) for r in left.collect()]
    assert not any(near(a, b) for i, a in enumerate(sets) for b in sets[:i])
    without = sum(not shingles(t) for _, t in rows)
    groups = {(r.group_key) for r in J.groups(docs).collect() if r.group_key is not None}
    assert len(sets) == len(groups) + without


def test_band_shape_reaches_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, per = J.band_shape(threshold, 1e-4)
        assert bands * per <= J.MOST_HASHES and (1 - threshold**per) ** bands <= 1e-4
    assert J.band_shape(0.8, 1e-4) == (24, 5)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(50)] + [(500, 500 + i) for i in range(1, 80)]
    root = {v: v for e in edges for v in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found.get(v, v) == r for v, r in root.items())


def test_empty_table(spark):
    empty = documents(spark, [])
    assert J.groups(empty).count() == 0 and J.one_of_each(empty).count() == 0


def test_one_of_each_with_any_names_and_many_repeats(spark):
    from pyspark.sql import functions as F

    rng = random.Random(31)
    text = prose(rng, 60)
    rows = [(None, text)] * 30 + [(7, text + " more")] + [(i, prose(rng, 40)) for i in range(10, 30)] + [(None, "")] * 5 + [(40, "alone"), (40, "alone"), (None, None)]
    docs = documents(spark, rows)
    for name in ("_id", "_tag", "_stays", "_one_id", "id", "tag", "row", "stays", "nth", "rows", "group_key", "a b"):
        docs = docs.withColumn(name, F.lit(1))
    want = sorted(str(r) for r in {(7, text + " more"), (40, "alone")} | {r for r in rows if r[0] is not None and 10 <= r[0] < 30}) + sorted(str(r) for r in rows if not r[1])
    for hot_rows in (None, 3):
        made = J.one_of_each(docs, hot_rows=hot_rows)
        assert made.columns == docs.columns
        got = [(r.doc_id, r.text) for r in made.collect()]
        assert sorted(str(r) for r in got if r[1]) + sorted(str(r) for r in got if not r[1]) == want
