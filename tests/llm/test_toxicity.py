import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostweave.llm import boosting, queries, toxicity
from tests.llm.helpers import documents, prose


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = boosting.fit_trees(x[:3000], y[:3000])
    assert ((model.margin(x[3000:]) > 0) == y[3000:]).mean() > 0.95


def test_trees_of_one_label_are_constant():
    model = boosting.fit_trees(np.zeros((5, 2)), np.ones(5))
    assert len(set(model.margin(np.random.rand(4, 2)))) == 1
    assert boosting.fit_trees(np.zeros((0, 2)), np.zeros(0)).margin(np.zeros((2, 2))).shape == (2,)


def test_isotonic_is_monotone_and_pools_violators():
    scale = boosting.fit_isotonic(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0]))
    values = scale(np.array([0.0, 1.0, 2.0, 3.0, 4.0, 9.0]))
    assert (np.diff(values) >= 0).all() and values[2] == values[3]
    assert 0 < values[0] and values[-1] < 1


def test_held_out_labels(spark):
    data = "/root/testdata/sf0.1"
    found = queries.op1_toxicity(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("held_out")
    counts = {(r[0], r[1]): r[2] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert counts.get((0, 1), 0) <= 0.01 * counts[(0, 0)]  # clean ones stay
    assert counts[(1, 1)] >= 0.7 * (counts[(1, 1)] + counts.get((1, 0), 0))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 4 == 0
        words = prose(rng, 40).split()
        for at in rng.sample(range(40), 3 if bad else 0):
            words[at] = rng.choice(["idiot", "MORON!", "m0ron", "you scum"])
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(bad)))
    rows += [(2000, None), (2001, ""), (2002, "w1 " * 60_000), (None, "idiot you idiot"), (0, rows[0][1])]
    labels += [(0, 0, None), (None, 0, 1), (9999, 0, 1), (1, 0, 7)]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_cases(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 for r in rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert len(by_id[0]) == 1  # repeated rows
    assert by_id[2000] == by_id[2001]  # null is empty
    wrong = sum((max(by_id[i]) >= 0.5) != (i % 4 == 0) for i in range(1500))
    assert wrong <= 15
    assert max(by_id[None]) >= 0.5
    kept = toxicity.accepted(docs, model)
    assert kept.schema == docs.schema
    assert kept.count() == sum(r.score < 0.5 for r in rows)


def test_labels_of_held_out_documents_are_not_read(spark, labelled):
    docs, labels = labelled
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.score(docs, toxicity.fit(docs, lab)).orderBy("doc_id", "score").collect() for lab in (labels, turned))
    assert a == b


def test_without_labels(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, model).collect()} <= {0.5} or len({r.score for r in toxicity.score(docs, model).collect()}) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_a_labelled_id_on_very_many_rows(spark, labelled):
    """An id counts once in what is learnt, however many rows have it."""
    docs, labels = labelled
    row = docs.where("doc_id = 4").limit(1)
    many = docs.unionByName(row.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(100_000)))).drop("k"))
    taken = toxicity.training_rows(many, labels)
    assert taken.count() == taken.select("doc_id").distinct().count() == toxicity.training_rows(docs, labels).count()
    small = toxicity.training_rows(many, labels, 100).select("doc_id").collect()
    assert 98 <= len(small) <= 100  # a label without a document may be among them


def test_held_out_is_never_null(spark):
    df = spark.createDataFrame([(None,), (5,), (6,)], "doc_id long").select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h"))
    import zlib

    assert {r.doc_id: r.h for r in df.collect()} == {None: False} | {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in (5, 6)}
