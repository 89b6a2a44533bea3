import random
from collections import Counter

from pyspark.sql import functions as F

from hostweave.llm import quality_rules as Q
from tests.llm.helpers import WORD, documents, prose


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


def cases():
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a " * 9, "a " * 8, "é" * 30, "one two three", "x" * 200_000, "w " * 30_000, "\u00a0 a\x1cb"]
    for _ in range(60):
        text = prose(rng, rng.randrange(5, 120), rng.choice([3, 10, 1000]))
        if rng.random() < 0.5:
            text = text.replace(" ", rng.choice(["\n", "  ", "\t", " # "]), rng.randrange(40))
        texts.append(text + ("\n" + text if rng.random() < 0.3 else ""))
    return texts


def test_counts_and_verdicts(spark):
    texts = cases()
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[-1]), (0, texts[-1]), (None, texts[-2])]
    docs = documents(spark, rows)
    found = Q.judge(docs).collect()
    assert len(found) == len(rows)
    want = Counter((i, *plain(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == want
    for r in found:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_order_of_rules_does_not_change_verdicts(spark):
    docs = documents(spark, list(enumerate(cases())))
    rules = Q.standard_rules()
    a = Q.judge(docs, rules).orderBy("doc_id").collect()
    b = Q.judge(docs, rules[::-1]).orderBy("doc_id").collect()
    assert a == b


def test_order_by_rejections_per_cost(spark):
    docs = documents(spark, [(i, f"{'bad ' if i % 2 else ''}{'word ' * 3}{' '.join(str(j) for j in range(30))}") for i in range(200)])
    rules = [
        Q.Rule("never", F.lit(False)),
        Q.Rule("half", F.contains("text", F.lit("bad"))),
        Q.Rule("null", F.lit(None).cast("boolean")),
    ]
    found = Q.estimate(docs, rules)
    assert found[0].rule.name == "half" and abs(found[0].rejected - 0.5) < 0.01
    assert [e.rank for e in found] == sorted((e.rank for e in found), reverse=True)
    assert Q.judge(docs, rules).where("kept").count() == 100


def test_clean_prose_is_kept(spark):
    rng = random.Random(2)
    docs = documents(spark, [(i, prose(rng, 80, 5000).replace(" ", "\n", 5) + ".") for i in range(50)])
    assert Q.judge(docs).where("kept").count() == 50


def test_empty_table(spark):
    assert Q.judge(documents(spark, [])).count() == 0


def test_costs_are_those_of_the_rules(spark):
    """Starting a job is not counted: a rule without work costs next to nothing, one that reads texts does."""
    rng = random.Random(3)
    docs = documents(spark, [(i, prose(rng, 400)) for i in range(400)])
    rules = [Q.Rule("none", F.col("n_words") > 10**6), Q.Rule("reads", 10 * F.regexp_count("text", F.lit(Q.DOUBLED)) > 30 * F.col("n_words"))]
    found = {e.rule.name: e.seconds for e in Q.estimate(docs, rules)}
    assert found["none"] < 0.2 * found["reads"]
