"""The pipeline's stages, each on its own input, against plain versions."""

import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from hostweave.llm import toxicity
from tests.llm.helpers import WORD, documents, prose, shingles
from tests.llm.test_secret_scan import PLAIN


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(500):
        words = prose(rng, rng.randrange(20, 60), 3000).split()
        bad = i % 5 == 0
        for at in rng.sample(range(20), 4 if bad else 0):
            words[at] = rng.choice(["idiot", "moron", "scum"])
        if i % 7 == 0:
            words.insert(5, f"password={rng.getrandbits(80):x}")
        rows.append((i, " ".join(words), rng.choice(["a", "b", "b", "c"])))
        labels.append((i, 1, int(bad)))
    for i in range(500, 560):  # copies, some with one word changed
        words = rows[rng.randrange(500)][1].split()
        if i % 2:
            words[-1] = "other"
        rows.append((i, " ".join(words), "a"))
    rows += [(600, None, "a"), (601, "", None), rows[3], (None, "no id at all", "c")]
    path = tmp_path_factory.mktemp("corpus")
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """Input and output rows of every stage, written and read again."""
    out, docs = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp(name)}/out"
        stage(spark, docs, folder).write.parquet(path)
        made = spark.read.parquet(path)
        out[name] = (docs, made)
        docs = made
    return out


def test_columns(stages):
    names = list(stages)
    assert len(names) == 5
    first = stages[names[0]][0].columns
    assert all(made.columns == first for _, made in list(stages.values())[:-1])


def test_toxic_documents_go(spark, folder, stages):
    docs, made = stages["toxicity"]
    scores = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))).collect()
    assert Counter(r.doc_id for r in made.collect()) == Counter(r.doc_id for r in scores if r.score < 0.5)
    kept = {r.doc_id for r in made.collect()}
    assert sum(i in kept for i in range(500) if i % 5) >= 390 and sum(i in kept for i in range(0, 500, 5)) <= 8


def test_one_of_each_group(stages):
    docs, made = stages["ngram_join"]
    rows = docs.collect()
    sets = [shingles(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i) if sets[i] else -1 - i].append(r.doc_id)
    want = Counter(min(ids, key=lambda k: (k is None, k or 0)) for ids in groups.values())
    assert Counter(r.doc_id for r in made.collect()) == want


def test_secrets_are_masked(stages):
    docs, made = stages["secret_scans"]
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in (docs, made))
    assert set(before) == set(after)
    for i, text in before.items():
        for _, pattern, group, least in PLAIN:
            for m in pattern.finditer(text or ""):
                if len(m.group(group)) >= least:
                    assert set(after[i][m.start() : m.end()]) == {"*"}
        assert len(after[i] or "") == len(text or "")


def test_mix_has_the_targets(stages):
    docs, made = stages["mixing"]
    size, taken, largest = Counter(), Counter(), Counter()
    for r in docs.collect():
        n = len(WORD.findall(r.text or ""))
        size[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    for r in made.collect():
        taken[r.source] += len(WORD.findall(r.text or ""))
    total = sum(size.values())
    weights = {s: 1 + i % 3 for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    left, open_ = total, dict(weights)
    want = {}
    while any(left * w / sum(open_.values()) > 3 * size[s] for s, w in open_.items()):
        over = [s for s, w in open_.items() if left * w / sum(open_.values()) > 3 * size[s]]
        want |= {s: 3 * size[s] for s in over}
        left, open_ = left - sum(3 * size[s] for s in over), {s: w for s, w in open_.items() if s not in over}
    want |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in size)


def test_samples_decode(stages):
    docs, made = stages["sentencepiece"]
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    processor = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    seen = defaultdict(set)
    for r in made.collect():
        assert processor.decode(r.ids) == texts[r.doc_id]
        seen[r.doc_id].add(tuple(r.ids))
    assert set(seen) == set(texts) and all(len(v) == (2 if texts[i] else 1) for i, v in seen.items())


def test_run_is_all_stages(spark, folder, stages):
    made = corpus_pipeline.run(spark, folder)
    want = list(stages.values())[-1][1]
    key = lambda d: Counter((r.doc_id, r.sample, tuple(r.ids)) for r in d.collect())
    assert key(made) == key(want)


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
