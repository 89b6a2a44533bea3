import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from hostweave.llm import bpe
from tests.llm.helpers import documents, prose

PATH = public_tokenizers.path("word_bpe_49k.json")
POOL = "abcdeèéñßſﬁİΣς̸́ \t\n  '’s.,!?#019٣漢字🙂"


@pytest.fixture(scope="module")
def rows():
    from tokenizers import Tokenizer

    rng = random.Random(5)
    back = {c: b for b, c in bpe.byte_letters().items()}
    names = Tokenizer.from_file(PATH).get_vocab(with_added_tokens=False)
    names = [bytes(back[c] for c in n.replace("</w>", "")).decode("utf-8", "ignore") for n in names]
    texts = ["".join(rng.choice(POOL) for _ in range(rng.randrange(40))) for _ in range(400)]
    texts += ["".join(rng.choice(names) for _ in range(rng.randrange(1, 6))) for _ in range(600)]
    texts += ["".join(rng.choice("abn") for _ in range(rng.randrange(1, 80))) for _ in range(200)]
    texts += ["".join(rng.choice(["<|startoftext|>", "<|endoftext|>", "̸", "it's", " ", "'re"]) for _ in range(rng.randrange(1, 8))) for _ in range(100)]
    texts += ["a" * 50_000, "ab" * 20_000, "the" * 9_000, prose(rng, 20_000), None, "", " \n\t", " ", "x\u0085y"]
    found = [(i, t) for i, t in enumerate(texts)]
    return [*found, found[0], found[0], (None, "null id")]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_and_texts_are_the_librarys(spark, rows, library):
    docs = documents(spark, rows)
    encoded = bpe.encode(docs, PATH)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    got = encoded.collect()
    assert Counter((r.key, tuple(r.ids)) for r in got) == Counter((i, tuple(want[i])) for i, _ in rows)
    texts = {r.key: r.text for r in bpe.decode(encoded, PATH).collect()}
    assert texts == {i: library.decode(ids, skip_special_tokens=False) for i, ids in want.items()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    told = Counter(tuple(r) for r in bpe.digests(docs, PATH).collect())
    assert told == Counter((i, len(want[i]), sha(" ".join(map(str, want[i]))), sha(texts[i])) for i, _ in rows)


def test_decoding_any_ids(spark, library):
    rng = random.Random(6)
    lists = [[rng.randrange(49_408) for _ in range(rng.randrange(30))] for _ in range(50)]
    df = spark.createDataFrame([(i, ids) for i, ids in enumerate(lists)] + [(99, None)], "key long, ids array<int>")
    got = {r.key: r.text for r in bpe.decode(df, PATH).collect()}
    assert got == {i: library.decode(ids, skip_special_tokens=False) for i, ids in enumerate(lists)} | {99: None}


def test_pairs_are_those_that_merging_leaves(library):
    """Two tokens fit exactly if the library leaves them as they are."""
    merges = bpe.Coder(PATH).merges
    name = {i: t for t, i in library.get_vocab(with_added_tokens=False).items()}
    inside = [i for i, t in name.items() if not t.endswith("</w>") and t.isascii() and t.isalpha() and t.islower()]
    ending = [i for i, t in name.items() if t.endswith("</w>") and t[:-4].isascii() and t[:-4].isalpha() and t.islower()]
    rng, fitting = random.Random(7), 0
    for _ in range(3000):
        x, y = rng.choice(inside), rng.choice(ending)
        ids = library.encode(name[x] + name[y][:-4], add_special_tokens=False).ids
        assert merges.fits(x, y) == (ids == [x, y])
        fitting += ids == [x, y]
    assert fitting > 300


def test_the_caches_hold_no_more_than_their_bounds(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 5)
    coder = bpe.Coder(PATH)
    rng = random.Random(8)
    for _ in range(200):
        word = "".join(rng.choice("abcdefg") for _ in range(9))
        assert coder.word(word) == library.encode(word, add_special_tokens=False).ids
        assert len(coder.words) <= 10 and len(coder.merges.pairs) <= 5


def test_empty_table(spark):
    empty = documents(spark, [])
    assert bpe.digests(empty, PATH).count() == 0 and bpe.encode(empty, PATH).count() == 0
