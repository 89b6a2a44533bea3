"""Toxicity scores from boosted trees over dense text features, calibrated by isotonic regression.

The model is fitted on a bounded sample of labelled documents (``SAMPLE_ROWS``, taken in hash order), divided in three:
the first part finds the lexicon (words that mark toxic texts), the second fits the trees on features of texts that the
lexicon has not seen, the third calibrates. Scoring is one pass over the documents without a shuffle.

Defined cases: a null or empty text has features of zeros and gets the score the model gives those; null labels, labels
other than 0 and 1 and labels without document are ignored; a document with several labels has the largest; without
labels of both kinds every score is the calibrated share of toxic labels (0.5 without any). Repeated rows are scored
each. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostweave.llm import boosting, kernel, sampling
from hostweave.llm.storage import small_batches

# Bound of the labelled rows that are fitted on.
SAMPLE_ROWS = 24_000
# Bound of the words in a lexicon.
LEXICON_WORDS = 512
# Documents with label 1 that a word must stand in, and their least share among its documents.
LEXICON_DOCS, LEXICON_SHARE = 6, 0.6
# Words between a marked word and a second person.
NEAR_WORDS = 3

SECOND_PERSON = (
    "you your yours yourself you're ur u du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos "
    "tú ti usted ustedes vosotros tus"
).split()
# General insults that mark a text even where the labels are too few to show it.
INSULTS = "idiot idiots moron morons scum trash worthless stupid pathetic disgusting loser losers clown clowns dumb".split()

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LEET = _LOWER.copy()
for _a, _b in zip(b"013457@$!8", b"oieastasib", strict=True):
    _LEET[_a] = _b
LOWER_VALUES = kernel.BYTE_VALUES[_LOWER]
LEET_VALUES = kernel.BYTE_VALUES[_LEET]

_is = lambda characters: np.isin(np.arange(256), np.frombuffer(characters, np.uint8))
UPPER = _is(bytes(range(65, 91)))
LETTER = UPPER | _is(bytes(range(97, 123))) | (np.arange(256) >= 128)
DIGIT = _is(b"0123456789")
MARKS = _is(b".,;:!?'\"()-")
SYMBOL = _is(b"#*$%&|<>@^~_=+/\\[]{}")
CORE = LETTER | DIGIT | _is(b"@$")

FEATURES = (
    "log_words word_length capitals capital_words exclamations questions marks digits symbols obfuscated lexicon_density "
    "lexicon_weight lexicon_max lexicon_count insult_density leet_density second_person near_second_person doubled "
    "line_breaks beyond_ascii capital_lexicon"
).split()


@dataclass
class Model:
    words: np.ndarray  # sorted hashes of the lexicon
    weights: np.ndarray
    trees: boosting.Trees
    scale: boosting.Isotonic

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.scale(self.trees.margin(features(data, offsets, self.words, self.weights)))


def _sorted_hashes(texts: list[str]) -> np.ndarray:
    return np.sort(np.array([kernel.hash_text(t, LOWER_VALUES) for t in texts], np.uint64))


_SECOND, _INSULTS = _sorted_hashes(SECOND_PERSON), _sorted_hashes(INSULTS)


def _find(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index of each hash in the sorted table, -1 if it is not there."""
    if not len(table):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, at, -1)


def cores(data: np.ndarray, found: kernel.Words) -> tuple[np.ndarray, np.ndarray]:
    """Each word without punctuation at its ends; a word of punctuation alone is empty."""
    solid = np.flatnonzero(CORE[data])
    if not len(solid):
        return found.start, found.start
    a, b = np.searchsorted(solid, found.start), np.searchsorted(solid, found.end)
    some = b > a
    start = np.where(some, solid[np.minimum(a, len(solid) - 1)], found.start)
    return start, np.where(some, solid[np.maximum(b - 1, 0)] + 1, found.start)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in lower case without outer punctuation, and its text."""
    found = kernel.words(data, offsets)
    start, end = cores(data, found)
    some = end > start
    return kernel.range_hash(kernel.prefix_hash(data, LOWER_VALUES), start, end)[some], found.doc[some]


def features(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(offsets) - 1
    found = kernel.words(data, offsets)
    doc = found.doc
    start, end = cores(data, found)
    size = end - start
    h = kernel.range_hash(kernel.prefix_hash(data, LOWER_VALUES), start, end)
    leet = kernel.range_hash(kernel.prefix_hash(data, LEET_VALUES), start, end)
    upper = kernel.count_in(UPPER[data], start, end)
    letters = kernel.count_in(LETTER[data], start, end)
    odd = size - letters
    marked, insult = _find(h, lexicon), _find(h, _INSULTS)
    disguised = (h != leet) & ((_find(leet, _INSULTS) >= 0) | (_find(leet, lexicon) >= 0)) & (marked < 0)
    weight = np.where(marked >= 0, weights[marked] if len(weights) else 0.0, 0.0)
    hit = (marked >= 0) | (insult >= 0) | disguised
    second = _find(h, _SECOND) >= 0
    near = np.zeros(len(h), bool)
    for step in range(1, NEAR_WORDS + 1):
        same = doc[step:] == doc[:-step]
        near[step:] |= second[:-step] & same
        near[:-step] |= second[step:] & same
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    add = lambda values: np.bincount(doc, values, n)[:n]
    total, chars = np.diff(found.first).astype(float), np.diff(offsets).astype(float)
    per_word, per_char = 1 / np.maximum(total, 1), 1 / np.maximum(chars, 1)
    in_text = lambda flags: kernel.count_in(flags, offsets[:-1], offsets[1:])
    largest = np.zeros(n)
    np.maximum.at(largest, doc[marked >= 0], weight[marked >= 0])
    return np.stack(
        [
            np.log1p(total),
            add(size) * per_word,
            add(upper) / np.maximum(add(letters), 1),
            add((upper == letters) & (letters >= 2)) * per_word,
            in_text(data == 0x21) * per_char,
            in_text(data == 0x3F) * per_char,
            in_text(MARKS[data]) * per_char,
            in_text(DIGIT[data]) * per_char,
            in_text(SYMBOL[data]) * per_char,
            add((odd > 0) & (letters > 0)) * per_word,
            add(marked >= 0) * per_word,
            add(weight) * per_word,
            largest,
            np.minimum(add(marked >= 0), 50),
            add(insult >= 0) * per_word,
            add(disguised) * per_word,
            add(second) * per_word,
            add(hit & near) * per_word,
            add(again) * per_word,
            in_text(data == 0x0A) * per_char,
            in_text(data >= 0x80) * per_char,
            add(hit & (upper == letters) & (letters >= 2)) * per_word,
        ],
        1,
    )


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt from; a document without an id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, toxic, part, text) of a sample in hash order; parts 0 to 4 are about equal in size. An id has one row."""
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("_h", F.xxhash64("doc_id"))
    )
    known = sampling.below(known, "_h", rows).orderBy("_h", "doc_id").limit(rows).drop("_h")
    # at most ``rows`` pairs of numbers, and of rows with one id the text with the smallest hash
    texts = small_batches(documents).select("doc_id", "text").join(F.broadcast(known), "doc_id")
    one = texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    return one.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)).cast("int"))


def fit(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit lexicon (parts 0 and 1), trees (2 and 3) and calibration (4) on the sample."""
    sample = training_rows(documents, labels, rows).select("toxic", "part", "text")

    @kernel.task
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for a, _, data, offsets in kernel.pieces(kernel.as_text(batch.column("text"))):
                h, doc = word_hashes(data, offsets)
                pairs = np.unique(np.stack([h.view(np.int64), doc]), axis=1)
                word, where = np.unique(pairs[0], return_inverse=True)
                y = toxic[a + pairs[1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word), pa.array(np.bincount(where, y, len(word)).astype(np.int64)), pa.array(np.bincount(where, minlength=len(word)))],
                    ["word", "n_toxic", "n"],
                )

    words = (
        sample.where("part < 2")
        .mapInArrow(counted, "word long, n_toxic long, n long")
        .groupBy("word")
        .agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n").alias("n"))
        .where((F.col("n_toxic") >= LEXICON_DOCS) & (F.col("n_toxic") >= LEXICON_SHARE * F.col("n")))
        .orderBy(F.desc("n_toxic"), "word")
        .limit(LEXICON_WORDS)
        .toPandas()
    )
    order = np.argsort(words["word"].to_numpy(np.int64).view(np.uint64))
    lexicon = words["word"].to_numpy(np.int64).view(np.uint64)[order]
    toxic, n = words["n_toxic"].to_numpy(float)[order], words["n"].to_numpy(float)[order]
    weights = np.log((toxic + 0.5) / (n - toxic + 0.5))

    @kernel.task
    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in kernel.pieces(kernel.as_text(batch.column("text"))):
                x = features(data, offsets, lexicon, weights)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("toxic").slice(a, b - a), batch.column("part").slice(a, b - a), pa.array(x.tolist(), pa.list_(pa.float64()))],
                    ["toxic", "part", "x"],
                )

    rows_ = sample.where("part >= 2").mapInArrow(described, "toxic int, part int, x array<double>").toPandas()
    x = np.array(rows_["x"].tolist()).reshape(-1, len(FEATURES))
    y, part = rows_["toxic"].to_numpy(float), rows_["part"].to_numpy(int)
    order = np.lexsort([*x.T, y, part])  # the order of arrival must not matter
    x, y, part = x[order], y[order], part[order]
    trees = boosting.fit_trees(x[part < 4], y[part < 4])
    rest = part == 4 if (part == 4).any() else np.ones(len(part), bool)
    return Model(lexicon, weights, trees, boosting.fit_isotonic(trees.margin(x[rest]), y[rest]))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of documents."""

    @kernel.task
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in kernel.pieces(kernel.as_text(batch.column("text"))):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(model.score(data, offsets))], ["doc_id", "score"]
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return small_batches(documents).select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double")


def accepted(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of documents, all columns, whose score is below the threshold."""

    @kernel.task
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [model.score(data, offsets) < threshold for _, _, data, offsets in kernel.pieces(kernel.as_text(batch.column("text")))]
            yield batch.filter(pa.array(np.concatenate(good))) if good else batch

    return small_batches(documents).mapInArrow(kept, documents.schema)
