"""Byte-pair encoding with word ends, exact and in linear time, and decoding.

For every place of a word an Aho-Corasick automaton gives the longest token that starts there. The encoder takes it if it
can follow the token before it, else its longest prefix that is a token, and goes back one token where none fits. A place
that nothing leads on from is closed, so no place is left more than once. Whether two tokens can stand side by side is
looked up in a table of pairs, worked out once per pair: their merges are undone from the last to the first, and the pair
is refused if the parts that face each other would have been merged before that. A sequence in which all neighbours are
compatible is the one that merging by rank gives, and there is only one.

Texts are cut at white space, which no token crosses; the file's own normaliser and pattern cut those words further.
Different words are encoded once per task and kept up to a bound. Decoding gathers tokens through an offset table; the
file names no decoder, so tokens are joined by one blank and keep their word ends.

Defined cases: a null or empty text, or one of white space alone, has no ids and decodes to an empty text; strings of
special tokens in a text are those tokens, as in the library; repeated rows are encoded each; an empty table gives no
rows. Only key and text are read, so further columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.llm import distinct, kernel
from hostweave.llm.storage import small_batches

# Different words whose ids a task remembers, and pairs of tokens whose compatibility it does.
CACHE_WORDS, CACHE_PAIRS = 1 << 19, 1 << 19
# The last byte of a word is a symbol of its own.
LAST = 0x400


def byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary writes bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """Tokens by id, what each was merged from, and which can stand side by side."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        ends = lambda text: text[: -len(suffix) - 1] + chr(ord(text[-len(suffix) - 1]) + LAST) if suffix and text.endswith(suffix) and text != suffix else text
        self.id = {ends(text): i for text, i in vocabulary.items()}
        n = max(vocabulary.values()) + 1
        self.size = [0] * n
        for text, i in self.id.items():
            self.size[i] = len(text)
        self.left, self.right, self.merged = [-1] * n, [-1] * n, {}
        last = -1
        for a, b in merges:
            x, y = self.id[ends(a)], self.id[ends(b)]
            z = self.id[ends(a) + ends(b)]
            if z <= last or self.left[z] >= 0 or x >= z or y >= z:
                raise ValueError("ids must be in the order of merges, one merge for each")
            self.left[z], self.right[z], self.merged[x, y] = x, y, z
            last = z
        if any(size > 1 and self.left[i] < 0 for i, size in enumerate(self.size)):
            raise ValueError("a token of several symbols has no merge")
        self.pairs: dict[int, bool] = {}
        # a token is never seen if merging its own symbols by rank gives others
        self.seen = [size > 0 for size in self.size]
        for z in range(n):
            if self.left[z] >= 0:
                x, y = self.left[z], self.right[z]
                self.seen[z] = self.seen[x] and self.seen[y] and self._side_by_side(x, y, z)
        known = {text: i for text, i in self.id.items() if self.seen[i]}
        self.shorter = [-1] * n
        for text, i in known.items():
            self.shorter[i] = next((known[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in known), -1)
        self.automaton = _automaton({text[::-1]: i for text, i in known.items()})

    def _side_by_side(self, x: int, y: int, bound: int) -> bool:
        """False if x and y would be merged across their border by a merge before ``bound``.

        Going back in time, the token with the larger id was made later. Of equal ids the right one was, as equal merges
        are done from left to right; so a border merge also comes before an equal merge on its right.
        """
        while True:
            if self.merged.get((x, y), bound) < bound:
                return False
            if x > y:
                if self.left[x] < 0:
                    return True
                x, bound = self.right[x], x
            else:
                if self.left[y] < 0:
                    return True
                y, bound = self.left[y], y + 1

    def fits(self, x: int, y: int) -> bool:
        """Whether y can follow x, from the table."""
        key = x << 32 | y
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._side_by_side(x, y, len(self.size) + 1)
        return known

    def longest(self, symbols: str) -> dict[int, int]:
        """The longest token that starts at each place, by the places after it.

        The automaton reads from the end, with reversed tokens, and tells those of one place from the longest down.
        """
        return dict(reversed(list(self.automaton.iter(symbols[::-1]))))

    def encode(self, symbols: str) -> list[int]:
        """Ids of one word of symbols; every single symbol must be a token."""
        size, shorter, pairs = self.size, self.shorter, self.pairs
        longest, last = self.longest(symbols), len(symbols) - 1
        token = longest[last]
        closed: set[int] = set()
        out: list[int] = []
        at, before = 0, -1
        while True:
            end = at + size[token]
            if end not in closed and (before < 0 or (known if (known := pairs.get(before << 32 | token)) is not None else self.fits(before, token))):
                out.append(token)
                if end > last:
                    return out
                at, before = end, token
                token = longest[last - end]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                closed.add(at)
                token = out.pop()
                at -= size[token]
                before = out[-1] if out else -1


def _automaton(tokens: dict[str, int]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for text, i in tokens.items():
        automaton.add_word(text, i)
    automaton.make_automaton()
    return automaton


class Coder:
    """Encodes words and decodes ids with a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        settings = json.loads(library.to_str())
        model = settings["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or settings["decoder"] is not None:
            raise ValueError(f"{path}: not a byte-pair model with word ends and without a decoder")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in settings["added_tokens"]):
            raise ValueError(f"{path}: special tokens must be found in texts as they are")
        self.merges = Merges(model["vocab"], pairs, model["end_of_word_suffix"] or "")
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.plain = settings["normalizer"] == {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
        self.special = {t["content"]: t["id"] for t in settings["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = byte_letters()
        self.has_ends = bool(model["end_of_word_suffix"])
        self.words: dict[str, list[int]] = {}
        # the offset tables: every token after a blank, and every number after a blank
        names = {i: text for text, i in model["vocab"].items()} | {i: text for text, i in self.special.items()}
        tokens = [b" " + names[i].encode() if i in names else b"" for i in range(max(names) + 1)]
        self.token_bytes, self.token_at = _table(tokens)
        self.number_bytes, self.number_at = _table([b" %d" % i for i in range(len(tokens))])

    def _part(self, part: str) -> list[int]:
        """Ids of one part that the pattern has cut, in the letters of the vocabulary."""
        return self.merges.encode(part[:-1] + chr(ord(part[-1]) + LAST) if self.has_ends else part)

    def _word(self, word: str) -> list[int]:
        bare = word[:-1] if word[-1] in ".," else word
        if self.plain and bare.isalpha() and max(bare) < "İ":  # letters that need no pattern
            parts = [bare.lower().encode().decode("latin-1").translate(self.letters)]
            if bare != word:
                parts.append(word[-1])
        else:
            parts = [p for p, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(word))]
        return [i for p in parts for i in self._part(p)]

    def word(self, word: str) -> list[int]:
        """Ids of a text without white space, special tokens first."""
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            if self.special_pattern is not None and self.special_pattern.search(word):
                ids = [i for p in self.special_pattern.split(word) if p for i in ([self.special[p]] if p in self.special else self._word(p))]
            else:
                ids = self._word(word)
            self.words[word] = ids
        return ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a piece, end to end, and the number per text."""
        texts, first = distinct.words(data, offsets)
        number, different = distinct.numbered(texts)
        lists = [self.word(w) for w in different.to_pylist()]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for ids in lists for i in ids), np.int64, int(size.sum()))
        start = np.cumsum(size) - size
        ids = flat[distinct.ranges(start[number], size[number])]
        ahead = np.concatenate([[0], np.cumsum(size[number])])
        return ids, ahead[first[1:]] - ahead[first[:-1]]

    def decode(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the decoded texts, and where each starts and the last ends."""
        return _gather(self.token_bytes, self.token_at, ids, count)

    def decimal(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each text as numbers joined by one blank, likewise."""
        return _gather(self.number_bytes, self.number_at, ids, count)


def _table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _gather(flat: np.ndarray, at: np.ndarray, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of a table whose entries begin with a blank, joined by blanks for each text."""
    start, size = at[ids], at[ids + 1] - at[ids]
    leads = np.zeros(len(ids) + 1, np.int64)
    leads[(np.cumsum(count) - count)[count > 0]] = 1  # the first entry of a text goes without its blank
    start, size = start + leads[:-1], size - leads[:-1]
    out = flat[distinct.ranges(start, size)]
    ends = np.concatenate([[0], np.cumsum(size)])
    return out, ends[np.concatenate([[0], np.cumsum(count)])]


def coder(path: str) -> Coder:
    """The coder of this process; tasks that follow each other share what it remembers."""
    return kernel.keep(("bpe", path), lambda: Coder(path))


def encode(documents: DataFrame, tokenizer: str, key: str = "doc_id") -> DataFrame:
    """(key, ids) of every row."""
    kind = documents.schema[key].dataType.simpleString()

    @kernel.task
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in kernel.pieces(kernel.as_text(batch.column(1))):
                ids, count = coder(tokenizer).encode(data, offsets)
                first = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(first), pa.array(ids, pa.int32()))], ["key", "ids"])

    return small_batches(documents).select(F.col(key).alias("key"), "text").mapInArrow(encoded, f"key {kind}, ids array<int>")


def decode(rows: DataFrame, tokenizer: str) -> DataFrame:
    """(key, text) of rows of (key, ids); null ids give a null text."""
    kind = rows.schema["key"].dataType.simpleString()

    @kernel.task
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            count = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, first = coder(tokenizer).decode(ids, count)
            texts = distinct.parts(data, first).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if n else t for t, n in zip(texts.to_pylist(), lists.is_null().to_pylist(), strict=True)], pa.string())], ["key", "text"])

    return rows.select("key", "ids").mapInArrow(decoded, f"key {kind}, text string")


def digests(documents: DataFrame, tokenizer: str, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row."""
    kind = documents.schema[key].dataType.simpleString()

    def hashed(data: np.ndarray, first: np.ndarray) -> list[str]:
        raw = memoryview(data)
        return [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]

    @kernel.task
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in kernel.pieces(kernel.as_text(batch.column(1))):
                own = coder(tokenizer)
                ids, count = own.encode(data, offsets)
                columns = [batch.column(0).slice(a, b - a), pa.array(count), pa.array(hashed(*own.decimal(ids, count)), pa.string()), pa.array(hashed(*own.decode(ids, count)), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return small_batches(documents).select(F.col(key).alias("key"), "text").mapInArrow(told, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
