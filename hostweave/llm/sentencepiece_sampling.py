"""SentencePiece encoding, decoding, and distinct sampled segmentations.

The lattice of a text has a node at every byte and an edge for every piece that fits; a character without a piece of its
own is spelled in byte pieces. Pieces are weighed by Zipf's law over their rank in the model, and a segmentation's
probability is the product of its weights, divided by the sum over the lattice.

Samples without replacement are the ``k`` segmentations with the largest Gumbel-perturbed log-probabilities, found by A*
search over prefixes from the top down: the maximum over a prefix's continuations is known before they are, so the
search walks the best path, and each step leaves the other pieces behind with their own (smaller) maxima. The best of
those is the start of the next sample. A sample's inclusion score is the chance to be among the ``k`` given the
perturbed value of the first that is not.

A blank starts a word and no piece goes beyond a word, so lattices are built once per different word and kept up to a
bound. Noise is a hash of the row's key, the sample and the place, so any task draws the same. Sums of log-probabilities
are kept as integers (2**-24), which do not depend on what else is in the batch.

Defined cases: a null or empty text has one segmentation, without pieces; a text with fewer than ``k`` segmentations has
all of them, each with inclusion score 1; repeated rows draw the same samples. Only key and text are read. Models must
keep white space and text as they are (dummy prefix, no normalisation); decoding a sample gives the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.llm import kernel
from hostweave.llm.storage import small_batches

K = 2
SEED = 17
# Different words whose lattices a task keeps, and edges.
CACHE_WORDS, CACHE_EDGES = 1 << 19, 3_800_000
# Bytes of text sampled at once.
PIECE_BYTES = 1 << 19
UNIT = 2.0**24

_NODE, _EDGE, _SAMPLE = (np.uint64(c) for c in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def _uniform(h: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1 from 64 mixed bits."""
    return ((h >> np.uint64(41)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-23)


# No drawn exponential has a smaller logarithm than this.
LEAST_LOG = -17.0
# How far down a path what was left behind is looked at first; further where that does not settle it.
FIRST_REACH = 20.0


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every range, end to end."""
    ahead = np.cumsum(size) - size
    return np.repeat(start - ahead, size) + np.arange(int(size.sum()))


class Grown:
    """An array that grows by doubling."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        while self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class Pieces:
    """The pieces of a model as a byte trie with weights."""

    def __init__(self, model: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model)
        sp, n = self.processor, self.processor.get_piece_size()
        self.byte_id = np.full(256, -1)
        self.weight = np.zeros(n, np.float32)
        trie: dict = {}
        self.text: list[bytes] = [b""] * n
        worst = -np.log(n + 2.0)
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.weight[i], self.text[i] = worst, bytes([int(piece[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                # ranks are negated scores; pieces out of use have none and count as the last
                self.weight[i] = -np.log(min(max(-sp.get_score(i), 0.0), n) + 2.0)
                self.text[i] = piece.replace("▁", " ").encode()
                node = trie
                for byte in self.text[i]:
                    node = node.setdefault(byte, {})
                node[-1] = i
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces")
        joined = [t for t in self.text if b" " in t.lstrip(b" ")]
        if joined:
            raise ValueError("pieces go over the ends of words")
        self.size = np.fromiter(map(len, self.text), np.int64, n)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)
        # the trie as a table: a row for every state that goes on, -1 where no piece does
        rows, self.piece, self.inner, queue = [], [], [], [trie]
        for node in queue:  # grows while it is read
            self.piece.append(node.get(-1, -1))
            on = [byte for byte in node if byte >= 0]
            self.inner.append(len(rows) if on else -1)
            if on:
                row = np.full(256, -1, np.int32)
                for byte in on:
                    row[byte] = len(queue)
                    queue.append(node[byte])
                rows.append(row)
        self.table, self.piece, self.inner = np.stack(rows), np.array(self.piece), np.array(self.inner)
        # bytes that stand in no piece but their own cut words as well
        inside = np.zeros(256, bool)
        for i, text in enumerate(self.text):
            if len(text) > 1:
                inside[np.frombuffer(text, np.uint8)] = True
        self.alone = ~inside & (np.arange(256) < 128)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the pieces, end to end."""
        return self.flat[_ranges(self.start[ids], self.size[ids])]


class Lattices:
    """Lattices of words: nodes are bytes, with the edges that start there and their conditional log-probabilities."""

    def __init__(self, pieces: Pieces, words: int = CACHE_WORDS, edges: int = CACHE_EDGES):
        self.pieces, self.most_words, self.most_edges = pieces, words, edges
        self.clear()

    def clear(self) -> None:
        self.key, self.base = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first = Grown(np.int32)  # first edge of each node; one node more per word closes the last
        small = np.uint16 if len(self.pieces.text) <= 1 << 16 else np.int32
        self.id, self.span, self.log, self.chance = Grown(small), Grown(np.uint8), Grown(np.float32), Grown(np.float32)

    def nodes(self, key: np.ndarray) -> np.ndarray:
        """First node of each word, -1 where it is missing."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.base[at], -1)

    def full(self, more: int) -> bool:
        return len(self.key) + more > self.most_words or self.id.n > self.most_edges

    def add(self, key: np.ndarray, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
        """Add missing words, keys ascending, each a range of bytes of ``data``."""
        pieces = self.pieces
        first_node = np.cumsum(length + 1) - (length + 1)
        text = np.zeros(int((length + 1).sum()), np.uint8)  # a zero closes each word
        place = _ranges(first_node, length)
        text[place] = data[_ranges(begin, length)]
        ends = np.zeros(len(text), np.int64)
        ends[place] = np.repeat(first_node + length, length)
        starts = place[(text[place] & 0xC0) != 0x80]
        lead = text[starts]
        width = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        own = np.zeros(len(starts), bool)
        # all pieces that start at a character, one byte more at a time
        found = []
        row, at, which = np.zeros(len(starts), np.int64), starts, np.arange(len(starts))
        size = 0
        while len(at):
            state = pieces.table[row, text[at]]
            on = state >= 0
            state, at, which = state[on], at[on], which[on]
            size += 1
            piece = pieces.piece[state]
            hit = piece >= 0
            found.append((starts[which[hit]], piece[hit], np.full(int(hit.sum()), size)))
            own[which[hit]] |= width[which[hit]] == size
            row = pieces.inner[state]
            on = (row >= 0) & (at + 1 < ends[starts[which]])
            row, at, which = row[on], at[on] + 1, which[on]
        # characters without a piece of their own are spelled byte by byte
        spelled = _ranges(starts[~own], width[~own])
        found.append((spelled, pieces.byte_id[text[spelled]], np.ones(len(spelled), np.int64)))
        count = np.zeros(len(text), np.int64)
        for node, _, _ in found:
            count[node] += 1
        start = np.cumsum(count) - count
        filled = start.copy()
        id_, span = np.zeros(int(count.sum()), np.int64), np.zeros(int(count.sum()), np.int64)
        for node, piece, size_ in found:
            id_[filled[node]], span[filled[node]] = piece, size_
            filled[node] += 1
        weight = self.pieces.weight[id_].astype(np.float64)
        node_of = np.repeat(np.arange(len(count)), count)
        back = np.zeros(len(count))  # log of the sum over all ways from a node to the word's end
        order = np.argsort(-length, kind="stable")
        for left in range(1, int(length.max()) + 1 if len(length) else 0):
            live = order[: np.searchsorted(-length[order], -left, "right")]
            node = first_node[live] + length[live] - left
            node = node[count[node] > 0]
            e = _ranges(start[node], count[node])
            value = weight[e] + back[node_of[e] + span[e]]
            cut = np.cumsum(count[node]) - count[node]
            top = np.maximum.reduceat(value, cut) if len(e) else value
            back[node] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, count[node])), cut)) if len(e) else back[node]
        log = weight + back[node_of + span] - back[node_of]
        # running chance within a node; its last edge takes what rounding leaves
        chance = np.cumsum(np.exp(log))
        chance -= np.repeat(np.where(start > 0, chance[np.maximum(start - 1, 0)], 0.0), count)
        chance[(start + count - 1)[count > 0]] = 2.0
        base = self.first.n + first_node
        at = np.searchsorted(self.key, key)
        self.key, self.base = np.insert(self.key, at, key), np.insert(self.base, at, base)
        self.first.add(start + self.id.n)
        for grown, values in ((self.id, id_), (self.span, span), (self.log, log), (self.chance, chance)):
            grown.add(values)

    def edges(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = self.first.data[node].astype(np.int64)
        after = node + 1
        end = np.where(after < self.first.n, self.first.data[np.minimum(after, len(self.first.data) - 1)], self.id.n)
        return start, end.astype(np.int64) - start


def walk(lattices: Lattices, node: np.ndarray, place: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Draw the rest of many words from the lattice: their edges and nodes end to end, and the number for each.

    ``node`` is where each starts, ``place`` its byte in the text, ``seed`` the text's noise.
    """
    chance, span = lattices.chance.data, lattices.span.data
    steps = []
    word, count = np.arange(len(node)), np.zeros(len(node), np.int64)
    while len(word):
        edge, size = lattices.edges(node)
        on = size > 0
        if not on.all():
            word, node, place, edge = word[on], node[on], place[on], edge[on]
            if not len(word):
                break
        h = (seed[word] + place.astype(np.uint64) * _NODE) * kernel.MIX[0]
        u = _uniform((h ^ (h >> np.uint64(32))) * kernel.MIX[1])
        edge = edge.copy()
        on = np.flatnonzero(u > chance[edge])
        while len(on):
            edge[on] += 1
            on = on[u[on] > chance[edge[on]]]
        steps.append((word, edge, node))
        count[word] += 1
        move = span[edge]
        node, place = node + move, place + move
    first = np.cumsum(count) - count
    edges, nodes = np.zeros(int(count.sum()), np.int64), np.zeros(int(count.sum()), np.int64)
    for k, (word, edge, node) in enumerate(steps):
        edges[first[word] + k], nodes[first[word] + k] = edge, node
    return edges, nodes, count


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of integers between consecutive ``first``."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


class Sampler:
    """Draws samples of pieces of texts."""

    def __init__(self, model: str, k: int = K):
        self.pieces = Pieces(model)
        self.lattices = Lattices(self.pieces)
        self.k = k

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes with a blank before each text, their offsets, and each word's start, end and first node."""
        some = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][some], np.uint8(0x20))
        offsets = offsets + np.concatenate([[0], np.cumsum(some)])
        begins = np.zeros(len(data), bool)
        blank, alone = data == 0x20, self.pieces.alone[data]
        begins[offsets[:-1][some]] = True
        begins[1:] |= (blank[1:] & ~blank[:-1]) | alone[1:] | (alone[:-1])
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))[: len(start)]
        key, first, where = np.unique(kernel.range_hash(kernel.prefix_hash(data), start, end), return_index=True, return_inverse=True)
        node = self.lattices.nodes(key)
        new = node < 0
        if new.any():
            if self.lattices.full(int(new.sum())):
                self.lattices.clear()
                new[:] = True
            at = first[new]
            self.lattices.add(key[new], data, start[at], end[at] - start[at])
            node = self.lattices.nodes(key)
        return data, offsets, start, end, node[where]

    def __call__(self, data: np.ndarray, offsets: np.ndarray, seed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each rank: (texts that have it, their ids end to end, number of ids, log-probability, perturbed value).

        At the end ``self.next`` has the perturbed value of each text's first segmentation that was not drawn.
        """
        k, n = self.k, len(offsets) - 1
        data, offsets, start, _, node = self.words(data, offsets)
        doc = np.searchsorted(offsets, start, "right") - 1
        place = start - offsets[doc]
        log = lambda edge: np.rint(self.lattices.log.data[edge].astype(np.float64) * UNIT).astype(np.int64)
        word_first = np.searchsorted(doc, np.arange(n + 1), "left")
        texts = np.arange(n)
        value = -np.log(-np.log(_uniform(kernel.mix(seed ^ _SAMPLE)).astype(np.float64)))
        # what was left behind and may start a sample: value, path and place it branches off, edge taken there
        f_value = np.full((n, k), -np.inf)
        f_path, f_at, f_edge = (np.zeros((n, k), np.int64) for _ in range(3))
        paths = []  # (edges of all texts, first edge of each text)
        for rank in range(k):
            noise = kernel.mix(seed[texts] + np.uint64((rank + 1) * int(_SAMPLE) % 2**64))
            if rank == 0:
                begin, head = word_first[:-1], np.zeros(n, np.int64)
                words_, from_node, from_place = np.arange(len(start)), node, place
                prefix_edges, prefix_size = np.zeros(0, np.int64), np.zeros(n, np.int64)
                owner = doc
            else:
                pick = f_value[texts].argmax(1)
                path, at, edge = f_path[texts, pick], f_at[texts, pick], f_edge[texts, pick]
                value = f_value[texts, pick]
                f_value[texts, pick] = -np.inf
                # the shared beginning, then the piece left behind
                prefix_size = at + 1
                flat = np.concatenate([p[0] for p in paths])
                shift = np.cumsum([0, *[len(p[0]) for p in paths]])
                first = np.stack([p[1][:-1] + s for p, s in zip(paths, shift[:-1], strict=True)])[path, texts]
                prefix_edges = flat[_ranges(first, prefix_size)]
                prefix_end = np.cumsum(prefix_size)
                prefix_edges[prefix_end - 1] = edge
                # bytes that it covers tell where to go on: within a word, or at the next
                covered = _sums(self.lattices.span.data[prefix_edges].astype(np.int64), np.concatenate([[0], prefix_end]))
                reach = offsets[texts] + covered
                begin = np.searchsorted(start, reach, "right") - 1  # the word that holds the byte
                begin = np.maximum(begin, word_first[texts])
                many = word_first[texts + 1] - begin
                words_ = _ranges(begin, many)
                owner = np.repeat(np.arange(len(texts)), many)
                lead = np.cumsum(many) - many
                from_node, from_place = node[words_], place[words_]
                into = reach - start[begin]
                from_node[lead] += into
                from_place[lead] += into
            walked_edges, nodes, steps = walk(self.lattices, from_node, from_place, noise[owner])
            # whole paths: beginning and walked part of each text
            walked = np.bincount(owner, steps, len(texts)).astype(np.int64)
            size = prefix_size + walked
            first = np.concatenate([[0], np.cumsum(size)])
            edges = np.zeros(int(first[-1]), np.int64)
            edges[_ranges(first[:-1], prefix_size)] = prefix_edges
            tail = first[:-1] + prefix_size  # where the walked part of each text begins
            spot = _ranges(tail, walked)
            edges[spot] = walked_edges
            each = log(edges)
            ahead = np.concatenate([[0], np.cumsum(each)])
            total = ahead[first[1:]] - ahead[first[:-1]]
            yield texts, self.lattices.id.data[edges], size, total / UNIT, value
            whole = np.zeros(n + 1, np.int64)
            whole[texts + 1] = size
            paths.append((edges, np.cumsum(whole)))
            mine = np.repeat(np.arange(len(texts)), walked)
            before = (ahead[spot] - ahead[first[mine]]) / UNIT
            level, mine, at, edge = self._left(nodes, walked_edges, mine, before, spot - first[mine], noise)
            if len(level):
                nth = np.arange(len(mine)) - np.searchsorted(mine, mine, "left")
                more = np.full((n, k), -np.inf)
                m_at, m_edge = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
                more[texts[mine], nth] = -np.logaddexp(-value[mine], level)
                m_at[texts[mine], nth], m_edge[texts[mine], nth] = at, edge
                all_value = np.concatenate([f_value, more], 1)
                order = np.argsort(-all_value, 1, kind="stable")[:, :k]
                take = lambda a, b, order=order: np.take_along_axis(np.concatenate([a, b], 1), order, 1)
                f_value = np.take_along_axis(all_value, order, 1)
                f_path, f_at, f_edge = take(f_path, np.full((n, k), rank)), take(f_at, m_at), take(f_edge, m_edge)
            texts = np.flatnonzero(f_value.max(1) > -np.inf)
            if not len(texts):
                break
        self.next = f_value.max(1)

    def _left(
        self, node: np.ndarray, taken: np.ndarray, mine: np.ndarray, before: np.ndarray, at: np.ndarray, noise: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ``k`` best edges that a walk left behind, by text: (level, text, place in the path, edge).

        An edge's maximum, given the larger one of the path, is -log(exp(-path) + exp(level)) with a level of log(E)
        minus the log-probability up to and with the edge, E exponential. As the probability of a beginning falls along
        the path and log(E) has a least value, only the first places of a path can have the lowest levels.
        """
        k, texts = self.k, len(noise)
        reach = np.full(texts, FIRST_REACH)
        todo = np.ones(texts, bool)
        out: list[tuple[np.ndarray, ...]] = []
        last = np.zeros(texts)  # how far down each path goes
        some, end = np.unique(mine, return_index=True)
        last[some] = -before[np.append(end[1:], len(mine))[: len(some)] - 1]
        while todo.any():
            here = np.flatnonzero(todo[mine] & (-before <= reach[mine]))
            first, size = self.lattices.edges(node[here])
            edge = _ranges(first, size)
            spot = np.repeat(here, size)
            other = edge != taken[spot]
            rank = (np.arange(len(edge)) - np.repeat(np.cumsum(size) - size, size))[other].astype(np.uint64)
            edge, spot = edge[other], spot[other]
            h = (noise[mine[spot]] + at[spot].astype(np.uint64) * _EDGE + (rank + np.uint64(1)) * _SAMPLE) * kernel.MIX[0]
            h = (h ^ (h >> np.uint64(32))) * kernel.MIX[1]
            level = np.log(-np.log(_uniform(h ^ (h >> np.uint64(29))))) - (before[spot] + self.lattices.log.data[edge])
            order = np.lexsort((edge, at[spot], level, mine[spot]))
            level, edge, spot = level[order], edge[order], spot[order]
            text = mine[spot]
            nth = np.arange(len(text)) - np.searchsorted(text, text, "left")
            worst = np.full(texts, np.inf)
            worst[text[nth == k - 1]] = level[nth == k - 1]
            enough = todo & ((worst - LEAST_LOG <= reach) | (reach >= last))
            on = (nth < k) & enough[text]
            out.append((level[on], text[on], at[spot[on]], edge[on]))
            todo &= ~enough
            reach = np.where(np.isfinite(worst), worst - LEAST_LOG, np.inf)
        level, text, place, edge = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0),) * 4
        order = np.argsort(text, kind="stable")
        return level[order], text[order].astype(np.int64), place[order].astype(np.int64), edge[order].astype(np.int64)


def sampler_of(model: str, k: int) -> Sampler:
    """The sampler of this process; tasks that follow each other share its lattices."""
    return kernel.keep(("sampler", model, k), lambda: Sampler(model, k))


def log_inclusion(log_probability: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Log of the chance that a segmentation's perturbed value exceeds that of the first one not drawn."""
    x = log_probability - following
    with np.errstate(over="ignore", divide="ignore"):
        exact = np.log(-np.expm1(-np.exp(np.minimum(x, 50.0))))
    return np.where(following == -np.inf, 0.0, np.where(x < -30, x, exact))


def _drawn(sampler: Sampler, data: np.ndarray, offsets: np.ndarray, seed: np.ndarray) -> list[tuple]:
    """All samples of a piece of texts: (texts, ids, counts, log-probability, perturbed, log-inclusion) per rank."""
    found = list(sampler(data, offsets, seed))
    return [(*f, log_inclusion(f[3], sampler.next[f[0]])) for f in found]


def _rows(documents: DataFrame, key: str, seed: int) -> DataFrame:
    return small_batches(documents).select(F.col(key).alias("key"), F.xxhash64(F.col(key).cast("string"), F.lit(seed)).alias("seed"), "text")


def sample(documents: DataFrame, model: str, k: int = K, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """(key, sample, ids, log_probability, perturbed, log_inclusion): up to ``k`` rows for each row of documents."""

    @kernel.task
    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = sampler_of(model, k)
        for batch in batches:
            keys, seeds = batch.column("key"), batch.column("seed").to_numpy().view(np.uint64)
            for a, b, data, offsets in kernel.pieces(kernel.as_text(batch.column("text")), PIECE_BYTES):
                for rank, (texts, ids, count, log, value, inclusion) in enumerate(_drawn(sampler, data, offsets, seeds[a:b]), 1):
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.take(pa.array(texts + a)),
                            pa.array(np.full(len(texts), rank, np.int32)),
                            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(ids.astype(np.int32))),
                            pa.array(log),
                            pa.array(value),
                            pa.array(inclusion),
                        ],
                        ["key", "sample", "ids", "log_probability", "perturbed", "log_inclusion"],
                    )

    kind = documents.schema[key].dataType.simpleString()
    return _rows(documents, key, seed).mapInArrow(drawn, f"key {kind}, sample int, ids array<int>, log_probability double, perturbed double, log_inclusion double")


def digests(documents: DataFrame, model: str, k: int = K, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """As ``sample``, with the number of ids, their CRC-32 as uint32, and whether decoding them gives the text."""

    @kernel.task
    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = sampler_of(model, k)
        for batch in batches:
            keys, seeds = batch.column("key"), batch.column("seed").to_numpy().view(np.uint64)
            for a, b, data, offsets in kernel.pieces(kernel.as_text(batch.column("text")), PIECE_BYTES):
                for rank, (texts, ids, count, log, value, inclusion) in enumerate(_drawn(sampler, data, offsets, seeds[a:b]), 1):
                    raw = ids.astype("<u4").tobytes()
                    cut = np.concatenate([[0], np.cumsum(count)])
                    at = (4 * cut).tolist()
                    spelled = sampler.pieces.decode(ids)
                    ends = np.concatenate([[0], np.cumsum(sampler.pieces.size[ids])])[cut].tolist()
                    same = [
                        bytes(spelled[s:e][1:]) == bytes(data[offsets[t] : offsets[t + 1]])
                        for s, e, t in zip(ends[:-1], ends[1:], texts.tolist(), strict=True)
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.take(pa.array(texts + a)),
                            pa.array(np.full(len(texts), rank, np.int32)),
                            pa.array(count.astype(np.int64)),
                            pa.array([zlib.crc32(raw[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)], pa.int64()),
                            pa.array(log),
                            pa.array(value),
                            pa.array(inclusion),
                            pa.array(same),
                        ],
                        ["key", "sample", "n_pieces", "ids_crc32", "log_probability", "perturbed", "log_inclusion", "round_trip"],
                    )

    kind = documents.schema[key].dataType.simpleString()
    return _rows(documents, key, seed).mapInArrow(
        drawn,
        f"key {kind}, sample int, n_pieces long, ids_crc32 long, log_probability double, perturbed double, log_inclusion double, round_trip boolean",
    )


def encode(documents: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """(key, ids): the model's own segmentation of every row's text."""

    @kernel.task
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            texts = kernel.as_text(batch.column("text"))
            for a, b, _, _ in kernel.pieces(texts):
                ids = processor.encode(texts.slice(a, b - a).to_pylist(), num_threads=1)
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(a, b - a), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return small_batches(documents).select(F.col(key).alias("key"), "text").mapInArrow(encoded, f"key {kind}, ids array<int>")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """All columns of ``rows`` (with ``ids``), and ``decoded``: the text of the ids, null for null."""

    @kernel.task
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            texts = [None if ids is None else processor.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", decoded string"
    return rows.mapInArrow(decoded, schema)
