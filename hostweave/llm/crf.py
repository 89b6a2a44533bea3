"""A linear-chain conditional random field over categorical features, fitted on bounded samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Scores of labels: the sum of one weight row per active feature, plus a transition score."""

    weights: np.ndarray  # features x labels
    step: np.ndarray  # from label x to label

    def emissions(self, active: np.ndarray) -> np.ndarray:
        """Scores (tokens x labels) for active features (tokens x slots)."""
        out = np.zeros((len(active), self.weights.shape[1]))
        for slot in range(active.shape[1]):
            out += self.weights[active[:, slot]]
        return out


def fit(
    active: np.ndarray,
    labels: np.ndarray,
    known: np.ndarray,
    n_features: int,
    n_labels: int = 3,
    rounds: int = 60,
    rate: float = 0.25,
    ridge: float = 1e-4,
    batches: int = 1,
) -> Chain:
    """Maximise the conditional likelihood by Adam, in ``rounds`` passes over ``batches`` parts of the sequences.

    ``active`` is sequences x tokens x slots, ``labels`` and ``known`` sequences x tokens; ``known`` is a prefix of ones.
    Part k has every ``batches``-th sequence from the k-th on. With several parts the rate falls to a tenth.
    """
    model = Chain(np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels)))
    if not len(active):
        return model
    moments = [np.zeros_like(model.weights), np.zeros_like(model.weights), np.zeros_like(model.step), np.zeros_like(model.step)]
    steps = rounds * batches
    for k in range(1, steps + 1):
        part = slice((k - 1) % batches, None, batches)
        if not len(active[part]):
            continue
        now = rate * 0.1 ** (k / steps) if batches > 1 else rate
        for i, (at, g) in enumerate(zip((model.weights, model.step), _gradient(model, active[part], labels[part], known[part]), strict=True)):
            g = g - ridge * at
            moments[2 * i] = 0.9 * moments[2 * i] + 0.1 * g
            moments[2 * i + 1] = 0.99 * moments[2 * i + 1] + 0.01 * g * g
            at += now * (moments[2 * i] / (1 - 0.9**k)) / (np.sqrt(moments[2 * i + 1] / (1 - 0.99**k)) + 1e-8)
    return model


def _soft(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return m.squeeze(axis) + np.log(np.exp(x - m).sum(axis))


def _gradient(model: Chain, active: np.ndarray, labels: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the mean conditional log-likelihood of a token, by forward and backward sums."""
    n, length, slots = active.shape
    n_features, n_labels = model.weights.shape
    mask = known.astype(float)
    both = mask[:, 1:] * mask[:, :-1]
    tokens = max(1.0, mask.sum())
    flat = active.reshape(-1, slots)
    gold = np.zeros((n, length, n_labels))
    gold[np.arange(n)[:, None], np.arange(length)[None, :], labels] = mask
    gold_step = np.zeros((n_labels, n_labels))
    np.add.at(gold_step, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), both.ravel())
    e = model.emissions(flat).reshape(n, length, n_labels)
    ahead, back = np.zeros_like(e), np.zeros_like(e)
    ahead[:, 0] = e[:, 0]
    for t in range(1, length):
        new = _soft(ahead[:, t - 1, :, None] + model.step[None], 1) + e[:, t]
        ahead[:, t] = np.where(mask[:, t, None] > 0, new, ahead[:, t - 1])
    total = _soft(ahead[:, -1], 1)
    for t in range(length - 2, -1, -1):
        new = _soft(model.step[None] + (e[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        back[:, t] = np.where(mask[:, t + 1, None] > 0, new, 0.0)
    share = np.exp(ahead + back - total[:, None, None]) * mask[:, :, None]
    pair = np.exp(ahead[:, :-1, :, None] + model.step + (e + back)[:, 1:, None, :] - total[:, None, None, None]) * both[:, :, None, None]
    diff = (gold - share).reshape(-1, n_labels)
    grad = np.zeros_like(model.weights)
    for label in range(n_labels):
        value = np.repeat(diff[:, label], slots)
        grad[:, label] = np.bincount(flat.ravel(), value, n_features)
    return grad / tokens, (gold_step - pair.sum((0, 1))) / tokens


def decode(model: Chain, scores: np.ndarray, first: np.ndarray, outside: int = 2) -> np.ndarray:
    """Viterbi labels of many sequences at once; sequence i has the tokens first[i] to first[i + 1].

    A token whose score for ``outside`` leads by more than any two transitions can make up is outside in every best
    labelling, so chains are cut there; this changes no label. What is left between the cuts is decoded step by step,
    all pieces side by side. Among equal labellings the one with the smaller labels at the end is taken.
    """
    n, n_labels = scores.shape
    out = np.full(n, outside)
    others = np.delete(scores, outside, 1).max(1) if n else np.zeros(0)
    reach = 2 * (model.step.max() - model.step.min())
    open_ = ~(scores[:, outside] - others > reach)
    if not open_.any():
        return out
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    start = open_.copy()
    start[1:] &= ~open_[:-1] | begins[1:-1]
    stop = open_.copy()
    stop[:-1] &= ~open_[1:] | begins[1:-1]
    a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
    order = np.argsort(a - b, kind="stable")  # longest first
    a, size = a[order], (b - a)[order]
    before = ~begins[a]  # a cut token stands in front: it is outside
    after = ~begins[a + size]
    best = scores[a] + np.where(before[:, None], model.step[outside][None], 0.0)
    trail = []
    for t in range(1, int(size[0])):
        live = int(np.searchsorted(-size, -t, "left"))
        move = best[:live, :, None] + model.step[None]
        trail.append(move.argmax(1).astype(np.int8))
        best[:live] = move.max(1) + scores[a[:live] + t]
    label = (best + np.where(after[:, None], model.step[:, outside][None], 0.0)).argmax(1)
    for t in range(int(size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-size, -t, "left"))
        out[a[:live] + t] = label[:live]
        if t:
            label[:live] = trail[t - 1][np.arange(live), label[:live]]
    return out
