"""Linear-chain conditional random fields with two labels.

A sequence has a score for label 1 at each place (that of label 0 is zero) and scores of
the moves 0-1, 1-0 and 1-1 (that of 0-0 is zero).  With two labels the forward and
backward vectors are one ratio each, so a step is a few operations on all sequences of
a batch.  Places run along the first axis, sequences along the second.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Ratios stay within these bounds, far beyond any probability that matters.
_LOW, _HIGH = 1e-30, 1e30


@dataclass
class Chain:
    """Scores of the moves 0-1, 1-0 and 1-1."""

    enter: float = 0.0
    leave: float = 0.0
    stay: float = 0.0


@dataclass
class Model:
    weights: dict = field(default_factory=dict)
    bias: float = 0.0
    chain: Chain = field(default_factory=Chain)


def _passes(scores: np.ndarray, lengths: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    e = np.exp(np.clip(scores, -60, 60))
    p, q, r = np.exp(chain.enter), np.exp(chain.leave), np.exp(chain.stay)
    steps = len(e)
    forward, backward = np.empty_like(e), np.empty_like(e)
    ratio = e[0] if steps else None
    for t in range(steps):
        if t:
            ratio = np.clip(e[t] * (p + ratio * r) / (1 + ratio * q), _LOW, _HIGH)
        forward[t] = ratio
    last = np.ones(e.shape[1])
    for t in range(steps - 1, -1, -1):
        if t < steps - 1:
            x = e[t + 1] * last
            last = np.where(t + 1 < lengths, np.clip((q + x * r) / (1 + x * p), _LOW, _HIGH), 1.0)
        backward[t] = last
    return e, forward, backward


def marginals(scores: np.ndarray, lengths: np.ndarray, chain: Chain) -> np.ndarray:
    """Probability of label 1 at each place; zero behind a sequence's end."""
    _, f, b = _passes(scores, lengths, chain)
    m = f * b
    m /= 1 + m
    m[np.arange(len(scores))[:, None] >= lengths] = 0
    return m


def decode(scores: np.ndarray, lengths: np.ndarray, chain: Chain) -> np.ndarray:
    """Most probable labels (Viterbi)."""
    steps, n = scores.shape
    zero, one = np.zeros(n), np.zeros(n)
    back = np.zeros((steps, 2, n), bool)
    best = np.zeros((steps, n), bool)
    for t in range(steps):
        if t:
            back[t, 0], back[t, 1] = one + chain.leave > zero, one + chain.stay > zero + chain.enter
            zero, one = np.maximum(zero, one + chain.leave), np.maximum(zero + chain.enter, one + chain.stay)
        one = one + scores[t]
        best[t] = one > zero
    out = np.zeros((steps, n), bool)
    label = np.zeros(n, bool)
    for t in range(steps - 1, -1, -1):
        if t < steps - 1:
            label = np.where(label, back[t + 1, 1], back[t + 1, 0])
        label = np.where(lengths == t + 1, best[t], label)
        out[t] = label & (t < lengths)
    return out


def fit(features: np.ndarray, offsets: np.ndarray, place: np.ndarray, shape: tuple[int, int], lengths: np.ndarray, labels: np.ndarray, weights: np.ndarray, n_features: int, rounds: int = 120, ridge: float = 1e-2, rate: float = 0.3) -> tuple[np.ndarray, float, Chain]:
    """Feature weights, bias and chain of greatest penalized likelihood, by Adam.

    ``features`` lists feature numbers, those of item k from ``offsets[k]`` on;
    ``place`` is item k's flat position in a (places, sequences) array of ``shape``.
    Places without an item have the bias alone.  ``weights``: of sequences.
    """
    count = np.diff(np.append(offsets, len(features)))
    item = np.repeat(np.arange(len(offsets)), count)
    w = np.broadcast_to(weights, shape)
    inside = np.arange(shape[0])[:, None] < lengths
    total = float((w * inside).sum()) or 1.0
    theta, first, second = (np.zeros(n_features + 4) for _ in range(3))
    theta[n_features] = -2.0
    both = inside[1:]
    y0, y1 = labels[:-1].astype(bool), labels[1:].astype(bool)
    seen = [float((w[1:] * both * a).sum()) for a in (~y0 & y1, y0 & ~y1, y0 & y1)]
    for k in range(1, rounds + 1):
        scores = np.full(shape, theta[n_features])
        if len(offsets):
            np.add.at(scores.reshape(-1), place, np.bincount(item, theta[features], len(offsets)))
        chain = Chain(*theta[n_features + 1 :])
        e, f, b = _passes(scores, lengths, chain)
        m = f * b
        m /= 1 + m
        miss = np.where(inside, w * (labels - m), 0.0)
        grad = np.zeros_like(theta)
        if len(offsets):
            grad[:n_features] = np.bincount(features, miss.reshape(-1)[place][item], n_features)
        grad[n_features] = miss.sum()
        ahead = e[1:] * b[1:]
        moves = [np.exp(chain.enter) * ahead, f[:-1] * np.exp(chain.leave), f[:-1] * np.exp(chain.stay) * ahead]
        norm = 1 + moves[0] + moves[1] + moves[2]
        for i in range(3):
            grad[n_features + 1 + i] = seen[i] - float((w[1:] * both * moves[i] / norm).sum())
        grad = grad - ridge * theta
        grad /= total**0.5
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        theta += rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8) / (1 + 3 * k / rounds)
    return theta[:n_features], float(theta[n_features]), Chain(*theta[n_features + 1 :].tolist())


def batches(lengths: np.ndarray, cells: int = 1 << 20) -> Iterator[np.ndarray]:
    """Numbers of sequences of like length that together fit in ``cells`` places."""
    order = np.argsort(lengths, kind="stable")[::-1]
    at = 0
    while at < len(order):
        n = max(1, cells // max(1, int(lengths[order[at]])))
        yield order[at : at + n]
        at += n
