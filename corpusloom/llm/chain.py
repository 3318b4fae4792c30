"""Linear-chain conditional random field over categorical features, fitted in numpy on partly labelled sequences.

The objective is the likelihood of what is known of each item (the set of states it may have) given its features and
its neighbours: one forward-backward pass over the known sets, one over all states, and their difference is the
gradient. Items of which nothing is known take part with their features and neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NEVER = -1e9


def marginals(e: np.ndarray, moves: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of each state (sequences, places, states) and expected moves of padded sequences.

    ``e``: scores (sequences, places, states); ``moves``: from a state to another; ``first``: of the first state. What is
    handed on is scaled to sum to one at each place.
    """
    n, long, k = e.shape
    seen = np.exp(e - e.max(2, keepdims=True)).transpose(1, 0, 2)
    step = np.exp(moves - moves.max())
    there = np.arange(long)[:, None] < sizes
    alpha, beta, scale = np.empty((long, n, k)), np.ones((long, n, k)), np.ones((long, n, 1))
    alpha[0] = np.exp(first - first.max()) * seen[0]
    alpha[0] /= alpha[0].sum(1, keepdims=True)
    for t in range(1, long):
        a = (alpha[t - 1] @ step) * seen[t]
        c = np.maximum(a.sum(1, keepdims=True), 1e-300)
        go = there[t][:, None]
        alpha[t] = np.where(go, a / c, alpha[t - 1])
        scale[t] = np.where(go, c, 1.0)
    for t in range(long - 2, -1, -1):
        beta[t] = np.where(there[t + 1][:, None], (seen[t + 1] * beta[t + 1] / scale[t + 1]) @ step.T, 1.0)
    node = alpha * beta
    node *= there[:, :, None] / np.maximum(node.sum(2, keepdims=True), 1e-300)
    edge = np.zeros((k, k))
    for t in range(1, long):
        edge += alpha[t - 1].T @ (seen[t] * beta[t] / scale[t] * there[t][:, None])
    return node.transpose(1, 0, 2), edge * step


@dataclass
class Chain:
    """Weights of each state's features, of moves between states and of the first state."""

    vocabulary: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        v, w = self.vocabulary, self.weights
        return np.array([w[:, [v[f] for f in r if f in v]].sum(1) for r in rows])

    def best(self, rows: list[list[str]]) -> list[int]:
        """The likeliest states of a sequence."""
        e = self.scores(rows)
        best, back = self.first + e[0], []
        for i in range(1, len(e)):
            s = best[:, None] + self.moves
            back.append(s.argmax(0))
            best = s.max(0) + e[i]
        at = [int(best.argmax())]
        for b in reversed(back):
            at.append(int(b[at[-1]]))
        return at[::-1]


def fit_chain(sequences: list[list[list[str]]], known: list[list[set[int]]], states: int, l2: float = 1.0, steps: int = 150, rate: float = 0.1) -> Chain:
    """Fit on sequences of feature lists; ``known`` has the states that each item may have."""
    vocabulary: dict[str, int] = {}
    for seq in sequences:
        for row in seq:
            for f in row:
                vocabulary.setdefault(f, len(vocabulary))
    w, moves, first = np.zeros((states, len(vocabulary))), np.zeros((states, states)), np.zeros(states)
    pairs = [(s, k) for s, k in zip(sequences, known) if s]
    if not pairs:
        return Chain(vocabulary, w, moves, first)
    sizes = np.array([len(s) for s, _ in pairs])
    # equal rows are scored once
    distinct: dict[tuple[str, ...], int] = {}
    at = np.zeros((len(pairs), sizes.max()), np.int64)
    bar = np.full((len(pairs), sizes.max(), states), NEVER)
    for i, (seq, may) in enumerate(pairs):
        for j, (row, own) in enumerate(zip(seq, may)):
            at[i, j] = distinct.setdefault(tuple(row), len(distinct))
            bar[i, j, list(own)] = 0
        bar[i, len(seq) :] = 0
    has = np.zeros((len(distinct), len(vocabulary)))
    for row, i in distinct.items():
        for f in row:
            has[i, vocabulary[f]] += 1
    theta = [w, moves, first]
    m, v = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    for t in range(1, steps + 1):
        e = (has @ theta[0].T)[at]
        free, free_moves = marginals(e, theta[1], theta[2], sizes)
        told, told_moves = marginals(e + bar, theta[1], theta[2], sizes)
        d = told - free
        by_row = np.stack([np.bincount(at.ravel(), d[:, :, k].ravel(), len(distinct)) for k in range(states)])
        grads = [by_row @ has - l2 * theta[0], told_moves - free_moves - l2 * theta[1], d[:, 0].sum(0) - l2 * theta[2]]
        for k, g in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            theta[k] = theta[k] + rate * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return Chain(vocabulary, *theta)
