"""Embeddings of bags, averaged into a linear softmax; both are trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

Bag = tuple[np.ndarray, np.ndarray]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(bags: list[Bag], labels: np.ndarray, buckets: int, dim: int = 8, epochs: int = 12, batch: int = 64, speed: float = 8.0, least_texts: int = 5, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights of buckets and a bias: bias + sum of shares * weights is the log-odds of label 1.

    Weights are the products of the buckets' embeddings with the difference of the softmax's two rows. Steps are plain
    stochastic descent: buckets of few texts then learn little and don't memorise them; those under least_texts don't
    learn and leave the list of bags, in place. Deterministic for the same bags in the same order. Without two classes the
    weights are 0.
    """
    labels = np.asarray(labels, dtype=np.int64)
    prior = (labels.sum() + 0.5) / (len(labels) + 1)
    bias = float(np.log(prior / (1 - prior)))
    seen = np.zeros(buckets, np.int64)
    for at, _ in bags:
        seen[at] += 1
    for i, (at, share) in enumerate(bags):
        if not (known := seen[at] >= least_texts).all():
            bags[i] = at[known], share[known]
    rows = np.array([i for i, (at, _) in enumerate(bags) if len(at)], dtype=np.int64)
    if not len(rows) or len(set(labels[rows])) < 2:
        return np.zeros(buckets, np.float32), bias
    rate = speed / float(np.mean([(bags[i][1] ** 2).sum() for i in rows]))
    while True:
        with np.errstate(all="ignore"):
            weights, b = _descend(bags, labels, rows, buckets, dim, epochs, batch, rate, prior, seed)
        if np.isfinite(weights).all() and np.isfinite(b):
            return np.where(seen >= least_texts, weights, 0).astype(np.float32), b
        rate /= 2


def _descend(bags, labels, rows, buckets, dim, epochs, batch, rate, prior, seed):
    rng = np.random.default_rng(seed)
    embedding = rng.uniform(-0.1 / dim, 0.1 / dim, (buckets, dim)).astype(np.float32)
    soft = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    bias = np.log([1 - prior, prior]).astype(np.float32)
    step, steps = 0, epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        order = rng.permutation(rows)
        for k in range(0, len(order), batch):
            now = order[k : k + batch]
            sizes = np.array([len(bags[i][0]) for i in now])
            at, share = np.concatenate([bags[i][0] for i in now]), np.concatenate([bags[i][1] for i in now])
            hidden = np.add.reduceat(embedding[at] * share[:, None], np.cumsum(sizes) - sizes, axis=0)
            z = hidden @ soft + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(now)), labels[now]] -= 1
            p /= len(now)
            back = np.repeat(p @ soft.T, sizes, axis=0) * share[:, None]
            by = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[by], prepend=-1))
            down = 1 - step / steps
            embedding[at[by][first]] -= np.float32(rate * down) * np.add.reduceat(back[by], first, axis=0)
            soft -= np.float32(down) * (hidden.T @ p)
            bias -= np.float32(down) * p.sum(axis=0)
            step += 1
    return embedding @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0])


def log_odds(bags: Sequence[Bag], weights: np.ndarray, bias: float) -> np.ndarray:
    return np.array([float((weights[at] * share).sum()) for at, share in bags]) + bias


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Coefficients of a small logistic regression (the last is the intercept), by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w
