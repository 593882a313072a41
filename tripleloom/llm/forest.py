"""A small random forest: trained on the driver over a bounded labelled sample, applied as a Catalyst expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

@dataclass(frozen=True)
class Node:
    value: float  # a share of positives
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None


def best_split(x: np.ndarray, y: np.ndarray, features: np.ndarray, cuts: int) -> tuple[float, int, float]:
    """Lowest weighted Gini impurity; (impurity, feature, limit), feature -1 if nothing splits."""
    best = (2 * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
    for f in features.tolist():
        values = np.unique(x[:, f])
        if len(values) < 2:
            continue
        limits = (values[1:] + values[:-1]) / 2
        limits = limits[np.unique(np.linspace(0, len(limits) - 1, cuts).astype(int))]
        left = x[:, f][None, :] <= limits[:, None]
        n = left.sum(axis=1)
        p, q = (left @ y) / n, ((~left) @ y) / (len(y) - n)
        gini = (n * 2 * p * (1 - p) + (len(y) - n) * 2 * q * (1 - q)) / len(y)
        k = int(gini.argmin())
        if gini[k] < best[0]:
            best = (float(gini[k]), f, float(limits[k]))
    return best


def grow(x: np.ndarray, y: np.ndarray, depth: int, tried: int, rng: np.random.Generator, cuts: int = 24, least: int = 5) -> Node:
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return Node(share)
    _, f, limit = best_split(x, y, rng.permutation(x.shape[1])[:tried], cuts)
    left = x[:, f] <= limit
    if f < 0 or left.sum() < least or (~left).sum() < least:
        return Node(share)
    return Node(share, f, limit, grow(x[left], y[left], depth - 1, tried, rng, cuts, least), grow(x[~left], y[~left], depth - 1, tried, rng, cuts, least))


def train(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 6, seed: int = 3) -> list[Node]:
    """Bagged trees over random feature subsets."""
    rng = np.random.default_rng(seed)
    tried = max(2, int(np.ceil(np.sqrt(x.shape[1]))) + 1)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(grow(x[rows], y[rows].astype(np.float64), depth, tried, rng))
    return out


def predict(trees: list[Node], row: np.ndarray) -> float:
    total = 0.0
    for node in trees:
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.limit else node.high
        total += node.value
    return total / len(trees)


def expression(trees: list[Node], feature: Callable[[int], str]) -> str:
    """The forest's mean vote as one SQL expression; ``feature`` gives a feature's SQL."""

    def of(node: Node) -> str:
        if node.feature < 0:
            return f"{node.value!r}D"
        return f"CASE WHEN {feature(node.feature)} <= {node.limit!r}D THEN {of(node.low)} ELSE {of(node.high)} END"

    return f"({' + '.join(map(of, trees))}) / {len(trees)}D"
