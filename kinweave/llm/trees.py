"""Small decision trees, learnt on the driver from a bounded sample and compiled into SQL text.

Learning sees at most the sample's rows; applying a tree is a CASE expression that Spark runs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Node:
    """A split ``feature <= threshold`` with its two sides, or a leaf (feature -1) with its value."""

    value: float
    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None


def _best_split(x: np.ndarray, y: np.ndarray, features: np.ndarray, min_leaf: int) -> tuple[float, int, float]:
    """(gain in squared error, feature, threshold) of the best split; the gain is 0 if there is none."""
    best, n, total = (0.0, -1, 0.0), len(y), y.sum()
    base = total * total / n
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, s = x[order, f], np.cumsum(y[order])[:-1]
        k = np.arange(1, n)
        gain = s * s / k + (total - s) ** 2 / (n - k) - base
        gain[(v[1:] == v[:-1]) | (k < min_leaf) | (n - k < min_leaf)] = 0
        i = int(np.argmax(gain))
        if gain[i] > best[0] + 1e-9:
            best = (float(gain[i]), int(f), float((v[i] + v[i + 1]) / 2))
    return best


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int, min_leaf: int, rng: np.random.Generator, features: int | None = None) -> Node:
    """A regression tree; each split chooses among ``features`` columns drawn at random (all if None)."""
    node = Node(float(y.mean()))
    if depth == 0 or len(y) < 2 * min_leaf or y.min() == y.max():
        return node
    columns = np.arange(x.shape[1]) if features is None else rng.choice(x.shape[1], features, replace=False)
    gain, f, t = _best_split(x, y, columns, min_leaf)
    if gain > 0:
        low = x[:, f] <= t
        node.feature, node.threshold = f, t
        node.left = fit_tree(x[low], y[low], depth - 1, min_leaf, rng, features)
        node.right = fit_tree(x[~low], y[~low], depth - 1, min_leaf, rng, features)
    return node


def predict(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.threshold, predict(node.left, x), predict(node.right, x))


def to_sql(node: Node, names: list[str]) -> str:
    """The tree as a CASE expression over columns."""
    if node.feature < 0:
        return f"{node.value!r}D"
    return f"CASE WHEN {names[node.feature]} <= {node.threshold!r}D THEN {to_sql(node.left, names)} ELSE {to_sql(node.right, names)} END"


def random_forest(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int, min_leaf: int = 2) -> list[Node]:
    """Trees on bootstrap samples, each split among the square root of the columns."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(fit_tree(x[rows], y[rows], depth, min_leaf, rng, max(1, round(x.shape[1] ** 0.5))))
    return out


def forest_sql(trees: list[Node], names: list[str]) -> str:
    """The forest's mean as an expression."""
    return "(" + " + ".join(f"({to_sql(t, names)})" for t in trees) + f") / {len(trees)}.0D"
