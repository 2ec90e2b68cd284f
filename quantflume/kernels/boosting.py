"""Boosted regression trees on binned features, for data of one task."""

from __future__ import annotations

import numpy as np

#: Bins of a feature at most.
BINS = 255


def bin_edges(x: np.ndarray) -> list[np.ndarray]:
    """Per column the cuts between bins: midpoints of its values, or of their quantiles where there are more than ``BINS``."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > BINS:
            values = np.unique(np.quantile(column, np.linspace(0, 1, BINS)))
        out.append((values[:-1] + values[1:]) / 2)
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T, strict=True)], axis=1)


def best_split(bins: np.ndarray, rest: np.ndarray, width: int, least: int) -> tuple[float, int, int]:
    """(gain in squared error, feature, last bin of the left side); no gain if there is no split with ``least`` rows on both sides."""
    n, features = bins.shape
    place = (bins + np.arange(features) * width).ravel()
    count = np.bincount(place, minlength=features * width).reshape(features, width).cumsum(axis=1)
    total = np.bincount(place, weights=np.repeat(rest, features), minlength=features * width).reshape(features, width).cumsum(axis=1)
    whole = total[0, -1]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = total**2 / count + (whole - total) ** 2 / (n - count) - whole * whole / n
    gain[(count < least) | (n - count < least)] = -np.inf
    at = int(gain.argmax())
    return float(gain.flat[at]), at // width, at % width


def predictions(x: np.ndarray, y: np.ndarray, unseen: np.ndarray, rounds: int = 200, rate: float = 0.05, leaves: int = 15, least: int = 20) -> np.ndarray:
    """Predictions for the rows ``unseen`` of trees fitted on (x, y) by squared error, best split first."""
    edges = bin_edges(x)
    own, others, width = binned(x, edges), binned(unseen, edges), max(map(len, edges), default=0) + 1
    fit, out = np.full(len(y), y.mean()), np.full(len(unseen), y.mean())
    for _ in range(rounds):
        rest = y - fit
        nodes = [(np.arange(len(y)), np.arange(len(unseen)))]
        splits = [best_split(own, rest, width, least)]
        while len(nodes) < leaves:
            k = max(range(len(nodes)), key=lambda i: splits[i][0])
            gain, feature, cut = splits[k]
            if not gain > 1e-12:
                break
            rows, far = nodes[k]
            left, near = own[rows, feature] <= cut, others[far, feature] <= cut
            for at, node in ((k, (rows[left], far[near])), (len(nodes), (rows[~left], far[~near]))):
                split = best_split(own[node[0]], rest[node[0]], width, least)
                nodes[at:at + 1], splits[at:at + 1] = [node], [split]
        for rows, far in nodes:
            step = rate * rest[rows].mean()
            fit[rows] += step
            out[far] += step
    return out
