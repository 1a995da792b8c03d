"""Choosing members of an ensemble by what subsets of them are worth, from one aggregate of products of predictions.

The aggregate's side is the number of members plus two, whatever the number of rows; all subsets are then judged on it.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame

from quillon.operators.linear import gram

#: Members up to which Shapley values are computed over all coalitions, not sampled orders.
EXACT_MEMBERS = 12


def coalition_gain(g: np.ndarray, members: Sequence[int]) -> float:
    """How much the mean of some members' predictions lowers the mean squared error below that of the target's mean; 0 for none."""
    if not len(members):
        return 0.0
    n, last = g[0, 0], len(g) - 1
    w = np.zeros(len(g))
    w[[m + 1 for m in members]] = 1 / len(members)
    w[last] = -1.0
    return float((g[last, last] - g[0, last] ** 2 / n) / n - w @ g @ w / n)


def shapley_values(df: DataFrame, members: Sequence[str], y: str, orders: int = 2000, seed: int = 0) -> dict[str, tuple[float, float]]:
    """By member its Shapley value in coalition_gain and that value's standard error (0 where all coalitions are taken)."""
    g, m = gram(df, members, y), len(members)
    if m <= EXACT_MEMBERS:
        gain = {s: coalition_gain(g, s) for k in range(m + 1) for s in combinations(range(m), k)}
        return {name: (sum((gain[tuple(sorted((*s, i)))] - v) / (m * comb(m - 1, len(s))) for s, v in gain.items() if i not in s), 0.0) for i, name in enumerate(members)}
    rnd = np.random.default_rng(seed)
    shares = np.zeros((orders, m))
    for o in range(orders):
        before, order = 0.0, rnd.permutation(m)
        for k in range(m):
            after = coalition_gain(g, order[: k + 1])
            shares[o, order[k]], before = after - before, after
    error = shares.std(0, ddof=1) / orders**0.5
    return {name: (float(v), float(e)) for name, v, e in zip(members, shares.mean(0), error, strict=True)}


def shapley_pruned(df: DataFrame, members: Sequence[str], y: str, **options) -> list[str]:
    """The members whose Shapley value is above 0, the most valuable first; the best one where none is."""
    values = shapley_values(df, members, y, **options)
    order = sorted(members, key=lambda m: (-values[m][0], m))
    return [m for m in order if values[m][0] > 0] or order[:1]


def determinantal_kernel(g: np.ndarray) -> np.ndarray:
    """Members' kernel: the cosines of their errors, times both members' share of the target's deviation that they explain or a small floor."""
    n, last = g[0, 0], len(g) - 1
    m = len(g) - 2
    to_error = np.zeros((m, len(g)))
    to_error[np.arange(m), np.arange(1, m + 1)] = 1.0
    to_error[:, last] = -1.0
    errors = to_error @ g @ to_error.T / n
    size = np.sqrt(np.maximum(np.diag(errors), 1e-300))
    spread = max((g[last, last] - g[0, last] ** 2 / n) / n, 1e-300)
    quality = np.maximum(1 - size**2 / spread, 1e-3)
    return errors / np.outer(size, size) * np.outer(quality, quality)


def determinantal_choice(kernel: np.ndarray, k: int) -> list[int]:
    """k members, one by one the one that raises the kernel's determinant most; rows of a Cholesky factor grow with the choice.

    It ends where no other member is independent of the chosen ones. Ties go to the smaller number.
    """
    left, rows, chosen = np.diag(kernel).astype(float).copy(), np.zeros((0, len(kernel))), []
    for _ in range(min(k, len(kernel))):
        j = int(np.argmax(np.where(np.isin(np.arange(len(kernel)), chosen), -np.inf, left)))
        if left[j] <= 1e-12:
            break
        row = (kernel[j] - rows.T @ rows[:, j]) / np.sqrt(left[j])
        rows, left = np.vstack([rows, row]), left - row**2
        chosen.append(j)
    return chosen


def determinantal_members(df: DataFrame, members: Sequence[str], y: str, k: int) -> list[str]:
    """k members that are good and err differently, in the order of choice."""
    return [members[i] for i in determinantal_choice(determinantal_kernel(gram(df, members, y)), k)]
