"""Small linear programs inside tasks: a revised simplex on numpy arrays."""

from __future__ import annotations

import numpy as np


def simplex(a: np.ndarray, b: np.ndarray, c: np.ndarray, basis: list[int], eps: float = 1e-9) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(basis, values of the basis, prices of the rows) at the least c x with a x = b, x >= 0, from a feasible basis.

    Steepest prices first; after a while of steps that gain nothing, the first
    column that may enter does, which ends any cycle.
    """
    basis, still = list(basis), 0
    for step_no in range(100 * sum(a.shape)):
        if step_no % 50 == 0:
            inverse = np.linalg.inv(a[:, basis])
        x = inverse @ b
        y = c[basis] @ inverse
        reduced = c - y @ a
        reduced[basis] = 0.0
        if reduced.min() >= -eps:
            return basis, x, y
        enter = int(np.flatnonzero(reduced < -eps)[0]) if still > len(b) else int(reduced.argmin())
        step = inverse @ a[:, enter]
        ratio = np.where(step > eps, np.maximum(x, 0.0) / np.where(step > eps, step, 1.0), np.inf)
        if not np.isfinite(ratio.min()):
            raise ArithmeticError("the program has no least value")
        tied = np.flatnonzero(ratio <= ratio.min() + 1e-12)
        leave = int(min(tied, key=lambda i: basis[i]) if still > len(b) else max(tied, key=lambda i: step[i]))
        still = 0 if ratio.min() > 1e-12 else still + 1
        basis[leave] = enter
        pivot = inverse[leave] / step[leave]
        inverse = inverse - np.outer(step, pivot)
        inverse[leave] = pivot
    raise ArithmeticError("the simplex did not end")
