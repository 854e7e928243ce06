"""Eigenvectors of a symmetric matrix by mixed precision: single-precision
vectors, corrected by matrix products in higher precision (the refinement of
Ogita and Aishima), with sub-solves for eigenvalues that lie too close.

One step, for approximate vectors X of A, takes R = I - X'X and S = X'AX, the
eigenvalues l_i = S_ii / (1 - R_ii), and adds X E to X, where
E_ij = (S_ij + l_j R_ij) / (l_j - l_i) for eigenvalues that are told apart and
R_ij / 2 otherwise. Its error falls quadratically. Eigenvalues nearer to each other than
the error bound 2 (|S - D| + |A| |R|) form a cluster: there the step only makes
the vectors orthonormal, so the small matrix of A on the cluster's space, less
the cluster's mean, is solved on its own and its vectors turn those of the cluster.
Steps with E = R / 2 alone end the work.
"""

from __future__ import annotations

import numpy as np

MAX_STEPS = 12


def _step(a: np.ndarray, x: np.ndarray):
    """(values, R, S, distance under which two eigenvalues are one)."""
    r = np.eye(x.shape[1], dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diagonal(s) / (1 - np.diagonal(r))
    off = np.abs(s - np.diag(values)).sum(axis=1).max()
    norm = np.abs(a).sum(axis=1).max()
    # rounding leaves errors of eps in S, so gaps under the root of eps are left to the sub-solves too
    bound = max(2 * (off + norm * np.abs(r).sum(axis=1).max()), np.finfo(a.dtype).eps ** 0.5 * norm)
    return values, r, s, bound


def _correct(x, values, r, s, bound):
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > bound
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return x + x @ e, float(np.abs(e).max(initial=0))


def clusters(values: np.ndarray, bound) -> list[np.ndarray]:
    """Index groups of two and more eigenvalues linked by gaps up to ``bound``."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > bound) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def refine(a: np.ndarray, x: np.ndarray, steps: int = MAX_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of ``a`` from approximate vectors ``x``, in the
    precision of ``a``. Stops when a step no longer makes the correction smaller."""
    x = x.astype(a.dtype)
    eps, last = float(np.finfo(a.dtype).eps), np.inf
    for _ in range(steps):
        values, r, s, bound = _step(a, x)
        x, change = _correct(x, values, r, s, bound)
        for group in clusters(values, bound):
            base = x[:, group]
            mean = values[group].mean()
            small = base.T @ (a @ base - mean * base)
            # the difference to the mean is small, so double precision holds its digits
            _, turn = np.linalg.eigh(((small + small.T) / 2).astype(np.float64))
            x[:, group] = base @ turn.astype(a.dtype)
        if change < 4 * eps or (change >= last / 2 and change < eps ** 0.5):
            break
        last = change
    for _ in range(2):  # orthonormal to the last digit
        x = x + x @ (np.eye(x.shape[1], dtype=a.dtype) - x.T @ x) / 2
    return _step(a, x)[0], x


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric
    matrix, both rounded to double precision: float32 start, float64 steps, and
    the last steps in the platform's extended precision. Where eigenvalues are
    equal, any orthonormal basis of their space. The largest entry of a
    vector is positive (the first one of several)."""
    a = np.asarray(a, np.float64)
    scale = np.abs(a).max(initial=0)
    if not scale:
        return np.zeros(len(a)), np.eye(len(a))
    small = a / scale
    _, x = np.linalg.eigh(small.astype(np.float32))
    _, x = refine(small, x)
    values, x = refine(small.astype(np.longdouble), x, 2)
    order = np.argsort(-values, kind="stable")
    values, x = (values[order] * np.longdouble(scale)).astype(np.float64), x[:, order].astype(np.float64)
    top = np.argmax(np.abs(x), axis=0)
    return values, x * np.where(x[top, np.arange(x.shape[1])] < 0, -1.0, 1.0)
