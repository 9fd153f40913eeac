"""Leading eigenpairs of a real symmetric matrix: tridiagonal form, bisection by Sturm counts, inverse iteration.

The matrix is as wide as a vector, so all of this is a small, bounded step of the driver.
"""

from __future__ import annotations

import numpy as np

#: Eigenvalues nearer than this part of the norm share a cluster, whose vectors are orthogonalised against each other.
CLUSTER = 1e-3
ROUNDS = 6


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit Householder vectors (from the first column on) that lead there."""
    a = np.array(matrix, np.float64)
    d = len(a)
    mirrors = []
    for k in range(d - 2):
        x = a[k + 1:, k]
        v = x.copy()
        size = np.linalg.norm(x[1:])
        if size == 0.0:  # nothing to annihilate
            mirrors.append(np.zeros(0))
            continue
        v[0] += np.copysign(np.hypot(x[0], size), x[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        w = 2.0 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1:, k] -= 2.0 * (v @ x) * v
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def larger_than(diagonal: np.ndarray, off: np.ndarray, points: np.ndarray, tiny: float) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix are larger than each point."""
    count = np.zeros(len(points), np.int64)
    pivot = np.ones(len(points))
    for i, value in enumerate(diagonal):
        coupling = off[i - 1] ** 2 / pivot if i else 0.0
        pivot = value - points - coupling
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot > 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, many: int) -> np.ndarray:
    """The ``many`` largest eigenvalues, falling, each bisected to neighbouring doubles of the norm's size."""
    radius = np.zeros(len(diagonal))
    radius[:-1] += np.abs(off)
    radius[1:] += np.abs(off)
    norm = max(np.max(np.abs(diagonal) + radius), np.finfo(float).tiny)
    tiny = np.finfo(float).eps ** 2 * norm
    low = np.full(many, np.min(diagonal - radius) - 2 * np.finfo(float).eps * norm)
    high = np.full(many, np.max(diagonal + radius) + 2 * np.finfo(float).eps * norm)
    rank = np.arange(many)
    while True:
        middle = (low + high) / 2
        open_ = (middle > low) & (middle < high) & (high - low > np.finfo(float).eps * np.abs(middle) / 2)
        if not open_.any():
            return (low + high) / 2
        above = larger_than(diagonal, off, middle, tiny) > rank
        low = np.where(open_ & above, middle, low)
        high = np.where(open_ & ~above, middle, high)


def solve_tridiagonal(diagonal: np.ndarray, off: np.ndarray, right: np.ndarray, tiny: float) -> np.ndarray:
    """Gaussian elimination with row exchanges; vanishing pivots become ``tiny``."""
    n = len(diagonal)
    main, upper, second = diagonal.copy(), np.append(off, 0.0), np.zeros(n)
    b = right.copy()
    for i in range(n - 1):
        below = off[i]
        if abs(main[i]) < abs(below):
            next_main, next_upper = main[i + 1], upper[i + 1]
            ratio = main[i] / below
            main[i], main[i + 1] = below, upper[i] - ratio * next_main
            upper[i], second[i], upper[i + 1] = next_main, next_upper, -ratio * next_upper
            b[i], b[i + 1] = b[i + 1], b[i] - ratio * b[i + 1]
        else:
            if abs(main[i]) < tiny:
                main[i] = tiny
            ratio = below / main[i]
            main[i + 1] -= ratio * upper[i]
            b[i + 1] -= ratio * b[i]
    out = np.zeros(n)
    for i in range(n - 1, -1, -1):
        pivot = main[i] if abs(main[i]) >= tiny else tiny
        rest = b[i]
        if i + 1 < n:
            rest -= upper[i] * out[i + 1]
        if i + 2 < n:
            rest -= second[i] * out[i + 2]
        out[i] = rest / pivot
    return out


def leading_eigenpairs(matrix: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``many`` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    d = len(matrix)
    many = min(many, d)
    scale = np.max(np.abs(matrix)) if d else 0.0
    if many == 0 or scale == 0.0:
        return np.zeros(many), np.eye(d, many)
    diagonal, off, mirrors = tridiagonal(matrix / scale)
    values = leading_eigenvalues(diagonal, off, many)
    norm = np.max(np.abs(diagonal)) + (2 * np.max(np.abs(off)) if d > 1 else 0.0)
    tiny = np.finfo(float).eps * norm
    random = np.random.default_rng(d)
    vectors = np.zeros((d, many))
    first_of_cluster = 0
    shift = np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first_of_cluster = j
        # Equal values get shifts a little apart, else they all lead to the same vector.
        shift = min(value, shift - 2 * tiny) if j > first_of_cluster else value
        near = vectors[:, first_of_cluster:j]
        y = random.uniform(-1.0, 1.0, d)
        for _ in range(ROUNDS):
            y = solve_tridiagonal(diagonal - shift, off, y / np.max(np.abs(y)), tiny)
            y /= np.linalg.norm(y)
            for _ in range(2):
                y -= near @ (near.T @ y)
                y /= np.linalg.norm(y)
        vectors[:, j] = y
    for k in range(len(mirrors) - 1, -1, -1):
        v = mirrors[k]
        if len(v):
            vectors[k + 1:] -= 2.0 * np.outer(v, v @ vectors[k + 1:])
    return values * scale, vectors / np.linalg.norm(vectors, axis=0)
