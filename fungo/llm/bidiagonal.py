"""Singular values and right singular vectors of a small matrix: Householder bidiagonalisation, dqds, twisted factorisations."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Eigenvalues closer than this, relative to their size, are settled together.
CLOSE = 1e-4


def reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """v, b, a with (I - b v v') x = (a, 0, ..., 0)."""
    scale = np.abs(x).max()
    if scale == 0 or not x[1:].any():
        return np.zeros(len(x)), 0.0, float(x[0])
    v = x / scale
    size = float(np.sqrt(v @ v)) * (-1.0 if v[0] > 0 else 1.0)
    v[0] -= size
    return v, 2.0 / float(v @ v), size * scale


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and V with r = U B V' for some orthogonal U."""
    a, n = r.astype(float).copy(), r.shape[1]
    right, main, upper = np.eye(n), np.zeros(n), np.zeros(max(n - 1, 0))
    for k in range(n):
        v, b, main[k] = reflector(a[k:, k])
        if b:
            a[k:, k + 1:] -= np.outer(b * v, v @ a[k:, k + 1:])
        if k < n - 1:
            v, b, upper[k] = reflector(a[k, k + 1:])
            if b:
                a[k + 1:, k + 1:] -= np.outer(a[k + 1:, k + 1:] @ v, b * v)
                right[:, k + 1:] -= np.outer(right[:, k + 1:] @ v, b * v)
    return main, upper, right


def step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One qd step in differential form, and the least value met on the way: below zero the shift was too large."""
    new_q, new_e = [], []
    d = low = q[0] - shift
    for i in range(len(e)):
        s = d + e[i]
        new_q.append(s)
        ratio = q[i + 1] / s if s else 0.0
        new_e.append(e[i] * ratio)
        d = d * ratio - shift
        low = min(low, d)
    new_q.append(d)
    return new_q, new_e, low


def dqds(main: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the upper bidiagonal matrix, falling, each to high relative accuracy."""
    tiny = (4 * EPS) ** 2
    work, found = [([float(v) ** 2 for v in main], [float(v) ** 2 for v in upper], 0.0)], []
    while work:
        q, e, base = work.pop()
        while q:
            if len(q) == 1:
                found.append(base + q.pop())
                break
            if e[-1] <= tiny * (base + q[-1]) or e[-1] <= np.finfo(float).tiny:
                found.append(base + q.pop())
                e.pop()
                continue
            cut = next((i for i in range(len(e) - 2, -1, -1) if e[i] <= tiny * (base + min(q[i], q[i + 1]))), None)
            if cut is not None:
                work.append((q[:cut + 1], e[:cut], base))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if 1.5 * q[0] < q[-1]:  # the small end goes to the bottom
                q.reverse()
                e.reverse()
            # The smaller eigenvalue of the last two rows, held back a little, is the first guess.
            a, b, c = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
            gap = abs(a - b) / 2 + float(np.hypot((a - b) / 2, np.sqrt(c)))
            shift = max(0.0, (min(a, b) - (c / gap if gap else 0.0)) * (1 - 1e-3))
            for _ in range(6):
                new_q, new_e, low = step(q, e, shift)
                if low >= 0:
                    break
                shift = max(0.0, (shift + low) * 0.9) if shift + low > 0 else shift / 8
            else:
                shift = 0.0
                new_q, new_e, _ = step(q, e, 0.0)
            q, e, base = new_q, new_e, base + shift
    return np.sort(np.array(found))[::-1]


def twisted(d: np.ndarray, low: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """A vector from the twisted factorisation of L D L' - value at its best place, and the residual there over its squared length."""
    n = len(d)
    top, up, s = np.empty(n), np.empty(max(n - 1, 0)), np.empty(n)
    bottom, down, p = np.empty(n), np.empty(max(n - 1, 0)), np.empty(n)
    small = EPS * EPS * max(float(np.abs(d).max()), np.finfo(float).tiny)
    s[0] = -value
    for i in range(n):
        top[i] = s[i] + d[i]
        if abs(top[i]) < small:
            top[i] = -small
        if i < n - 1:
            up[i] = d[i] * low[i] / top[i]
            s[i + 1] = up[i] * low[i] * s[i] - value
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        bottom[i + 1] = d[i] * low[i] * low[i] + p[i + 1]
        if abs(bottom[i + 1]) < small:
            bottom[i + 1] = -small
        ratio = d[i] / bottom[i + 1]
        down[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - value
    gamma = s + p + value
    k = int(np.abs(gamma).argmin())
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -up[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -down[i] * z[i]
    size = float(z @ z)
    return z / np.sqrt(size), float(gamma[k]) / size


def solved(d: np.ndarray, low: np.ndarray, value: float, rows: np.ndarray) -> np.ndarray:
    """(L D L' - value)^-1 of some columns, by the factorisation from the top."""
    n, x = len(d), rows.copy()
    small = EPS * EPS * max(float(np.abs(d).max()), np.finfo(float).tiny)
    top, up, s = np.empty(n), np.empty(max(n - 1, 0)), -value
    for i in range(n):
        top[i] = s + d[i]
        if abs(top[i]) < small:
            top[i] = -small
        if i < n - 1:
            up[i] = d[i] * low[i] / top[i]
            s = up[i] * low[i] * s - value
            x[i + 1] -= up[i] * x[i]
    x /= top[:, None]
    for i in range(n - 2, -1, -1):
        x[i] -= up[i] * x[i + 1]
    return x


def vectors(main: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit right singular vectors of the bidiagonal matrix (columns) for its squared singular values, falling.

    Values that stand apart get the vector of a twisted factorisation; close ones get an orthonormal
    basis of their common space by inverse iteration, turned by the projected matrix."""
    least = EPS * EPS * max(float(np.abs(main).max(initial=0.0)), float(np.abs(upper).max(initial=0.0)), np.finfo(float).tiny)
    main = np.where(np.abs(main) < least, least, main)
    d, low = main * main, upper / main[:-1]
    b = np.diag(main) + np.diag(upper, 1)
    out, i, n = np.empty((len(main), len(values))), 0, len(values)
    draws = np.random.default_rng(1)
    while i < n:
        if values[i] <= (n * EPS) ** 2 * values[0]:  # no spread left: any basis of the rest
            out[:, i:] = np.linalg.qr(out[:, :i], mode="complete")[0][:, i:]
            break
        j = i + 1
        while j < n and values[j - 1] - values[j] <= CLOSE * values[j - 1]:
            j += 1
        if j == i + 1:
            z, off = twisted(d, low, float(values[i]))
            if abs(off) > EPS * values[i]:
                z, _ = twisted(d, low, float(values[i] + off))
            out[:, i] = z
        else:
            z = np.linalg.qr(draws.standard_normal((len(main), j - i)))[0]
            shift = float(values[i:j].mean()) * (1 + 8 * EPS)
            for _ in range(4):
                z = solved(d, low, shift, z)
                z /= np.abs(z).max(0)
                z = np.linalg.qr(z - out[:, :i] @ (out[:, :i].T @ z))[0]
            image = b @ z
            turn = np.linalg.eigh(image.T @ image)[1][:, ::-1]
            out[:, i:j] = z @ turn
        i = j
    return out


def right_vectors(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of r, falling, and its unit right singular vectors (columns), largest entry positive."""
    if not r.any():
        return np.zeros(r.shape[1]), np.eye(r.shape[1])
    main, upper, right = bidiagonal(r)
    values = np.maximum(dqds(main, upper), 0.0)
    found = right @ vectors(main, upper, values)
    found *= np.where(np.take_along_axis(found, np.abs(found).argmax(0)[None, :], 0) < 0, -1.0, 1.0)
    return values, found
