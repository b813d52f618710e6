"""The eigenvalues and eigenvectors of a scatter matrix, kept up to date by rank-one updates.

A spectrum stands for n rows: their mean m, and the eigenvalues and eigenvectors of the
sum of (x - m)(x - m)'. A rank-one update of diag(d) + rho z z' solves its secular equation

    1 + rho * sum_i z_i^2 / (d_i - mu) = 0,

which has one root between each two poles d_i. Entries of z that are as good as zero, and
poles as good as equal, are deflated first. The eigenvectors come from the z for which
the roots found are exact, so they are orthogonal whatever the gaps.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps


def _roots(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Matrix of d_i - mu_j for the roots mu_j of 1 + sum_i w_i / (d_i - mu); d rises, w > 0.

    Each root is sought as its distance from the nearer of its two poles, so that small distances
    keep all their digits.
    """
    k, total = len(d), w.sum()
    upper = np.append(d[1:], d[-1] + total)
    half = (upper - d) / 2
    at_half = 1 + (w[:, None] / ((d[:, None] - d[None, :]) - half[None, :])).sum(0)
    # The last root has no pole above it and stays with its own.
    right = at_half < 0
    right[-1] = False
    origin = np.where(right, upper, d)
    gaps = d[:, None] - origin[None, :]
    low = np.where(right, -half, np.where(at_half < 0, half, 0.0))
    high = np.where(right, 0.0, np.where(at_half < 0, 2 * half, half))
    tau = (low + high) / 2
    below = np.tri(k, dtype=bool).T  # poles i <= j
    j = np.arange(k)
    for _ in range(100):
        delta = gaps - tau
        terms = w[:, None] / delta
        slopes = terms / delta
        f = 1 + terms.sum(0)
        done = np.abs(f) <= 4 * _EPS * k * (1 + np.abs(terms).sum(0))
        low, high = np.where(f < 0, tau, low), np.where(f < 0, high, tau)
        done |= high - low <= 2 * _EPS * np.abs(tau)
        if done.all():
            break
        # Each half of the sum is replaced by a constant and its nearest pole; a quadratic is left.
        psi = np.where(below, slopes, 0.0).sum(0)
        phi = slopes.sum(0) - psi
        near, far = delta[j, j], upper - origin - tau
        c = f - near * psi - far * phi
        a = (near + far) * f - near * far * (psi + phi)
        b = near * far * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = near[-1] + near[-1] ** 2 * psi[-1] / (f[-1] - near[-1] * psi[-1])
        new = tau + step
        inside = (new > low) & (new < high)
        tau = np.where(done, tau, np.where(inside, new, (low + high) / 2))
    return gaps - tau, origin + tau


class Spectrum:
    """n rows, their mean, and the spectrum of their scatter matrix; eigenvalues rise, eigenvectors are columns."""

    def __init__(self, dims: int):
        self.n, self.mean = 0, np.zeros(dims)
        self.values, self.vectors = np.zeros(dims), np.eye(dims)

    def rank_one(self, v: np.ndarray, rho: float = 1.0) -> None:
        """Add rho v v' to the matrix; rho is positive."""
        d, q = self.values, self.vectors
        z = q.T @ v
        weight = rho * float(z @ z)
        if weight == 0.0:
            return
        scale = max(float(d[-1]), weight)
        tiny = 8 * _EPS * scale
        kept = np.flatnonzero(np.sqrt(rho * scale) * np.abs(z) > tiny)
        close = np.flatnonzero(np.diff(d[kept]) <= tiny) if len(kept) > 1 else []
        if len(close):
            # Turn equal poles so that only the last of them meets z.
            q, gone = q.copy(), []
            for a in close:
                i, j = kept[a], kept[a + 1]
                r = np.hypot(z[i], z[j])
                c, s = z[j] / r, z[i] / r
                q[:, i], q[:, j] = c * q[:, i] - s * q[:, j], s * q[:, i] + c * q[:, j]
                z[i], z[j] = 0.0, r
                gone.append(a)
            kept = np.delete(kept, gone)
        values, vectors = d.copy(), q
        if len(kept):
            poles, zk = d[kept], z[kept]
            delta, mu = _roots(poles, rho * zk * zk)
            between = poles[:, None] - poles[None, :]
            np.fill_diagonal(between, 1.0)
            exact = np.sqrt(np.abs((delta / between).prod(1))) * np.sign(zk)
            u = exact[:, None] / delta
            u /= np.sqrt((u * u).sum(0))
            vectors = q.copy() if vectors is self.vectors else vectors
            vectors[:, kept] = q[:, kept] @ u
            values[kept] = mu
        order = np.argsort(values, kind="stable")
        self.values, self.vectors = values[order], vectors[:, order]

    def add_rows(self, x: np.ndarray) -> None:
        """Add rows. More rows than columns are first brought to a triangle with the same scatter."""
        if not len(x):
            return
        mean = x.mean(0)
        centred = x - mean
        if len(x) > x.shape[1]:
            centred = np.linalg.qr(centred, mode="r")
        self._meet(len(x), mean)
        for row in centred:
            self.rank_one(row)

    def add(self, other: Spectrum) -> None:
        """Add another spectrum, one rank-one update for each of its eigenvectors."""
        self._meet(other.n, other.mean)
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.rank_one(vector, value)

    def _meet(self, n: int, mean: np.ndarray) -> None:
        """The part of the scatter between two sets of rows, and the mean of both."""
        if self.n and n:
            self.rank_one(mean - self.mean, self.n * n / (self.n + n))
        if n:
            self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
            self.n += n
