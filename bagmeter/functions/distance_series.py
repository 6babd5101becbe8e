"""Sums of Euclidean distances to many vectors by a series, in time that grows with the vectors and not with their pairs.

Seen from the mean of the vectors y, the distance of x and y follows from both radii and the cosine t of their angle.
It is expanded in the polynomials of t that are orthogonal for uniform directions, up to ``DEGREE``, with coefficients
interpolated in the radius of y. All that is needed of the y are sums of products of up to ``DEGREE`` coordinates.
Vectors that stray to the centre of another class are few and are expanded there, up to the second power.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

#: Highest power of the cosine.
DEGREE = 4
#: Radii between which coefficients are interpolated: of the polynomials up to the second, and of the others, which count little.
NODES = (8, 4)
#: Cosines at which a distance is read to get its coefficients.
COSINES = 12
#: Least and greatest width of vectors: fewer dimensions have no such series, more need sums that are too large.
WIDTHS = (3, 32)
#: By what factor another centre is nearer to a vector that strays.
STRAY = 1.25
#: Rows taken at once.
ROWS = 512



@cache
def _cosines(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gauss points of the cosine for uniform directions, the matrix from values there to coefficients, and the polynomials' powers."""
    half, k = (width - 2) / 2, np.arange(1, COSINES)
    off = np.sqrt(k * (k + 2 * half - 1) / (4 * (k + half) * (k + half - 1)))
    t, v = np.linalg.eigh(np.diag(off, 1) + np.diag(off, -1))
    powers = np.zeros((DEGREE + 1, DEGREE + 1))
    powers[0, 0] = 1
    for i in range(1, DEGREE + 1):
        powers[i, 1:] = powers[i - 1, :-1]
        if i > 1:
            powers[i] -= off[i - 2] * powers[i - 2]
        powers[i] /= off[i - 1]
    return t, (v[0] ** 2)[:, None] * (t[:, None] ** np.arange(DEGREE + 1) @ powers.T), powers


def _nodes(low: float, high: float, count: int) -> np.ndarray:
    return (low + high) / 2 + (high - low) / 2 * np.cos((np.arange(count) + 0.5) * np.pi / count)


def _shares(radius: np.ndarray, low: float, high: float, count: int) -> np.ndarray:
    """What each node counts in the interpolation at each radius."""
    at = np.arccos(np.clip((2 * radius - low - high) / max(high - low, 1e-300), -1, 1))
    k = np.arange(count)
    return (np.cos(at[:, None] * k) * np.where(k == 0, 1, 2) / count) @ np.cos(np.outer(k, (k + 0.5) * np.pi / count))


def _polar(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    away = x - centre
    radius = np.sqrt((away * away).sum(1))
    return radius, away / np.maximum(radius, 1e-300)[:, None]


def _products(u: np.ndarray) -> np.ndarray:
    """Products of two coordinates, so that the scalar product of two such rows is the square of that of their vectors."""
    i, j = np.triu_indices(u.shape[1])
    return u[:, i] * (u[:, j] * np.where(i == j, 1, np.sqrt(2)))


def nearest(x: np.ndarray, y: int, centres: dict[int, np.ndarray]) -> np.ndarray:
    """The class at whose centre each vector of class ``y`` counts: its own, unless another is nearer by far."""
    names = list(centres)
    far = np.sqrt(np.stack([((x - centres[i]) ** 2).sum(1) for i in names]))
    other = np.argmin(far, axis=0)
    return np.where(far.min(axis=0) * STRAY < far[names.index(y)], np.array(names)[other], y)


@dataclass
class Series:
    """Weighted vectors around the centre of a class, in that range of radii.

    ``sums`` by node: for the powers of the cosine up to 2 by class, then those of the class ``own`` alone for all powers.
    """

    own: int
    classes: int
    centre: np.ndarray
    low: float
    high: float
    sums: list[np.ndarray]

    @classmethod
    def empty(cls, own: int, classes: int, centre: np.ndarray, low: float, high: float) -> Series:
        width = len(centre)
        pairs = width * (width + 1) // 2
        small = [(1, 1), (width, 1), (pairs, 1)]
        parts = [(s, NODES[0] * classes) for s in small] + [(s, NODES[1]) for s in [*small, (pairs, width), (pairs, pairs)]]
        return cls(own, classes, centre, low, high, [np.zeros((a, n * b)) for (a, b), n in parts])

    def add(self, x: np.ndarray, weight: np.ndarray, of: int) -> None:
        columns = slice(NODES[0] * of, NODES[0] * (of + 1))
        for i in range(0, len(x), ROWS):
            radius, u = _polar(x[i : i + ROWS], self.centre)
            many, few = (_shares(radius, self.low, self.high, n) * weight[i : i + ROWS, None] for n in NODES)
            pairs = _products(u)
            for at, left in enumerate((np.ones((len(u), 1)), u, pairs)):
                self.sums[at][:, columns] += left.T @ many
                if of == self.own:
                    self.sums[at + 3] += left.T @ few
            if of == self.own:
                few, pairs = few.astype(np.float32)[:, :, None], pairs.astype(np.float32)  # the third and fourth power count little
                for at, right in ((6, u.astype(np.float32)), (7, pairs)):
                    self.sums[at] += pairs.T @ (few * right[:, None]).reshape(len(u), -1)

    def _coefficients(self, radius: np.ndarray, count: int, some: slice) -> np.ndarray:
        t, project, _ = _cosines(len(self.centre))
        node = _nodes(self.low, self.high, count)
        square = (radius[:, None] ** 2 + node**2)[:, :, None] - 2 * (radius[:, None] * node)[:, :, None] * t
        return np.sqrt(np.maximum(square, 0, out=square), out=square) @ project[:, some]

    def distances(self, x: np.ndarray, itself: tuple[int, np.ndarray] | None = None, whole: bool = True) -> np.ndarray:
        """Sums of the distances of each row of ``x`` to the vectors by class, and what the last polynomial adds to them.

        ``itself``: class and weights with which the rows are among the vectors themselves; what the series takes for their distance of
        0 is left out. Unless ``whole`` the sums of the class ``own`` stop at the second power.
        """
        powers = _cosines(len(self.centre))[2]
        third, fourth = (s.astype(np.float32) for s in self.sums[6:])
        out = np.zeros((2, self.classes, len(x)))
        for i in range(0, len(x), ROWS):
            radius, u = _polar(x[i : i + ROWS], self.centre)
            pairs = _products(u)
            c = self._coefficients(radius, NODES[0], slice(0, 3))
            for at, left in enumerate((np.ones((len(u), 1)), u, pairs)):
                value = (left @ self.sums[at]).reshape(len(u), self.classes, NODES[0])
                if itself:
                    value[:, itself[0]] -= _shares(radius, self.low, self.high, NODES[0]) * itself[1][i : i + ROWS, None]
                out[0, :, i : i + ROWS] += np.matmul(value, (c @ powers[:3, at])[:, :, None])[:, :, 0].T
                out[1, :, i : i + ROWS] += np.matmul(value, c[:, :, 2:])[:, :, 0].T * powers[2, at]
            if not whole:
                continue
            small = pairs.astype(np.float32)
            values = [left @ s for left, s in zip((np.ones((len(u), 1)), u, pairs), self.sums[3:])]
            for s, right in ((third, u.astype(np.float32)), (fourth, small)):
                values.append(np.matmul((small @ s).reshape(len(u), NODES[1], -1), right[:, :, None])[:, :, 0])
            c = self._coefficients(radius, NODES[1], slice(3, DEGREE + 1))
            out[1, self.own, i : i + ROWS] = 0
            for at, value in enumerate(values):
                if itself and itself[0] == self.own:
                    value = value - _shares(radius, self.low, self.high, NODES[1]) * itself[1][i : i + ROWS, None]
                out[0, self.own, i : i + ROWS] += ((c @ powers[3:, at]) * value).sum(1)
                out[1, self.own, i : i + ROWS] += (c[:, :, -1] * value).sum(1) * powers[DEGREE, at]
        return out
