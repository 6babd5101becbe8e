"""Small numeric solvers that run inside tasks, many bags at a time."""

from __future__ import annotations

import numpy as np


def to_simplex(v: np.ndarray) -> np.ndarray:
    """The nearest point with entries from 0 that add up to 1, of a vector or of each row; equal shares if a value isn't finite."""
    rows = np.atleast_2d(v)
    k = rows.shape[1]
    finite = np.isfinite(rows).all(axis=1)
    safe = np.where(finite[:, None], rows, 0.0)
    u = np.sort(safe, axis=1)[:, ::-1]
    excess = (np.cumsum(u, axis=1) - 1) / np.arange(1, k + 1)
    last = k - 1 - (u > excess)[:, ::-1].argmax(axis=1)
    out = np.where(finite[:, None], np.maximum(safe - excess[np.arange(len(rows)), last][:, None], 0), 1 / k)
    return out.reshape(np.shape(v))


def _starts(start: np.ndarray | None, n: int, k: int) -> np.ndarray:
    return np.full((n, k), 1 / k) if start is None else np.repeat(to_simplex(np.asarray(start, dtype=float))[None], n, axis=0)


def least_squares(c: np.ndarray, q: np.ndarray, start: np.ndarray | None = None, rounds: int = 2000, tolerance: float = 1e-12) -> np.ndarray:
    """min |q - C p| over the simplex, by accelerated projected gradients, of a vector q or of each row at once.

    Degenerate input gives a point of the simplex.
    """
    many = np.atleast_2d(q)
    k = c.shape[1]
    gram, target = c.T @ c, many @ c
    p = _starts(start, len(many), k)
    live = np.flatnonzero(np.isfinite(target).all(axis=1)) if np.isfinite(gram).all() else np.zeros(0, int)
    step = 1 / max(float(np.linalg.norm(gram, 2)), 1e-12) if len(live) else 0.0
    descend = lambda x, rows: to_simplex(x - step * (x @ gram - target[rows]))
    look, momentum = p.copy(), np.ones(len(many))
    for _ in range(rounds):
        if not len(live):
            break
        fresh = descend(look[live], live)
        still = np.abs(fresh - p[live]).max(axis=1) < tolerance
        grown = (1 + np.sqrt(1 + 4 * momentum[live] ** 2)) / 2
        look[live] = fresh + ((momentum[live] - 1) / grown)[:, None] * (fresh - p[live])
        momentum[live], p[live] = grown, fresh
        if still.any():
            # settled only if a plain step from here stays here; else the momentum had overshot
            rows = live[still]
            plain = descend(fresh[still], rows)
            done = np.abs(plain - fresh[still]).max(axis=1) < tolerance
            more = rows[~done]
            look[more], momentum[more], p[more] = plain[~done], 1.0, plain[~done]
            live = np.setdiff1d(live, rows[done], assume_unique=True)
    return _polished(gram, target, p).reshape((*np.shape(q)[:-1], k))


def _polished(gram: np.ndarray, target: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Each row of ``p`` moved to the exact minimum over the classes that it holds, where that lies in the simplex and is better."""
    if not np.isfinite(gram).all():
        return p
    k = len(gram)
    held = p > 1e-9
    value = lambda x, rows: ((x @ gram) * x).sum(axis=1) / 2 - (x * target[rows]).sum(axis=1)
    out = p.copy()
    for pattern in np.unique(held, axis=0):
        some, rows = np.flatnonzero(pattern), np.flatnonzero((held == pattern).all(axis=1) & np.isfinite(target).all(axis=1))
        if not len(rows) or not len(some):
            continue
        m = len(some)
        system = np.ones((m + 1, m + 1))
        system[:m, :m], system[m, m] = gram[np.ix_(some, some)], 0.0
        right = np.hstack([target[rows][:, some], np.ones((len(rows), 1))])
        found = np.zeros((len(rows), k))
        found[:, some] = np.linalg.lstsq(system, right.T, rcond=None)[0][:m].T
        good = (found >= 0).all(axis=1) & (np.abs(found.sum(axis=1) - 1) < 1e-9) & (value(found, rows) <= value(p[rows], rows))
        out[rows[good]] = found[good]
    return out


def hellinger_mixture(c: np.ndarray, q: np.ndarray, start: np.ndarray, rounds: int = 500, tolerance: float = 1e-10) -> np.ndarray:
    """The mixture p whose C p has least summed Hellinger distance to q, by multiplicative updates, of a vector q or of each row at once.

    Maximizes the sum of sqrt(q (C p)), which is concave in p; each update keeps p in the simplex.
    """
    many = np.atleast_2d(q)
    p = _starts(start, len(many), c.shape[1]) + 1e-9
    p /= p.sum(axis=1, keepdims=True)
    live = np.arange(len(many))
    for _ in range(rounds):
        if not len(live):
            break
        mixed = np.maximum(p[live] @ c.T, 1e-15)
        fresh = p[live] * (np.sqrt(many[live] / mixed) @ c)
        total = fresh.sum(axis=1, keepdims=True)
        good = total[:, 0] > 0
        fresh = np.where(good[:, None], fresh / np.where(total > 0, total, 1.0), p[live])
        moved = np.abs(fresh - p[live]).max(axis=1)
        p[live] = fresh
        live = live[good & (moved >= tolerance)]
    return p.reshape((*np.shape(q)[:-1], c.shape[1]))


#: Most rounds of EM, and the change of a share at which it has settled.
EM_ROUNDS, EM_TOLERANCE = 1000, 1e-8


def expectation_maximization(
    posterior: np.ndarray, prior: np.ndarray, counts: np.ndarray | None = None, rounds: int = EM_ROUNDS, tolerance: float = EM_TOLERANCE
) -> np.ndarray:
    """Class shares under which re-weighted posteriors average to themselves; starts at the training prior.

    ``counts``: how often each row of ``posterior`` occurs.
    """
    safe = np.maximum(prior, 1e-12)
    p = safe / safe.sum()
    n = np.ones(len(posterior)) if counts is None else counts
    for _ in range(rounds):
        weighted = posterior * (p / safe)
        weighted /= np.maximum(weighted.sum(axis=1, keepdims=True), 1e-300)
        fresh = n @ weighted / n.sum()
        done = np.abs(fresh - p).max() < tolerance
        p = fresh
        if done:
            break
    return p


def cost_sensitive_share(
    scores: np.ndarray, prior: float, tpr: float, fpr: float, counts: np.ndarray | None = None, rounds: int = 100, tolerance: float = 1e-6
) -> float:
    """Positive share by iterating a threshold that follows from the share estimated last; adjusted by the rates.

    ``counts``: how often each score occurs.
    """
    p = prior
    n = np.ones(len(scores)) if counts is None else counts
    for _ in range(rounds):
        ratio = (1 - p) / max(p, 1e-12) * prior / max(1 - prior, 1e-12)
        threshold = ratio / (1 + ratio)
        share = float(n[scores >= threshold].sum() / n.sum()) if len(scores) else p
        fresh = min(1.0, max(0.0, (share - fpr) / (tpr - fpr))) if tpr != fpr else share
        fresh = 0.5 * (p + fresh)  # damped: the threshold may else alternate between two values
        if abs(fresh - p) < tolerance:
            return fresh
        p = fresh
    return p


def energy_shares(between: np.ndarray, to_test: np.ndarray) -> np.ndarray:
    """The mixture of classes with least energy distance to a bag, from mean distances between classes and to the bag, or to each of many bags."""
    many = np.atleast_2d(to_test)
    # 2 p.b - p.A.p over the simplex: with D = -A conditionally positive, solved by projected gradients
    p, live = _starts(None, len(many), many.shape[1]), np.arange(len(many))
    step = 1 / max(2 * float(np.abs(between).sum(axis=1).max()), 1e-12)
    for _ in range(5000):
        if not len(live):
            break
        fresh = to_simplex(p[live] - step * (2 * many[live] - 2 * p[live] @ between))
        moved = np.abs(fresh - p[live]).max(axis=1)
        p[live] = fresh
        live = live[moved >= 1e-12]
    return p.reshape(np.shape(to_test))
