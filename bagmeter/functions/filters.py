"""Zero-phase filters of signals, for all signals of a batch with one rate and length at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mains frequency and its quality, the band and half its order (per edge), seconds of the baseline.
NOTCH, QUALITY, BAND, ORDER, BASELINE = 50.0, 30.0, (0.67, 40.0), 4, 0.4


def notch(fs: float, at: float = NOTCH, quality: float = QUALITY) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a second-order notch."""
    w = 2 * np.pi * at / fs
    gain = 1 / (1 + np.tan(w / quality / 2))
    return gain * np.array([1.0, -2 * np.cos(w), 1.0]), np.array([1.0, -2 * gain * np.cos(w), 2 * gain - 1])


def band_pass(fs: float, band: tuple[float, float] = BAND, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a Butterworth band pass by the bilinear transform."""
    low, high = (2 * fs * np.tan(np.pi * f / fs) for f in band)
    width, centre = high - low, np.sqrt(low * high)
    base = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * width / 2
    root = np.sqrt(base**2 - centre**2)
    poles = np.concatenate([base + root, base - root])
    digital = (2 * fs + poles) / (2 * fs - poles)
    a = np.real(np.poly(digital))
    b = np.real(np.poly(np.concatenate([np.ones(order), -np.ones(order)])))
    at = np.exp(2j * np.pi * np.arctan(centre / (2 * fs)) / np.pi)  # gain 1 in the middle of the band
    return b * abs(np.polyval(a, at) / np.polyval(b, at)), a


def _settled(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The filter's state under a constant input of 1."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[0] = -a[1:]
    companion[1:, :-1] = np.eye(n - 1)
    return np.linalg.solve(np.eye(n) - companion.T, b[1:] - a[1:] * b[0])


def _run(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    state = _settled(b, a)[:, None] * x[:, 0]
    out = np.empty_like(x)
    for t in range(x.shape[1]):
        out[:, t] = b[0] * x[:, t] + state[0]
        state = np.vstack([state[1:], np.zeros((1, len(x)))]) + np.outer(b[1:], x[:, t]) - np.outer(a[1:], out[:, t])
    return out


def both_ways(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The filter run forwards and backwards over rows that are continued by reflection in their ends."""
    pad = 3 * len(a)
    if x.shape[1] <= pad:
        raise ValueError(f"signals of {x.shape[1]} values are too short, more than {pad} are needed")
    longer = np.hstack([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]])
    once = _run(b, a, longer)
    return _run(b, a, once[:, ::-1])[:, ::-1][:, pad:-pad]


def without_baseline(x: np.ndarray, fs: float) -> np.ndarray:
    """Rows minus their running median over 0.4 seconds, with zeros beyond the ends."""
    size = int(BASELINE * fs) + 1
    size += size % 2 == 0
    padded = np.pad(x, ((0, 0), (size // 2, size // 2)))
    return x - np.median(np.lib.stride_tricks.sliding_window_view(padded, size, axis=1), axis=2)


def filter_chain(x: np.ndarray, fs: float) -> np.ndarray:
    """Notch, band pass and removal of the baseline of each row."""
    return without_baseline(both_ways(*band_pass(fs), both_ways(*notch(fs), x)), fs)


def filtered(signal: Column, fs: Column) -> Column:
    """:func:`filter_chain` of an array column; a null or too short signal, a null rate, or one of 100 Hz or less gives null."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for signals, rates in batches:
            out = pd.Series([None] * len(signals), dtype=object)
            alike: dict[tuple, list[int]] = {}
            for i, (s, r) in enumerate(zip(signals, rates)):
                if s is not None and r is not None and r > 2 * NOTCH and len(s) > 3 * (2 * ORDER + 1):
                    alike.setdefault((len(s), float(r)), []).append(i)
            for (_, rate), rows in alike.items():
                for i, y in zip(rows, filter_chain(np.array([signals[i] for i in rows], dtype=float), rate)):
                    out[i] = y
            yield out

    return run(signal.cast("array<double>"), fs.cast("double"))
