"""The signal chain of one planned sample, step by step, to compare the batch form with."""

from __future__ import annotations

import numpy as np


def _guard(x, ceiling=0.95):
    m = np.max(np.abs(x))
    return x / m * ceiling if m > ceiling else x


def _stretch(x, factor):
    n = len(x)
    if abs(factor - 1.0) < 0.02:
        return x
    m = int(np.rint(n / factor))
    y = np.interp(np.arange(m) * (n / m), np.arange(n), x)
    if m < n:
        left = (n - m) // 2
        return np.pad(y, (left, n - m - left))
    cut = (m - n) // 2
    return y[cut:cut + n]


def _fit(x, n, u):
    room = abs(len(x) - n)
    at = int(np.floor(u * (room + 1)))
    return x[at:at + n] if len(x) >= n else np.pad(x, (at, room - at))


def _add_layer(x, noise, snr):
    if len(noise) == 0 or np.std(noise) < 1e-7:
        return x
    noise = np.resize(noise, len(x))
    return x + noise * np.sqrt((np.mean(x * x) + 1e-9) / (10.0 ** (snr / 10.0) * (np.mean(noise * noise) + 1e-9)))


def _dbfs(x):
    return 20.0 * np.log10(np.sqrt(np.mean(x * x)) + 1e-9)


def _set_level(x, target):
    rms = np.sqrt(np.mean(x * x))
    if rms < 1e-8:
        return _guard(x)
    x = x * (10.0 ** (target / 20.0) / rms)
    m = np.max(np.abs(x))
    return np.clip(x * (0.99 / m), -1.0, 1.0) if m > 1.0 else x


def render(base, noises, snrs, c, window: int):
    """(samples, level) for the controls ``c`` of one sample; absent controls are None or NaN."""
    given = lambda v: v is not None and v == v                        # noqa: E731
    x = _fit(_stretch(np.asarray(base, float), c.speed), window, c.offset)
    for noise, snr in zip(noises, snrs):
        x = _add_layer(x, np.asarray(noise, float), snr)
    x = _guard(x)
    if given(c.beta):
        t = np.arange(window) / (window - 1)
        x = np.interp(t, np.clip(t + c.beta * t * (1.0 - t), 0.0, 1.0), x)     # samples sit at the warped times
    if given(c.burst):
        x = x.copy()
        x[int(c.burst):int(c.burst) + max(1, int(0.03 * window))] = 0.0
    if given(c.bits):
        q = 2.0 ** c.bits / 2.0 - 0.5
        x = np.rint((np.clip(x, -1.0, 1.0) + 1.0) * q) / q - 1.0
    x = _guard(x)
    if given(c.clip_neg):
        x = np.clip(x, -c.clip_neg, c.clip_pos)
    x = _set_level(x, c.level)
    level = _dbfs(x)
    if level < -70.0:
        x = np.clip(x * 10.0 ** ((c.level - level) / 20.0), -1.0, 1.0)
        level = _dbfs(x)
    return x, level
