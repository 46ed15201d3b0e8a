"""The signal chain on whole batches: every step works on a (signals, samples) matrix.

Signals of different lengths lie in one flat buffer; a step that reads them (cut, tile, stretch) computes the places to
read for all rows at once. Every random choice arrives as a column, so the result depends on the row alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


#: samples from which a signal is worked on alone instead of in the whole matrix
LONG = 2048


@dataclass(frozen=True)
class Bank:
    """Signals in one buffer: signal i is ``flat[start[i]:start[i] + size[i]]``."""

    flat: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of_lists(cls, column) -> Bank:
        """From an Arrow column of arrays."""
        flat = np.asarray(column.values.to_numpy(zero_copy_only=False), float)
        ends = column.offsets.to_numpy().astype(np.int64)
        return cls(flat if len(flat) else np.zeros(1), ends[:-1], np.diff(ends))

    def read(self, which: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Samples at whole ``places`` (one row per entry of ``which``); beyond an end the end itself, zero for empty signals."""
        size = self.size[which][:, None]
        at = self.start[which][:, None] + np.clip(places, 0, np.maximum(size - 1, 0))
        out = self.flat[np.minimum(at, len(self.flat) - 1)]
        out[self.size[which] == 0] = 0.0
        return out

    def tiled(self, which: np.ndarray, n: int) -> np.ndarray:
        """Repeated up to ``n`` samples."""
        if n >= LONG:
            out = np.zeros((len(which), n))
            for i, w in enumerate(which.tolist()):
                if self.size[w]:
                    out[i] = np.resize(self.flat[self.start[w]:self.start[w] + self.size[w]], n)
            return out
        return self.read(which, np.arange(n)[None, :] % np.maximum(self.size[which], 1)[:, None])

    def sliced(self, which: np.ndarray, u: np.ndarray, n: int) -> np.ndarray:
        """A window at the drawn place of a long signal; a short one is repeated."""
        room = self.size[which] - n
        if n >= LONG and np.all(room <= 0):
            return self.tiled(which, n)
        at = np.where(room > 0, np.floor(u * (room + 1)), 0).astype(np.int64)
        return self.read(which, (at[:, None] + np.arange(n)[None, :]) % np.maximum(self.size[which], 1)[:, None])

    def fitted(self, which: np.ndarray, factor: np.ndarray, u: np.ndarray, n: int, repeat: bool = False) -> np.ndarray:
        """Speed changed by ``factor`` (length kept: filled or cut at the centre), then cut or placed at the drawn offset of ``n`` samples.

        ``repeat`` first repeats each signal up to ``n`` samples.
        """
        if repeat:
            short = self.size[which] < n
            if short.all():
                return Bank(self.tiled(which, n).ravel(), np.arange(len(which)) * n, np.full(len(which), n)).fitted(np.arange(len(which)), factor, u, n)
            out = np.empty((len(which), n))
            for some, again in ((np.flatnonzero(short), True), (np.flatnonzero(~short), False)):
                out[some] = self.fitted(which[some], factor[some], u[some], n, again) if len(some) else out[some]
            return out
        size = self.size[which]
        at = np.floor(u * (np.abs(size - n) + 1)).astype(np.int64)
        t = np.arange(n)[None, :] + np.where(size >= n, at, -at)[:, None]                     # place in the signal of kept length
        inside = (t >= 0) & (t < size[:, None])
        out = np.empty((len(which), n))
        plain = np.abs(factor - 1.0) < 0.02
        out[plain] = self.read(which[plain], t[plain])
        some = np.flatnonzero(~plain)
        if n >= LONG:                                          # row by row, so that a row stays in the cache
            for i in some.tolist():
                made = int(np.rint(size[i] / factor[i]))
                row = t[i] + (-((size[i] - made) // 2) if made < size[i] else (made - size[i]) // 2)
                inside[i] &= (row >= 0) & (row < made)
                if size[i]:
                    s = self.flat[self.start[which[i]]:self.start[which[i]] + size[i]]
                    place = np.clip(row * (size[i] / max(made, 1)), 0, size[i] - 1)
                    low = place.astype(np.int64)
                    a = s[low]
                    out[i] = a + (s[np.minimum(low + 1, size[i] - 1)] - a) * (place - low)
                else:
                    out[i] = 0.0
        elif len(some):
            which, size, t = which[some], size[some], t[some]
            made = np.rint(size / factor[some]).astype(np.int64)
            t = t + np.where(made < size, -((size - made) // 2), (made - size) // 2)[:, None]   # place in the stretched signal
            inside[some] &= (t >= 0) & (t < made[:, None])
            last = np.maximum(size - 1, 0)[:, None]
            place = np.clip(t * (size / np.maximum(made, 1))[:, None], 0, last)
            low = place.astype(np.int64)
            a = self.read(which, low)
            out[some] = a + (self.read(which, np.minimum(low + 1, last)) - a) * (place - low)
        out[~inside] = 0.0
        return out


def power(x: np.ndarray) -> np.ndarray:
    return np.mean(x * x, axis=1)


def guard(x: np.ndarray, ceiling: float = 0.95) -> np.ndarray:
    m = np.max(np.abs(x), axis=1)
    over = m > ceiling
    return np.where(over[:, None], x / np.where(over, m, 1.0)[:, None] * ceiling, x)


def add_layer(x: np.ndarray, rows: np.ndarray, noise: np.ndarray, snr: np.ndarray) -> None:
    """Adds ``noise`` to ``x[rows]`` in place at ``snr`` dB below what is there; silent noise is left out."""
    live = np.std(noise, axis=1) >= 1e-7
    rows, noise, snr = rows[live], noise[live], snr[live]
    x[rows] += noise * np.sqrt((power(x[rows]) + 1e-9) / (10.0 ** (snr / 10.0) * (power(noise) + 1e-9)))[:, None]


def babble(talkers: np.ndarray, gain_db: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Sum of the talkers of each row (``row`` rises) with their gains, divided by the peak."""
    out = np.zeros((n_rows, talkers.shape[1]))
    if len(row):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[first]] = np.add.reduceat(talkers * (10.0 ** (gain_db / 20.0))[:, None], first, axis=0)
    m = np.max(np.abs(out), axis=1)
    return out / np.where(m > 0, m, 1.0)[:, None]


def cadence(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Samples sit at the warped times t + beta t (1 - t) and are read at even times (piecewise linear)."""
    last = x.shape[1] - 1
    if last < 1:
        return x
    if last >= LONG:
        t = np.arange(last + 1) / last
        return np.stack([np.interp(t, np.clip(t + b * t * (1.0 - t), 0.0, 1.0), row) for row, b in zip(x, beta.tolist(), strict=True)])
    b, t = beta[:, None], (np.arange(last + 1) / last)[None, :]

    def warped(k: np.ndarray) -> np.ndarray:
        s = k / last
        return np.clip(s + b * s * (1.0 - s), 0.0, 1.0)

    flat = np.abs(b) < 1e-9
    root = np.where(flat, t, (1.0 + b - np.sqrt((1.0 + b) ** 2 - 4.0 * b * t)) / np.where(flat, 1.0, 2.0 * b))
    k = np.clip(np.floor(root * last).astype(np.int64), 0, last - 1)
    k = np.clip(k + np.where(warped(k) > t, -1, np.where(warped(k + 1) <= t, 1, 0)), 0, last - 1)
    lo, hi = np.take_along_axis(x, k, 1), np.take_along_axis(x, k + 1, 1)
    out = lo + (hi - lo) / (warped(k + 1) - warped(k)) * (t - warped(k))
    out[:, last] = x[:, last]
    return out


def drop_bursts(x: np.ndarray, rows: np.ndarray, start: np.ndarray, width: np.ndarray) -> None:
    """Zeroes ``width`` samples from ``start`` in ``x[rows]``, in place; a row may come several times."""
    for i in range(int(np.max(width, initial=0))):
        live = (i < width) & (start + i < x.shape[1])
        x[rows[live], start[live] + i] = 0.0


def quantise(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    q = (2.0 ** bits / 2.0 - 0.5)[:, None]
    return np.rint((np.clip(x, -1.0, 1.0) + 1.0) * q) / q - 1.0


def dbfs(x: np.ndarray) -> np.ndarray:
    return 20.0 * np.log10(np.sqrt(power(x)) + 1e-9)


def set_level(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scaled to the target loudness; a peak above one is brought to 0.99, silence only guarded."""
    rms = np.sqrt(power(x))
    quiet = rms < 1e-8
    y = x * (10.0 ** (target / 20.0) / np.where(quiet, 1.0, rms))[:, None]
    m = np.max(np.abs(y), axis=1)
    over = m > 1.0
    y = np.where(over[:, None], np.clip(y * (0.99 / np.where(over, m, 1.0))[:, None], -1.0, 1.0), y)
    return np.where(quiet[:, None], guard(x), y)


def floor_lift(x: np.ndarray, target: np.ndarray, floor: float = -70.0) -> tuple[np.ndarray, np.ndarray]:
    """(signals, level): what fell below the floor is lifted back to the target."""
    level = dbfs(x)
    low = level < floor
    if low.any():
        x = x.copy()
        x[low] = np.clip(x[low] * (10.0 ** ((target[low] - level[low]) / 20.0))[:, None], -1.0, 1.0)
        level = np.where(low, dbfs(x), level)
    return x, level


def finish(x: np.ndarray, c: dict[str, np.ndarray], bursts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Everything after the layers: warp, bursts (rows, starts, widths), crush, clip and level. NaN controls switch a step off."""
    x = guard(x)
    some = np.flatnonzero(~np.isnan(c["beta"]))
    if len(some):
        x[some] = cadence(x[some], c["beta"][some])
    drop_bursts(x, *bursts)
    some = np.flatnonzero(~np.isnan(c["bits"]))
    if len(some):
        x[some] = quantise(x[some], c["bits"][some])
    x = guard(x)
    some = np.flatnonzero(~np.isnan(c["clip_neg"]))
    if len(some):
        x[some] = np.clip(x[some], -c["clip_neg"][some][:, None], c["clip_pos"][some][:, None])
    return floor_lift(set_level(x, c["level"]), c["level"])


def mix_dual(x: np.ndarray, first: np.ndarray, second: np.ndarray, snr1: np.ndarray, snr2: np.ndarray) -> np.ndarray:
    """Two layers, both scaled against the clean signal, then the peak guard."""
    clean = power(x) + 1e-8
    g1, g2 = (np.sqrt(clean / 10.0 ** (snr / 10.0) / (power(n) + 1e-8))[:, None] for n, snr in ((first, snr1), (second, snr2)))
    return guard(x + first * g1 + second * g2)
