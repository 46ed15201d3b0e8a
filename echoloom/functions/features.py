"""Log-mel features: one vectorised FFT per Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from echoloom.operators.clipwindows import mel_triangles

# Sample rate, frame, hop, transform length, bands and output frames.
RATE, FRAME, HOP, N_FFT, BANDS, FRAMES = 16000, 480, 320, 512, 40, 49
EPS = 1e-5


@dataclass(frozen=True)
class Shape:
    """Sizes of a feature matrix. The default is that of the deployed model."""

    length: int = RATE
    frame: int = FRAME
    hop: int = HOP
    n_fft: int = N_FFT
    bands: int = BANDS
    frames: int = FRAMES


def mel_matrix(shape: Shape = Shape()) -> np.ndarray:
    m = np.zeros((shape.n_fft // 2 + 1, shape.bands))
    for k, band, w in mel_triangles(RATE, shape.n_fft, shape.bands):
        m[k, band] = w
    return m


def mel_energies(batch: np.ndarray, shape: Shape = Shape()) -> np.ndarray:
    """(clips, samples) to (clips, frames, bands) energies: strided frames, one transform and one matrix product for the batch."""
    frames = np.lib.stride_tricks.sliding_window_view(batch, shape.frame, axis=1)[:, ::shape.hop]
    spectrum = np.fft.rfft(frames * np.hanning(shape.frame), n=shape.n_fft, axis=2)
    return (spectrum.real ** 2 + spectrum.imag ** 2) @ mel_matrix(shape)


def fit(samples, length: int = RATE) -> np.ndarray:
    x = np.asarray(samples, dtype=np.float64)[:length]
    return np.pad(x, (0, length - len(x)))


def pcen_frames(energy: np.ndarray, s=0.025, alpha=0.98, delta=2.0, r=0.5) -> np.ndarray:
    smooth = np.empty_like(energy)
    smooth[:, 0] = energy[:, 0]
    for t in range(1, energy.shape[1]):
        smooth[:, t] = (1.0 - s) * smooth[:, t - 1] + s * energy[:, t]
    return (energy / (1e-6 + smooth) ** alpha + delta) ** r - delta ** r


def to_features(batch: np.ndarray, use_pcen: bool = False, shape: Shape = Shape()) -> np.ndarray:
    energy = mel_energies(batch, shape)
    out = pcen_frames(energy) if use_pcen else np.log(energy + EPS)
    short = shape.frames - out.shape[1]
    return np.pad(out, ((0, 0), (0, max(0, short)), (0, 0)))[:, :shape.frames]


def log_mel(clips: DataFrame, samples: str = "samples", out: str = "features", use_pcen: bool = False,
            sub_batch: int = 64, shape: Shape = Shape(), exact: bool = False) -> DataFrame:
    """Adds a flat array of frames x bands (49 x 40) features, as floats or (``exact``) doubles, and drops the samples.

    A whole sub-batch of clips is transformed at once; ``sub_batch`` bounds the memory of a task
    whatever the Arrow batch size is.
    """
    keep = [f for f in clips.schema.fields if f.name != samples]
    schema = T.StructType(keep + [T.StructField(out, T.ArrayType(T.DoubleType() if exact else T.FloatType()))])
    names = [f.name for f in keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), sub_batch):
                part = b.iloc[lo: lo + sub_batch]
                x = np.stack([fit(s, shape.length) for s in part[samples]])
                feats = to_features(x, use_pcen, shape).astype(np.float64 if exact else np.float32).reshape(len(part), -1)
                res = part[names].copy()
                res[out] = list(feats)
                yield res
    return clips.mapInPandas(run, schema)
