"""PCM wav bytes: small per-clip helpers applied in Arrow batches."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE = 16000
DECODED = "samples array<float>, sr int, channels int, error string"


def encode(samples: np.ndarray, rate: int = RATE, length: int | None = RATE) -> bytes:
    """16-bit mono wav; padded at the centre or cut to ``length``, clipped to [-1, 1]."""
    x = np.asarray(samples, dtype=np.float64)
    if length is not None:
        if len(x) < length:
            left = (length - len(x)) // 2
            x = np.pad(x, (left, length - len(x) - left))
        x = x[:length]
    pcm = (np.clip(x, -1.0, 1.0) * 32767.0).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(pcm.tobytes())
    return out.getvalue()


def decode(content: bytes, length: int | None = RATE):
    """(samples, rate, channels, error); the first channel, scaled by 1/32768."""
    try:
        with wave.open(io.BytesIO(content), "rb") as w:
            if w.getsampwidth() != 2:
                raise ValueError(f"{8 * w.getsampwidth()}-bit samples")
            ch, sr = w.getnchannels(), w.getframerate()
            x = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").reshape(-1, ch)[:, 0]
    except (wave.Error, EOFError, ValueError) as err:
        return None, None, None, str(err) or type(err).__name__
    x = x.astype(np.float32) / np.float32(32768.0)
    if length is not None:
        x = np.pad(x, (0, length - len(x))) if len(x) < length else x[:length]
    return x, sr, ch, None


def encode_column(samples: Column, rate: int = RATE, length: int | None = RATE) -> Column:
    @F.pandas_udf(T.BinaryType())
    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda s: encode(s, rate, length))
    return run(samples)


def decode_clips(clips: DataFrame, content: str = "content", length: int | None = RATE) -> DataFrame:
    """Adds samples, sr, channels and error; a clip that does not parse keeps its row and says why."""
    schema = T.StructType.fromDDL(", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in clips.schema.fields if f.name != content] + [DECODED]))
    keep = [f.name for f in clips.schema.fields if f.name != content]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[keep].copy()
            got = [decode(c, length) for c in b[content]]
            for i, name in enumerate(("samples", "sr", "channels", "error")):
                out[name] = pd.Series([g[i] for g in got], index=out.index, dtype=object)
            yield out
    return clips.mapInPandas(run, schema)
