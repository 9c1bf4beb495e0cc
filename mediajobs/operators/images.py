"""Image inputs: from strings to bytes, and from pixels to model tensors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import PIECE_BYTES

#: Channel means and deviations of the visual models (fixed values).
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
SIDE = 224
#: Raw base64 must decode to more bytes than this.
SHORTEST = 32


def decode_image_input(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``rows`` (data) with image_bytes and kind: data-URI, else base64 of enough bytes, else a path in ``files`` (path, content)."""
    uri = F.col("data").startswith("data:image")
    raw = F.try_to_binary("data", F.lit("base64"))
    plain = F.length(raw) > SHORTEST
    found = F.when(uri, F.try_to_binary(F.regexp_replace("data", "^[^,]*,", ""), F.lit("base64"))).when(plain, raw)
    out = rows.withColumn("_found", found)
    if files is not None:
        f = files.select(F.col("path").alias("data"), F.col("content").alias("_content"))
        out = out.join(f, "data", "left")
        found = F.coalesce("_found", "_content")
    else:
        found = F.col("_found")
    kind = F.when(uri, "data_uri").when(F.col("_found").isNotNull(), "base64").when(found.isNotNull(), "path").otherwise("error")
    return out.withColumns({"image_bytes": found, "kind": kind}).drop("_found", "_content")


@lru_cache(64)
def _weights(size: int, side: int) -> np.ndarray:
    """Rows of bicubic weights (a = -0.5) that resize ``size`` samples to ``side``, widened when shrinking."""
    scale = max(size / side, 1.0)
    centre = (np.arange(side) + 0.5) * size / side
    x = np.abs((np.arange(size)[None, :] + 0.5 - centre[:, None]) / scale)
    w = np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))
    return w / w.sum(1, keepdims=True)


def tensor(pixels: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Height x width x RGB bytes to channel x side x side floats, resized, scaled and normalised."""
    h, w, _ = pixels.shape
    resized = np.einsum("ah,hwc,bw->abc", _weights(h, side), pixels.astype(np.float64), _weights(w, side), optimize=True)
    resized = np.clip(np.round(resized), 0, 255) / 255.0
    return ((resized - MEAN) / STD).transpose(2, 0, 1).astype(np.float32)


def image_to_tensor(image: Column, side: int = SIDE) -> Column:
    """Tensor (flat array<float>) of a struct (height, width, nChannels, data) as Spark's image source gives it (BGR)."""

    def one(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
        p = np.frombuffer(data, np.uint8).reshape(height, width, channels)
        return tensor(np.repeat(p, 3, 2) if channels == 1 else p[:, :, 2::-1], side).ravel()

    n = 3 * side * side
    few = max(1, PIECE_BYTES // (4 * n))

    # tensors are larger than images, so they leave in pieces of their own bytes
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            for at in range(0, len(b), few):
                fields = b.slice(at, few).flatten()
                made = [one(*(f[i].as_py() for f in fields)) for i in range(len(fields[0]))]
                yield pa.ListArray.from_arrays(pa.array(np.arange(0, (len(made) + 1) * n, n, np.int32)), pa.array(np.concatenate(made)))
            if not len(b):
                yield pa.array([], pa.list_(pa.float32()))

    return F.arrow_udf(run, "array<float>")(F.struct(*[image[c].alias(c) for c in ("height", "width", "nChannels", "data")]))
