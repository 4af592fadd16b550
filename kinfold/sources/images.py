"""Pictures, and the difference hashes of their crops."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col
#: Margins of the crops as a share of the width (of the height three quarters of it), and the size of a hash.
MARGINS, COLUMNS, ROWS = (0.0, 0.05, 0.1, 0.15), 9, 8
#: Weights of blue, green and red in a gray.
GRAY = np.array([114, 587, 299], np.int64)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Origin, height, width, nChannels, mode and data (blue, green, red and perhaps alpha of each pixel, row by row) of the
    pictures under a path, read by the JVM; files that aren't pictures are left out."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")


def area_hash(gray: np.ndarray, margin: float) -> int:
    """the difference hash of a crop: its area in 9 x 8 equal parts, and for each part but the last of a row, from the
    highest bit on, whether it is brighter than the next one to the right.

    Sums of parts come from a summed-area table, at ninths and eighths of a pixel, in whole numbers; so equal parts are equal.
    """
    height, width = gray.shape
    x, y = int(width * margin), int(height * margin * 0.75)
    right, bottom = max(x + 1, width - x), max(y + 1, height - y)
    table = np.zeros((height + 1, width + 1), np.int64)
    table[1:, 1:] = gray.cumsum(axis=0).cumsum(axis=1)
    at_x = x * COLUMNS + np.arange(COLUMNS + 1) * (right - x)  # in ninths of a pixel
    at_y = y * ROWS + np.arange(ROWS + 1) * (bottom - y)  # in eighths
    ix, fx, iy, fy = at_x // COLUMNS, at_x % COLUMNS, at_y // ROWS, at_y % ROWS
    nx, ny = np.minimum(ix + 1, width), np.minimum(iy + 1, height)
    across = table[:, ix] * (COLUMNS - fx) + table[:, nx] * fx
    corner = across[iy] * (ROWS - fy)[:, None] + across[ny] * fy[:, None]
    part = np.diff(np.diff(corner, axis=0), axis=1)
    bits = (part[:, :-1] > part[:, 1:]).reshape(-1)
    return int(np.packbits(bits).view(">i8")[0])


def cover_hashes(images: DataFrame) -> DataFrame:
    """origin and hashes (one 64-bit number for each of MARGINS) of pictures as read_images gives them. Pictures of one
    channel are gray; alpha doesn't count. Null for a picture without pixels or data that doesn't fit its size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for origin, h, w, channels, data in zip(pdf["origin"], pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"]):
                pixels = np.frombuffer(bytes(data) if data is not None else b"", np.uint8)
                if not len(pixels) or len(pixels) != h * w * channels or channels not in (1, 3, 4):
                    out.append((origin, None))
                    continue
                p = pixels.reshape(h, w, channels).astype(np.int64)
                gray = p[:, :, 0] * int(GRAY.sum()) if channels == 1 else p[:, :, :3] @ GRAY
                out.append((origin, [area_hash(gray, m) for m in MARGINS]))
            yield pd.DataFrame(out, columns=["origin", "hashes"])

    return images.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, "origin string, hashes array<bigint>")


def bitmap_file(rgb: np.ndarray) -> bytes:
    """A bitmap file of a height x width x 3 array of bytes: rows from the bottom up, blue first, padded to four bytes."""
    height, width, _ = rgb.shape
    rows = np.zeros((height, -(-3 * width // 4) * 4), np.uint8)
    rows[:, : 3 * width] = rgb[::-1, :, ::-1].reshape(height, -1)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()
