"""Page images: bitmap files to rows (path, width, height, raster), and back. Rasters are row-major gray bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "path string, width int, height int, raster binary"
#: Shares of red, green and blue in gray (BT.709).
GRAY = (0.2125, 0.7154, 0.0721)


def decode_bmp(data: bytes) -> np.ndarray:
    """Gray plane [y, x] of an uncompressed bitmap of 8, 24 or 32 bits."""
    if data[:2] != b"BM":
        raise ValueError("not a bitmap")
    offset, size, w, h, _, bits, packed = struct.unpack_from("<I", data, 10)[0], *struct.unpack_from("<IiiHHI", data, 14)
    if bits not in (8, 24, 32) or packed not in (0, 3):
        raise ValueError(f"bitmap of {bits} bits, compression {packed}")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), offset).reshape(abs(h), stride)[:: -1 if h > 0 else 1]
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, 4 * used, 14 + size).reshape(-1, 4)[:, 2::-1]
        levels = np.zeros(256, dtype=np.uint8)
        levels[:used] = np.round(palette @ np.array(GRAY)).astype(np.uint8)
        return levels[rows[:, :w]]
    colours = rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    return np.round(colours @ np.array(GRAY)).astype(np.uint8)


def encode_bmp(gray: np.ndarray) -> bytes:
    """An 8-bit bitmap with a gray palette."""
    h, w = gray.shape
    stride = (w + 3) // 4 * 4
    rows = np.zeros((h, stride), dtype=np.uint8)
    rows[:, :w] = gray[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4)
    palette[:, 3] = 0
    head = struct.pack("<2sIHHI", b"BM", 1078 + rows.size, 0, 0, 1078) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 0, 0, 256, 256)
    return head + palette.tobytes() + rows.tobytes()


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        planes = [decode_bmp(c) for c in batch["content"]]
        yield pd.DataFrame({"path": batch["path"], "width": [p.shape[1] for p in planes], "height": [p.shape[0] for p in planes], "raster": [p.tobytes() for p in planes]})


def read_pages(spark: SparkSession, folder: str, pattern: str = "*.bmp", recursive: bool = True) -> DataFrame:
    """Pages of the bitmap files in a folder and, with ``recursive``, below it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder)
    return files.select("path", "content").mapInPandas(_decode, PAGE)


def read_samples(spark: SparkSession, folder: str, pattern: str = "*.bmp") -> DataFrame:
    """Glyph samples: pages with label, the folder that a file is in, pixel_count, the pixels that aren't white (255), and threshold, the highest level below white (null if all is white)."""

    @F.pandas_udf("pixel_count long, threshold int")
    def told(rasters: pd.Series) -> pd.DataFrame:
        levels = [np.bincount(np.frombuffer(r, np.uint8), minlength=256)[:255] for r in rasters]
        return pd.DataFrame({"pixel_count": [int(n.sum()) for n in levels], "threshold": pd.array([int(np.flatnonzero(n)[-1]) if n.any() else None for n in levels], dtype="Int32")})

    pages = read_pages(spark, folder, pattern).withColumn("label", F.element_at(F.split("path", "/"), -2)).withColumn("told", told("raster"))
    return pages.select("path", "width", "height", "raster", "label", "told.pixel_count", "told.threshold")


def read_unlabelled(spark: SparkSession, folder: str) -> DataFrame:
    """Glyph dumps without a label: the files ``*_org.bmp`` of a folder, not of those below it."""
    return read_pages(spark, folder, "*_org.bmp", recursive=False)


def write_trace(frames: dict[str, DataFrame], folder: str) -> None:
    """Intermediate tables of a run, one folder for each, to look at later."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def sample_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def to_pixels(pages: DataFrame, key: str = "path") -> DataFrame:
    """key, x, y, gray of all pixels that are not white (255)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, w, h, raster in batch.itertuples(index=False):
                plane = np.frombuffer(raster, np.uint8).reshape(h, w)
                y, x = np.nonzero(plane != 255)
                yield pd.DataFrame({key: k, "x": x.astype("int64"), "y": y.astype("int64"), "gray": plane[y, x].astype("int32")})

    kind = pages.select(key).schema[0].dataType.simpleString()
    return pages.select(key, "width", "height", "raster").mapInPandas(run, f"{key} {kind}, x long, y long, gray int")


def encode_pages(pages: DataFrame) -> DataFrame:
    """path, content: pages as bitmap files' bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "content": [encode_bmp(np.frombuffer(r, np.uint8).reshape(h, w)) for w, h, r in zip(batch["width"], batch["height"], batch["raster"], strict=True)]})

    return pages.mapInPandas(run, "path string, content binary")
