"""Page images as a stream: new bitmap files in a folder become components. Every page stands for itself; no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.operators.pages import page_components
from glyphmill.sources.images import PAGE, _decode

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_pages(spark: SparkSession, folder: str, pattern: str = "*.bmp") -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInPandas(_decode, PAGE)


def stream_components(spark: SparkSession, folder: str, threshold: int = 170) -> DataFrame:
    return page_components(stream_pages(spark, folder), threshold)
