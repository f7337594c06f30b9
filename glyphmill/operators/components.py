"""Connected components of foreground pixels, and what is told of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.geometry import centre_x, centre_y


def label_pixels(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each pixel the number of the first pixel in (y, x) order of its 8-connected component."""
    order = np.lexsort((x, y))
    sx, sy = x[order].astype(np.int64), y[order].astype(np.int64)
    stride = int(sx.max() - sx.min()) + 3 if len(sx) else 1
    code = sy * stride + (sx - (sx.min() if len(sx) else 0))
    a, b = [], []
    for step in (1, stride - 1, stride, stride + 1):  # right, and the three below
        at = np.searchsorted(code, code + step)
        at[at == len(code)] = 0
        hit = np.flatnonzero(code[at] == code + step)
        a.append(hit)
        b.append(at[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    label = np.arange(len(code))
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        label = new[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    out = np.empty(len(code), dtype=np.int64)
    out[order] = order[label]
    return out


#: Numbers of components are y * STRIDE + x of their first pixel, so they differ on pages of any width.
STRIDE = 1 << 32


def connected_components(dark: DataFrame, stride: int = STRIDE) -> DataFrame:
    """``dark`` (page_id, x, y) with comp_id = least y * ``stride`` + x of the 8-connected component. A task holds one page at a time.

    ``stride`` must be over the pages' widths.
    """

    def label(page: pd.DataFrame) -> pd.DataFrame:
        x, y = page["x"].to_numpy(), page["y"].to_numpy()
        if len(x) and x.max() >= stride:
            raise ValueError(f"a page is wider than the stride {stride}")
        first = label_pixels(x, y)
        return page.assign(comp_id=y[first].astype(np.int64) * stride + x[first])

    return dark.select("page_id", "x", "y").groupBy("page_id").applyInPandas(label, "page_id long, x long, y long, comp_id long")


def connected_components_of_huge_pages(dark: DataFrame, folder: str, stride: int = STRIDE, most_rounds: int = 64) -> DataFrame:
    """The same by DataFrame operations, for pages that no task can hold. ``folder`` is shared by driver and executors.

    The pixels of a row that touch are one run. Runs that touch a run of the next row are linked; the links are contracted
    by the large-star and small-star operations, in a number of rounds that grows as the logarithm of the runs. Tables are
    written between rounds. Raises RuntimeError if ``most_rounds`` don't do.
    """
    spark, count = dark.sparkSession, 0

    def kept(df: DataFrame) -> DataFrame:
        nonlocal count
        count += 1
        df.write.mode("overwrite").parquet(f"{folder}/step-{count:03d}")
        return spark.read.parquet(f"{folder}/step-{count:03d}")

    row = Window.partitionBy("page_id", "y").orderBy("x")
    starts = dark.select("page_id", "x", "y").withColumn("start", F.when(F.coalesce(F.col("x") - F.lag("x").over(row), F.lit(2)) > 1, F.col("x")))
    runs = kept(starts.withColumn("run", F.col("y") * F.lit(stride).cast("long") + F.last("start", True).over(row)).drop("start"))
    below = runs.select("page_id", F.explode(F.array(*[F.col("x") + d for d in (-1, 0, 1)])).alias("x"), (F.col("y") + 1).alias("y"), F.col("run").alias("a"))
    edges = kept(runs.join(below, ["page_id", "x", "y"]).select("page_id", "a", F.col("run").alias("b")).distinct())
    seen = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select("page_id", F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("page_id", "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = kept(both.where("b > a").join(least, ["page_id", "a"]).select("page_id", F.col("b").alias("x"), F.col("m").alias("y")).where("x <> y").distinct())
        low = large.groupBy("page_id", "x").agg(F.min("y").alias("m"))
        small = large.join(low, ["page_id", "x"]).select("page_id", F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").unionByName(low.select("page_id", "x", F.col("m").alias("y"))).distinct()
        edges = kept(small.select("page_id", F.col("y").alias("a"), F.col("x").alias("b")))
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("page_id", "a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components not found in {most_rounds} rounds")
    roots = edges.select("page_id", F.col("b").alias("run"), F.col("a").alias("root"))
    return runs.join(roots, ["page_id", "run"], "left").select("page_id", "x", "y", F.coalesce("root", "run").alias("comp_id"))


def on_mesh(labelled: DataFrame) -> DataFrame:
    """The pixels of components that a search from seeds finds: those with a pixel of the mesh.

    The mesh has every second row; in rows 0, 4, 8, ... columns 0, 2, 4, ..., in rows 2, 6, 10, ... columns 1, 3, 5, ...
    """
    seed = (F.col("y") % 2 == 0) & ((F.col("x") + (F.col("y") % 4) / 2) % 2 == 0)
    found = labelled.where(seed).select("page_id", "comp_id").distinct()
    return labelled.join(found, ["page_id", "comp_id"], "left_semi")


def boxes(labelled: DataFrame) -> DataFrame:
    """page_id, comp_id, x0, y0, w, h, pixel_count."""
    return labelled.groupBy("page_id", "comp_id").agg(
        F.min("x").alias("x0"),
        F.min("y").alias("y0"),
        (F.max("x") - F.min("x") + 1).alias("w"),
        (F.max("y") - F.min("y") + 1).alias("h"),
        F.count(F.lit(1)).alias("pixel_count"),
    )


def size_filter(comps: DataFrame, least_pixels: int, most_w: float, most_h: float) -> DataFrame:
    return comps.where((F.col("pixel_count") >= least_pixels) & (F.col("w") < most_w) & (F.col("h") < most_h))


def drop_outsized(comps: DataFrame, factor: float = 10, key: str = "page_id") -> DataFrame:
    """Without components over ``factor`` times the page's mean width or height."""
    page = Window.partitionBy(key)
    sized = comps.withColumn("__w", F.avg("w").over(page)).withColumn("__h", F.avg("h").over(page))
    return sized.where((F.col("w") <= factor * F.col("__w")) & (F.col("h") <= factor * F.col("__h"))).drop("__w", "__h")


def classify(comps: DataFrame, factor: float = 25, key: str = "page_id") -> DataFrame:
    """With type: image where the area is over ``factor`` times the page's mean, else character."""
    area = F.col("w") * F.col("h")
    return comps.withColumn("type", F.when(area > factor * F.avg(area).over(Window.partitionBy(key)), "image").otherwise("character"))


def find_components(px: DataFrame, threshold: int = 100, side: int = 100, stride: int = STRIDE) -> DataFrame:
    """From pixels to typed components: dark pixels, components, size filters, boxes, types."""
    dark = px.where(F.col("gray") <= threshold)
    comps = size_filter(boxes(connected_components(dark, stride)), 8, 0.9 * side, 0.9 * side)
    return classify(drop_outsized(comps))


def counters(comps: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """page_id, n_components, n_images, n_characters of typed components; with ``lines`` (page_id, line_id) n_lines, too."""
    out = comps.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_components"), F.count_if(F.col("type") == "image").alias("n_images"), F.count_if(F.col("type") == "character").alias("n_characters"))
    return out if lines is None else out.join(lines.groupBy("page_id").agg(F.countDistinct("line_id").alias("n_lines")), "page_id", "left")


def density(comps: DataFrame) -> DataFrame:
    """``comps`` with area, centre (cx, cy) and density, the share of its box that a component fills."""
    area = F.col("w") * F.col("h")
    return comps.select("*", area.alias("area"), centre_x(F.col("x0"), F.col("w")).alias("cx"), centre_y(F.col("y0"), F.col("h")).alias("cy"), F.round(F.col("pixel_count") / area, 6).alias("density"))


def padded_ids(ids: DataFrame, column: str = "comp_id") -> DataFrame:
    """``column``, file and sample: names of a component's dump (six digits) and of a sample (eight)."""
    pad = lambda n: F.lpad((F.col(column) % 10**n).cast("string"), n, "0")
    return ids.select(column, F.concat(F.lit("image_"), pad(6), F.lit("_org.bmp")).alias("file"), F.concat(pad(8), F.lit(".bmp")).alias("sample"))
