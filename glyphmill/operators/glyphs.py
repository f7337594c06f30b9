"""Operators over the pixels of components, as relations (page_id, comp_id, x, y): rasters, slices, profiles, runs and shapes.

Everything is partitioned by component; windows run within a component's rows or columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["page_id", "comp_id"]


def local_rasters(labelled: DataFrame, px: DataFrame) -> DataFrame:
    """page_id, comp_id, x, y, gray: each component's pixels, counted from its box's corner; what isn't listed is white."""
    own = labelled.join(px.select("page_id", "x", "y", "gray"), ["page_id", "x", "y"])
    box = Window.partitionBy(*KEYS)
    return own.select(*KEYS, (F.col("x") - F.min("x").over(box)).alias("x"), (F.col("y") - F.min("y").over(box)).alias("y"), "gray")


def slices(rasters: DataFrame, x0: Column, y0: Column, w: Column, h: Column) -> DataFrame:
    """The part of each raster within a rectangle, counted from the rectangle's corner."""
    inside = (F.col("x") >= x0) & (F.col("x") < x0 + w) & (F.col("y") >= y0) & (F.col("y") < y0 + h)
    return rasters.where(inside).withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def cropped(rasters: DataFrame, most: int = 254) -> DataFrame:
    """page_id, comp_id, x0, y0, w, h, pixel_count: the box around the pixels up to ``most`` of each raster, without white borders."""
    return rasters.where(F.col("gray") <= most).groupBy(*KEYS).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.count(F.lit(1)).alias("pixel_count"))


def united(labelled: DataFrame, px: DataFrame, pairs: DataFrame) -> DataFrame:
    """page_id, a_id, b_id, x, y, gray: the pixels of two components as one; where both have a pixel, that of the second (``pairs``: page_id, a_id, b_id)."""
    own = labelled.join(px.select("page_id", "x", "y", "gray"), ["page_id", "x", "y"])
    each = [own.join(pairs.withColumn("comp_id", F.col(c)), KEYS).select("page_id", "a_id", "b_id", "x", "y", "gray", F.lit(k).alias("turn")) for k, c in enumerate(("a_id", "b_id"))]
    return each[0].unionByName(each[1]).groupBy("page_id", "a_id", "b_id", "x", "y").agg(F.max_by("gray", "turn").alias("gray"))


def united_boxes(boxes: DataFrame, pairs: DataFrame) -> DataFrame:
    """page_id, a_id, b_id, x0, y0, w, h, pixel_count: box around two components, their pixel counts added."""
    side = lambda p: boxes.select("page_id", F.col("comp_id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}{c}") for c in ("x0", "y0", "w", "h", "pixel_count")])
    both = pairs.join(side("a"), ["page_id", "a_id"]).join(side("b"), ["page_id", "b_id"])
    x0, y0 = F.least("ax0", "bx0"), F.least("ay0", "by0")
    w = F.greatest(F.col("ax0") + F.col("aw"), F.col("bx0") + F.col("bw")) - x0
    h = F.greatest(F.col("ay0") + F.col("ah"), F.col("by0") + F.col("bh")) - y0
    return both.select("page_id", "a_id", "b_id", x0.alias("x0"), y0.alias("y0"), w.alias("w"), h.alias("h"), (F.col("apixel_count") + F.col("bpixel_count")).alias("pixel_count"))


def column_profiles(labelled: DataFrame) -> DataFrame:
    """page_id, comp_id, x, n, top, bottom: of each column of a component its pixels and the background above and below them."""
    box = Window.partitionBy(*KEYS)
    p = labelled.select(*KEYS, "x", "y", F.min("y").over(box).alias("y0"), F.max("y").over(box).alias("y1"), F.min("x").over(box).alias("x0"))
    p = p.groupBy(*KEYS, (F.col("x") - F.col("x0")).alias("x"), "y0", "y1").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("a"), F.max("y").alias("b"))
    return p.select(*KEYS, "x", "n", (F.col("a") - F.col("y0")).alias("top"), (F.col("y1") - F.col("b")).alias("bottom"))


def row_counts(labelled: DataFrame) -> DataFrame:
    """page_id, comp_id, y, n: pixels of each row of a component."""
    p = labelled.withColumn("y0", F.min("y").over(Window.partitionBy(*KEYS)))
    return p.groupBy(*KEYS, (F.col("y") - F.col("y0")).alias("y")).agg(F.count(F.lit(1)).alias("n"))


def cut_candidates(profiles: DataFrame) -> DataFrame:
    """page_id, comp_id, side, cut: columns where the background's depth, seen from the right, falls again after it had risen."""
    scan = Window.partitionBy(*KEYS, "side").orderBy(F.desc("x"))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("depth")) for s in ("top", "bottom")]))
    d = profiles.select(*KEYS, "x", sides.alias("s")).select(*KEYS, "x", "s.side", "s.depth")
    d = d.withColumn("turn", F.col("depth") - F.lag("depth").over(scan))
    d = d.withColumn("before", F.last(F.when(F.col("turn") != 0, F.col("turn")), True).over(scan.rowsBetween(Window.unboundedPreceding, -1)))
    return d.where("turn < 0 and before > 0").select(*KEYS, "side", (F.col("x") + 1).alias("cut"))


def run_statistics(labelled: DataFrame) -> DataFrame:
    """page_id, comp_id, axis, mean_diff, var_diff of the numbers of runs: y compares rows that follow each other, x columns.

    The mean and variance are of the absolute differences; 0 for a single row or column.
    """
    axis = lambda a, b: labelled.select(*KEYS, F.lit(b).alias("axis"), F.col(b).alias("line"), F.col(a).alias("at"))
    p = axis("x", "y").unionByName(axis("y", "x"))
    line = Window.partitionBy(*KEYS, "axis", "line").orderBy("at")
    starts = p.withColumn("gap", F.col("at") - F.lag("at").over(line)).where("gap is null or gap > 1")
    runs = starts.groupBy(*KEYS, "axis", "line").agg(F.count(F.lit(1)).alias("runs"))
    diff = runs.withColumn("diff", F.abs(F.col("runs") - F.lag("runs").over(Window.partitionBy(*KEYS, "axis").orderBy("line"))))
    return diff.groupBy(*KEYS, "axis").agg(F.round(F.coalesce(F.avg("diff"), F.lit(0.0)), 6).alias("mean_diff"), F.round(F.coalesce(F.var_pop("diff"), F.lit(0.0)), 6).alias("var_diff"))


def shape_classes(boxes: DataFrame, statistics: DataFrame) -> DataFrame:
    """page_id, comp_id, class of ``boxes`` (w, h, pixel_count) by area, elongation, density and run variances.

    Up to the page's mean area a component is a character. Of the others, one whose rows vary enough against its columns is
    busy: a long one is an image unless it is busy and less than 0.7 full, any other one is a character if busy, else an image.
    """
    s = statistics.groupBy(*KEYS).agg(F.max(F.when(F.col("axis") == "y", F.col("var_diff"))).alias("rows"), F.max(F.when(F.col("axis") == "x", F.col("var_diff"))).alias("columns"))
    area = F.col("w") * F.col("h")
    busy = -1.09 * F.col("rows") + 2.8 <= F.col("columns")
    long = F.least("w", "h") / F.greatest("w", "h") <= 0.8
    told = F.when(F.col("area") <= F.col("mean"), "character").when(long, F.when((F.col("pixel_count") / F.col("area") >= 0.7) | ~busy, "image").otherwise("inverted")).otherwise(F.when(busy, "character").otherwise("image"))
    sized = boxes.withColumn("area", area).withColumn("mean", F.avg(area).over(Window.partitionBy("page_id")))
    return sized.join(s, KEYS).select(*KEYS, told.alias("class"))


def run_midpoints(labelled: DataFrame) -> DataFrame:
    """page_id, comp_id, x, y: the middle pixel of each run of every row and column; of two the first."""
    out = []
    for a, b in (("x", "y"), ("y", "x")):
        line = Window.partitionBy(*KEYS, b).orderBy(a)
        runs = labelled.withColumn("run", F.col(a) - F.row_number().over(line)).groupBy(*KEYS, b, "run").agg(F.floor((F.min(a) + F.max(a)) / 2).alias(a))
        out.append(runs.select(*KEYS, "x", "y"))
    return out[0].unionByName(out[1]).distinct()


#: Bits of the eight neighbours, clockwise from above.
AROUND = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]


def neighbour_masks(dark: DataFrame, keys: list[str]) -> DataFrame:
    """``dark`` (keys, x, y) with mask: bit k is set where the neighbour AROUND[k] is foreground. One shuffle, no self join."""
    told = F.explode(F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y"), F.lit(256).alias("bit")), *[F.struct((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.lit(1 << k).alias("bit")) for k, (dx, dy) in enumerate(AROUND)]))
    masks = dark.select(*keys, told.alias("t")).groupBy(*keys, "t.x", "t.y").agg(F.sum("t.bit").alias("mask"))
    return masks.where("mask >= 256").withColumn("mask", (F.col("mask") - 256).cast("int"))


def thinned_once(dark: DataFrame, keys: list[str], step: int = 0) -> DataFrame:
    """``dark`` after one step of two-step thinning: without pixels of 2 to 6 neighbours, one change from off to on around, and a free side."""
    bit = lambda k: F.col("mask").bitwiseAND(1 << (k % 8)) != 0
    count = F.bit_count("mask")
    turns = sum(((~bit(k)) & bit(k + 1)).cast("int") for k in range(8))
    n, e, s, w = bit(0), bit(2), bit(4), bit(6)
    free = ~(n & e & s) & ~(e & s & w) if step == 0 else ~(n & e & w) & ~(n & s & w)
    gone = (count >= 2) & (count <= 6) & (turns == 1) & free
    return neighbour_masks(dark, keys).where(~gone).drop("mask")
