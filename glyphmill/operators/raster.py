"""Statistics of page rasters, given as pixels (page_id, x, y, gray). 0 is black, 255 is white."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Gray levels above it are white.
THRESHOLD = 170
NEIGHBOURS = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]


def binarise(px: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    return px.withColumn("bit", F.when(F.col("gray") > threshold, 255).otherwise(0))


def histogram(px: DataFrame) -> DataFrame:
    """page_id, gray, n; the white bin 255 is left out."""
    return px.where("gray < 255").groupBy("page_id", "gray").agg(F.count(F.lit(1)).alias("n"))


def peaks(px: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """page_id, black, white: the most frequent level below the threshold, and from it on; of equals the lowest; 0 if none."""
    order = F.struct("n", -F.col("gray"))
    best = lambda side: F.coalesce(F.max_by(F.when(side, F.col("gray")), F.when(side, order)), F.lit(0)).cast("int")
    return histogram(px).groupBy("page_id").agg(best(F.col("gray") < threshold).alias("black"), best(F.col("gray") >= threshold).alias("white"))


def otsu(px: DataFrame) -> DataFrame:
    """page_id, threshold: Otsu's threshold; pixels up to it are one class. Of equals the lowest; none for one level.

    The windows run over at most 255 levels of a page.
    """
    w = Window.partitionBy("page_id").orderBy("gray")
    whole = Window.partitionBy("page_id")
    h = histogram(px).withColumn("s", F.col("n") * F.col("gray"))
    h = h.select("page_id", "gray", F.sum("n").over(w).alias("n0"), F.sum("s").over(w).alias("s0"), F.sum("n").over(whole).alias("nt"), F.sum("s").over(whole).alias("st"))
    n0, n1 = F.col("n0").cast("double"), (F.col("nt") - F.col("n0")).cast("double")
    s0, s1 = F.col("s0").cast("double"), (F.col("st") - F.col("s0")).cast("double")
    between = (s0 * n1 - s1 * n0) * (s0 * n1 - s1 * n0) / (n0 * n1)
    return h.where("nt > n0").groupBy("page_id").agg(F.max_by("gray", F.struct(between, -F.col("gray"))).alias("threshold"))


def otsu_as_written(px: DataFrame, area: int) -> DataFrame:
    """page_id, threshold: the variant whose class variance has the last level of each class only.

    Levels from 1 to 254 are tried; a variance of 0 is always replaced by the next one, so what counts are the levels
    after the last 0; of these the first with the least variance, or the last 0 itself if none comes after it.
    """
    levels = px.select("page_id").distinct().select("page_id", F.explode(F.sequence(F.lit(1), F.lit(254))).alias("t"))
    h = histogram(px).select("page_id", (F.col("gray") + 1).alias("t"), "n", (F.col("n") * F.col("gray")).alias("s"))
    w = Window.partitionBy("page_id").orderBy("t")
    v = h.unionByName(levels.select("page_id", "t", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"))).groupBy("page_id", "t").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    v = v.select("page_id", "t", "n", F.sum("n").over(w).alias("nf"), F.sum("s").over(w).alias("sf")).where("t between 1 and 254")
    off = F.col("t") - 1 - F.coalesce(F.try_divide(F.col("sf").cast("double"), F.col("nf").cast("double")), F.lit(0.0))
    v = v.select("page_id", "t", F.coalesce(F.try_divide(F.col("nf").cast("double") / area * (F.col("n") * off * off), F.col("nf").cast("double")), F.lit(0.0)).alias("v"))
    v = v.withColumn("zero", F.coalesce(F.max(F.when(F.col("v") == 0, F.col("t"))).over(Window.partitionBy("page_id")), F.lit(0)))
    best = F.min_by(F.when(F.col("t") > F.col("zero"), F.col("t")), F.when(F.col("t") > F.col("zero"), F.struct("v", "t")))
    return v.groupBy("page_id").agg(F.coalesce(best, F.max("zero")).alias("threshold"))


def projections(px: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """page_id, axis, at, n: foreground pixels of each column (x) and row (y)."""
    dark = px.where(F.col("gray") <= threshold)
    sides = F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("x").alias("at")), F.struct(F.lit("y").alias("axis"), F.col("y").alias("at"))))
    return dark.select("page_id", sides.alias("s")).groupBy("page_id", "s.axis", "s.at").agg(F.count(F.lit(1)).alias("n"))


def neighbour_counts(dark: DataFrame, keys: list[str]) -> DataFrame:
    """``dark`` (keys, x, y) with n, the foreground pixels of the eight around.

    Each pixel tells its neighbours and itself; one shuffle, no self join.
    """
    around = F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(int(not (dx or dy))).alias("own")) for dx, dy in [*NEIGHBOURS, (0, 0)]]))
    told = dark.select(*keys, around.alias("a"))
    counted = told.groupBy(*keys, F.col("a.x").alias("x"), F.col("a.y").alias("y")).agg(F.max("a.own").alias("own"), F.sum(1 - F.col("a.own")).alias("n"))
    return counted.where("own = 1").drop("own")


def pixel_types(dark: DataFrame, keys: list[str]) -> DataFrame:
    """``dark`` with type: End for one neighbour, Junction for three and more, else Regular."""
    kind = F.when(F.col("n") == 1, "End").when(F.col("n") >= 3, "Junction").otherwise("Regular")
    return neighbour_counts(dark, keys).withColumn("type", kind)


def normalise32(members: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels (keys, x, y) of components scaled into 32 x 32: nearest neighbour, the larger scale at most twice the smaller, centred.

    Every member pixel gives the target pixels that it is the source of, so nothing is joined with a grid.
    """
    box = Window.partitionBy(*keys)
    p = members.select("*", F.min("x").over(box).alias("x0"), F.min("y").over(box).alias("y0"), F.max("x").over(box).alias("x1"), F.max("y").over(box).alias("y1"))
    p = p.withColumn("w", F.col("x1") - F.col("x0") + 1).withColumn("h", F.col("y1") - F.col("y0") + 1)
    rx, ry = 32.0 / F.col("w"), 32.0 / F.col("h")
    p = p.withColumn("sx", F.least(rx, 2 * ry)).withColumn("sy", F.least(ry, 2 * rx))
    p = p.withColumn("tw", F.floor(F.col("w") * F.col("sx"))).withColumn("th", F.floor(F.col("h") * F.col("sy")))
    from_ = lambda c, s: F.ceil((F.col(c) - F.col(c + "0")) * F.col(s)).cast("int")
    to = lambda c, s, size: F.least(F.ceil((F.col(c) - F.col(c + "0") + 1) * F.col(s)), F.col(size)).cast("int")
    span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    p = p.select(*keys, "tw", "th", F.explode(span(from_("x", "sx"), to("x", "sx", "tw"))).alias("i"), "y", "y0", "sy")
    p = p.select(*keys, "tw", "th", "i", F.explode(span(from_("y", "sy"), to("y", "sy", "th"))).alias("j"))
    return p.select(*keys, (F.col("i") + F.floor((32 - F.col("tw")) / 2)).cast("long").alias("x"), (F.col("j") + F.floor((32 - F.col("th")) / 2)).cast("long").alias("y"))
