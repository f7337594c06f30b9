"""Page layout: grids, spatial joins, lines, spaces and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.geometry import box_angle, box_gap, centre_distance, centre_x, centre_y, half, intersects, point_to_line

PER_CELL = 20


def grid(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """``boxes`` with cell_id: about PER_CELL boxes to a cell, dividers grown until there are enough cells."""
    n = boxes.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    target = F.greatest(F.lit(1), F.floor(F.col("n") / PER_CELL))
    rows = lambda d: F.floor(d * height / width) + 1
    enough = F.ceil(F.sqrt(F.col("target") * width / height)).cast("int") + 1
    cells = n.withColumn("target", target).withColumn("dx", F.filter(F.sequence(F.lit(0), enough), lambda d: (d + 1) * rows(d) >= F.col("target"))[0])
    cells = cells.select("page_id", (F.col("dx") + 2).alias("nx"), F.floor(width / (F.col("dx") + 1)).alias("cw"), F.floor(height / rows(F.col("dx"))).alias("ch"))
    at = F.floor(centre_x(F.col("x0"), F.col("w")) / F.col("cw")) + F.col("nx") * F.floor(centre_y(F.col("y0"), F.col("h")) / F.col("ch"))
    return boxes.join(cells, "page_id").withColumn("cell_id", at.cast("long")).drop("nx", "cw", "ch")


def _cells(low: Column, high: Column, size: int) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def contained(boxes: DataFrame, cell: int = 64, deflate: int = 2) -> DataFrame:
    """page_id, outer_id, inner_id: the inner box, smaller by ``deflate`` on each side, lies within the outer.

    The outer box stands in every cell that it covers, the inner one in that of its corner: an equi join.
    """
    o = boxes.select("page_id", F.col("comp_id").alias("outer_id"), F.col("x0").alias("ox"), F.col("y0").alias("oy"), F.col("w").alias("ow"), F.col("h").alias("oh"))
    o = o.withColumn("cx", F.explode(_cells(F.col("ox"), F.col("ox") + F.col("ow"), cell))).withColumn("cy", F.explode(_cells(F.col("oy"), F.col("oy") + F.col("oh"), cell)))
    i = boxes.where((F.col("w") > 2 * deflate) & (F.col("h") > 2 * deflate)).select("page_id", F.col("comp_id").alias("inner_id"), (F.col("x0") + deflate).alias("ix"), (F.col("y0") + deflate).alias("iy"), (F.col("w") - 2 * deflate).alias("iw"), (F.col("h") - 2 * deflate).alias("ih"))
    i = i.withColumn("cx", F.floor(F.col("ix") / cell)).withColumn("cy", F.floor(F.col("iy") / cell))
    inside = (F.col("ix") >= F.col("ox")) & (F.col("iy") >= F.col("oy")) & (F.col("ix") + F.col("iw") <= F.col("ox") + F.col("ow")) & (F.col("iy") + F.col("ih") <= F.col("oy") + F.col("oh"))
    return o.join(i, ["page_id", "cx", "cy"]).where(inside & (F.col("outer_id") != F.col("inner_id"))).select("page_id", "outer_id", "inner_id")


def intersecting(boxes: DataFrame, cell: int = 64) -> DataFrame:
    """page_id, a_id, b_id (a < b): boxes with common pixels. A pair is found in the cell of the common corner alone."""
    b = boxes.withColumn("cx", F.explode(_cells(F.col("x0"), F.col("x0") + F.col("w") - 1, cell))).withColumn("cy", F.explode(_cells(F.col("y0"), F.col("y0") + F.col("h") - 1, cell)))
    side = lambda p: b.select("page_id", "cx", "cy", *[F.col(c).alias(f"{p}_{c}") for c in ("comp_id", "x0", "y0", "w", "h")])
    own = (F.floor(F.greatest("a_x0", "b_x0") / cell) == F.col("cx")) & (F.floor(F.greatest("a_y0", "b_y0") / cell) == F.col("cy"))
    meet = intersects(*[F.col(f"a_{c}") for c in ("x0", "y0", "w", "h")], *[F.col(f"b_{c}") for c in ("x0", "y0", "w", "h")])
    return side("a").join(side("b"), ["page_id", "cx", "cy"]).where((F.col("a_comp_id") < F.col("b_comp_id")) & own & meet).select("page_id", F.col("a_comp_id").alias("a_id"), F.col("b_comp_id").alias("b_id"))


def nearest_right(boxes: DataFrame, cell: int = 100, most: int = 100) -> DataFrame:
    """page_id, comp_id, right_id, distance: the nearest box to the right that overlaps vertically, up to ``most`` away.

    Boxes look into their own and the next column of cells, three rows each; of equals the smallest id.
    """
    cx = lambda c: F.floor(centre_x(F.col("x0"), F.col("w")) / cell) + c
    cy = lambda c: F.floor(centre_y(F.col("y0"), F.col("h")) / cell) + c
    seek = boxes.select("page_id", "comp_id", "x0", "y0", "w", "h", F.explode(F.array(*[F.struct(cx(i).alias("cx"), cy(j).alias("cy")) for i in (0, 1) for j in (-1, 0, 1)])).alias("c")).select("*", "c.cx", "c.cy").drop("c")
    found = boxes.select("page_id", F.col("comp_id").alias("right_id"), F.col("x0").alias("rx"), F.col("y0").alias("ry"), F.col("w").alias("rw"), F.col("h").alias("rh"), cx(0).alias("cx"), cy(0).alias("cy"))
    pairs = seek.join(found, ["page_id", "cx", "cy"]).where((F.col("rx") > F.col("x0")) & (F.col("comp_id") != F.col("right_id")) & (F.col("ry") < F.col("y0") + F.col("h")) & (F.col("y0") < F.col("ry") + F.col("rh")))
    d = centre_distance(centre_x(F.col("rx"), F.col("rw")) - centre_x(F.col("x0"), F.col("w")), centre_y(F.col("ry"), F.col("rh")) - centre_y(F.col("y0"), F.col("h")))
    best = pairs.withColumn("distance", d).where(F.col("distance") < most).groupBy("page_id", "comp_id").agg(F.min(F.struct("distance", "right_id")).alias("b"))
    return best.select("page_id", "comp_id", "b.right_id", "b.distance")


def with_line(boxes: DataFrame, height: int = 200) -> DataFrame:
    """``boxes`` with line_id, the strip of ``height`` rows in which the centre lies."""
    return boxes.withColumn("line_id", F.floor(centre_y(F.col("y0"), F.col("h")) / height))


LINE = ["page_id", "line_id"]


def neighbours_on_line(members: DataFrame) -> DataFrame:
    """``members`` with the member before (p_id, px, py, pw, ph), in the order of (x0, comp_id)."""
    w = Window.partitionBy(*LINE).orderBy("x0", "comp_id")
    return members.select("*", *[F.lag(c).over(w).alias(a) for c, a in (("comp_id", "p_id"), ("x0", "px"), ("y0", "py"), ("w", "pw"), ("h", "ph"))])


def gaps_and_angles(members: DataFrame) -> DataFrame:
    """page_id, line_id, p_id, comp_id, gap, angle of each member and the one before it."""
    n = neighbours_on_line(members).where("p_id is not null")
    a, b = [F.col(c) for c in ("px", "py", "pw", "ph")], [F.col(c) for c in ("x0", "y0", "w", "h")]
    return n.select(*LINE, "p_id", "comp_id", box_gap(*a, *b).alias("gap"), F.round(box_angle(*a, *b), 6).alias("angle"))


def spaces(members: DataFrame, share: float = 0.6) -> DataFrame:
    """page_id, line_id, comp_id, n_spaces, sx, sy: spaces before a member whose gap is at least ``share`` of the line's mean width."""
    t = F.floor(share * F.avg("w").over(Window.partitionBy(*LINE)))
    n = neighbours_on_line(members.withColumn("t", t)).withColumn("gap", F.col("x0") - (F.col("px") + F.col("pw")))
    n = n.where("p_id is not null and t > 0 and gap >= t").withColumn("n_spaces", F.floor(F.col("gap") / F.col("t")).cast("long"))
    step = lambda a, b: a + F.floor((b - a) / F.col("n_spaces"))
    return n.select(*LINE, "comp_id", "n_spaces", step(F.col("px") + half(F.col("pw")), F.col("x0") + half(F.col("w"))).cast("long").alias("sx"), step(F.col("py") + half(F.col("ph")), F.col("y0") + half(F.col("h"))).cast("long").alias("sy"))


def line_metrics(members: DataFrame) -> DataFrame:
    """Boxes, means and the angle of first and last member of each line."""
    first = F.min(F.struct("x0", "comp_id", "y0", "w", "h"))
    last = F.max(F.struct("x0", "comp_id", "y0", "w", "h"))
    m = members.groupBy(*LINE).agg(
        F.count(F.lit(1)).alias("n"), F.min("x0").alias("lx"), F.min("y0").alias("ly"), F.max(F.col("x0") + F.col("w")).alias("rx"), F.max(F.col("y0") + F.col("h")).alias("by"),
        F.round(F.avg("w"), 6).alias("avg_w"), F.round(F.avg("h"), 6).alias("avg_h"), first.alias("f"), last.alias("l"),
    )
    angle = box_angle(*[F.col(f"f.{c}") for c in ("x0", "y0", "w", "h")], *[F.col(f"l.{c}") for c in ("x0", "y0", "w", "h")])
    return m.select(*LINE, "n", "lx", "ly", (F.col("rx") - F.col("lx")).alias("lw"), (F.col("by") - F.col("ly")).alias("lh"), "avg_w", "avg_h", F.round(angle, 6).alias("angle"))


def line_thresholds(metrics: DataFrame, quirk: bool = False) -> DataFrame:
    """Where ascenders end and descenders begin, and the centre; ``quirk``: the centre is the height of the two."""
    inset = F.floor(0.11 * F.col("lh"))
    ascent, descent = F.col("ly") + inset, F.col("ly") + F.col("lh") - inset
    centre = F.col("lh") if quirk else F.col("ly") + half(F.col("lh"))
    return metrics.select(*LINE, ascent.alias("ascent"), descent.alias("descent"), centre.cast("long").alias("centre"))


def positions(members: DataFrame, thresholds: DataFrame) -> DataFrame:
    """page_id, line_id, comp_id, top, bottom: where a member's ends lie between its line's thresholds."""
    top = F.when(F.col("y0") < F.col("ascent"), "ascent").when(F.col("y0") < F.col("centre"), "height").otherwise("center")
    end = F.col("y0") + F.col("h")
    bottom = F.when(end > F.col("descent"), "descent").when(end > F.col("centre"), "base").otherwise("center")
    return members.join(thresholds, LINE).select(*LINE, "comp_id", top.alias("top"), bottom.alias("bottom"))


def small_lines_dropped(members: DataFrame, least: int = 3) -> DataFrame:
    """Members of lines that have at least ``least`` of them."""
    return members.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*LINE))).where(F.col("__n") >= least).drop("__n")


def overlays(comps: DataFrame, metrics: DataFrame) -> DataFrame:
    """page_id, kind, x0, y0, x1, y1: what an annotated picture of a page shows."""
    c = comps.select("page_id", F.lit("component").alias("kind"), "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"))
    m = metrics.select("page_id", F.lit("line").alias("kind"), F.col("lx").alias("x0"), F.col("ly").alias("y0"), (F.col("lx") + F.col("lw")).alias("x1"), (F.col("ly") + F.col("lh")).alias("y1"))
    return c.unionByName(m)


def word_islands(chars: DataFrame) -> DataFrame:
    """conv_id, turn, word_no, word: runs of members between spaces, in order."""
    w = Window.partitionBy("conv_id", "turn").orderBy("pos")
    space = (F.col("ch") == " ").cast("int")
    runs = chars.withColumn("island", F.sum(space).over(w)).where("ch <> ' '")
    words = runs.groupBy("conv_id", "turn", "island").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ch"))), lambda s: s["ch"]), "").alias("word"))
    return words.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("island")).cast("long").alias("word_no"), "word")


def page_text(lines: DataFrame, page: str, line: str, content: str) -> DataFrame:
    """Page and its text: each line's number, a space, its content and the line end."""
    said = F.concat(F.col(line).cast("string"), F.lit(" "), F.coalesce(F.col(content), F.lit("")), F.lit("\n\r"))
    return lines.groupBy(page).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(line).alias("k"), said.alias("s")))), lambda x: x["s"]), "").alias("page_text"))


def line_text(words: DataFrame) -> DataFrame:
    """conv_id, turn, content: a line's words with single spaces."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("word_no", "word"))), lambda x: x["word"])
    return words.groupBy("conv_id", "turn").agg(F.array_join(ordered, " ").alias("content"))


def trimmed(members: DataFrame) -> DataFrame:
    """Members without the tenth with the highest and the tenth with the lowest centres, while over ten are left."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*LINE))
    y = centre_y(F.col("y0"), F.col("h"))
    place = F.row_number().over(Window.partitionBy(*LINE).orderBy(y, "comp_id"))
    m = members.withColumn("__n", n).withColumn("__k", place)
    cut = F.greatest(F.lit(0), F.least(F.floor(F.col("__n") / 10), F.ceil((F.col("__n") - 10) / 2)))
    return m.where((F.col("__k") > cut) & (F.col("__k") <= F.col("__n") - cut)).drop("__n", "__k")


def not_on_lines(boxes: DataFrame, members: DataFrame) -> DataFrame:
    return boxes.join(members.select("page_id", "comp_id"), ["page_id", "comp_id"], "left_anti")


#: What labels that are no glyphs are shown as.
PLACEHOLDERS = {"connected": "??", "garbage": "?"}


def content(kind: Column, label: Column) -> Column:
    """What a component says: a space, its label or the label's placeholder; nothing for other kinds."""
    said = label
    for name, shown in PLACEHOLDERS.items():
        said = F.when(label == name, shown).otherwise(said)
    return F.when(kind == "space", " ").when(kind.isin("character", "split"), F.coalesce(said, F.lit(""))).otherwise("")


# --- lines by their bottoms ---------------------------------------------------------------------------------------


def line_bases(members: DataFrame) -> DataFrame:
    """page_id, line_id, base, descent: the sorted bottoms of a line cut where both halves lie nearest to their medians.

    Costs come from running sums, the medians from equi joins on the place; of equal costs the later cut counts. A line of
    one member has its bottom for both.
    """
    line = Window.partitionBy(*LINE)
    bottom = (F.col("y0") + F.col("h")).cast("long")
    order = line.orderBy("b", "comp_id")
    p = members.select(*LINE, "comp_id", bottom.alias("b"))
    p = p.select(*LINE, "b", (F.row_number().over(order) - 1).alias("k"), F.count(F.lit(1)).over(line).alias("n"), F.sum("b").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.sum(F.col("b") * F.col("b")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("q"), F.sum("b").over(line).alias("st"), F.sum(F.col("b") * F.col("b")).over(line).alias("qt"))
    cut = F.when(F.col("n") > 1, F.col("k") + 1).otherwise(0)
    cuts = p.where("k < n - 1 or n = 1").select(*LINE, "n", "s", "q", "st", "qt", cut.alias("cut"))
    cuts = cuts.withColumn("ka", half(F.col("cut"))).withColumn("kd", F.col("cut") + half(F.col("n") - F.col("cut")))
    at = lambda k, name: p.select(*LINE, F.col("k").cast("long").alias(k), F.col("b").alias(name))
    c = cuts.join(at("ka", "base"), [*LINE, "ka"]).join(at("kd", "descent"), [*LINE, "kd"])
    spread = lambda q, s, n, m: q - 2 * m * s + n * m * m
    cost = spread(F.col("q"), F.col("s"), F.col("cut"), F.col("base")) + spread(F.col("qt") - F.col("q"), F.col("st") - F.col("s"), F.col("n") - F.col("cut"), F.col("descent"))
    best = F.min_by(F.struct("base", "descent"), F.struct(cost, -F.col("cut")))
    return c.groupBy(*LINE).agg(best.alias("m")).select(*LINE, "m.base", "m.descent")


def sequential_bases(members: DataFrame, metrics: DataFrame) -> DataFrame:
    """page_id, line_id, base, descent (arrays of x, y): each member's bottom goes to the line whose last point is nearer, from left to right.

    The descent line starts at the bottom of the line's box, the base line a tenth of its height above; ties go to the descent.
    A line's members are one row's array, as they lie on one line of one page.
    """
    point = F.struct(F.col("x0").cast("long").alias("x"), (F.col("y0") + F.col("h")).cast("long").alias("y"))
    own = members.groupBy(*LINE).agg(F.sort_array(F.collect_list(F.struct("x0", "comp_id", point.alias("p")))).alias("own"))
    foot = (F.col("ly") + F.col("lh")).cast("long")
    m = own.join(metrics.select(*LINE, F.col("lx").cast("long").alias("lx"), foot.alias("foot"), F.floor(F.col("lh") / 10).cast("long").alias("tenth")), LINE)
    start = F.struct(F.array(F.struct(F.col("lx").alias("x"), (F.col("foot") - F.col("tenth")).alias("y"))).alias("base"), F.array(F.struct(F.col("lx").alias("x"), F.col("foot").alias("y"))).alias("descent"))
    away = lambda points, p: F.abs(F.element_at(points, -1)["y"] - p["y"])

    def put(a: Column, x: Column) -> Column:
        p, base = x["p"], away(a["descent"], x["p"]) > away(a["base"], x["p"])
        return F.struct(F.when(base, F.concat(a["base"], F.array(p))).otherwise(a["base"]).alias("base"), F.when(base, a["descent"]).otherwise(F.concat(a["descent"], F.array(p))).alias("descent"))

    return m.select(*LINE, F.aggregate("own", start, put).alias("r")).select(*LINE, "r.base", "r.descent")


def line_fit(points: DataFrame, keys: list[str], x: Column, y: Column, px: Column, py: Column, angle: Column) -> DataFrame:
    """keys, squares, xors: how far points lie from the line through (px, py) at ``angle``: the sum of squared distances, and of distances XOR 2."""
    d = point_to_line(px, py, angle, x, y)
    return points.groupBy(*keys).agg(F.sum(d * d).alias("squares"), F.sum(d.bitwiseXOR(F.lit(2).cast("long"))).alias("xors"))


def sliding_means(rows: DataFrame, keys: list[str], order: list[str], value: str, width: int = 4) -> DataFrame:
    """``rows`` with mean: of a row's ``value`` and those of the ``width`` - 1 rows after it, fewer at the end."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, width - 1)
    return rows.withColumn("mean", F.round(F.avg(value).over(w), 6))


def annotations(members: DataFrame, metrics: DataFrame, thresholds: DataFrame, marks: DataFrame) -> DataFrame:
    """page_id, kind, x0, y0, x1, y1: what an annotated picture shows of lines beside their boxes.

    The centre, ascent and descent lines; the reading order from each member's centre to the next one's; a mark for each space.
    """
    ends = metrics.select(*LINE, F.col("lx").alias("x0"), (F.col("lx") + F.col("lw")).alias("x1")).join(thresholds, LINE)
    across = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("y")) for k in ("centre", "ascent", "descent")]))
    across = ends.select("page_id", "x0", "x1", across.alias("a")).select("page_id", "a.kind", "x0", F.col("a.y").alias("y0"), "x1", F.col("a.y").alias("y1"))
    n = neighbours_on_line(members).where("p_id is not null")
    path = n.select("page_id", F.lit("order").alias("kind"), centre_x(F.col("px"), F.col("pw")).alias("x0"), centre_y(F.col("py"), F.col("ph")).alias("y0"), centre_x(F.col("x0"), F.col("w")).alias("x1"), centre_y(F.col("y0"), F.col("h")).alias("y1"))
    space = marks.select("page_id", F.lit("space").alias("kind"), F.col("sx").alias("x0"), F.col("sy").alias("y0"), (F.col("sx") + 2).alias("x1"), (F.col("sy") + 2).alias("y1"))
    return across.unionByName(path).unionByName(space)
