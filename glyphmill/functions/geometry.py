"""Box geometry as column expressions. Boxes are (x0, y0, w, h) of whole numbers, half-open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half(c: Column) -> Column:
    return F.floor(c / 2)


def centre_x(x0: Column, w: Column) -> Column:
    return x0 + half(w)


def centre_y(y0: Column, h: Column) -> Column:
    return y0 + half(h)


def contains_point(x0: Column, y0: Column, w: Column, h: Column, px: Column, py: Column) -> Column:
    return (px >= x0) & (px < x0 + w) & (py >= y0) & (py < y0 + h)


def intersects(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    return (ax < bx + bw) & (bx < ax + aw) & (ay < by + bh) & (by < ay + ah)


def centre_distance(dx: Column, dy: Column) -> Column:
    """Whole part of the distance between two centres."""
    return F.floor(F.sqrt((dx * dx + dy * dy).cast("double"))).cast("long")


def _truncate(c: Column) -> Column:
    return F.when(c < 0, -F.floor(-c)).otherwise(F.floor(c))


def _gap_steps(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> list:
    """What a gap is worked out by, as rounds of (name, expression over the columns of the rounds before, by name).

    Steps from a box's centre along the longer axis that stay inside the box, the centre included and at most its longer
    side and 1, are counted without taking them: step k is off by the whole part of k * (d / longer) on an axis, which never
    falls, so the first step beyond ``n`` whole ones is ceil(n * longer / d), or the next where floating point falls short of n.
    Right while sides times distances are under 2^50.
    """
    sides = (("ax", "dx", aw, 1), ("ay", "dy", ah, 1), ("bx", "dx", bw, -1), ("by", "dy", bh, -1))
    far = lambda c, d: F.greatest(F.abs(c[d]), F.lit(1)).cast("double")

    def inside(c: dict[str, Column], p: str, w: Column, h: Column) -> Column:
        along = lambda d, n, k: F.when(c[d] == 0, F.lit(1e18)).otherwise(c[k] + F.when(c[k] * c[f"r{d}"] < c[n], 1.0).otherwise(0.0))
        steps = F.least((F.greatest(w, h) + 1).cast("double"), along("dx", f"n{p}x", f"k{p}x"), along("dy", f"n{p}y", f"k{p}y"))
        return F.when((w < 1) | (h < 1), 0.0).otherwise(steps)

    return [
        [("dx", lambda c: centre_x(bx, bw) - centre_x(ax, aw)), ("dy", lambda c: centre_y(by, bh) - centre_y(ay, ah))],
        [
            ("longer", lambda c: F.greatest(F.abs(c["dx"]), F.abs(c["dy"]), F.lit(1)).cast("double")),
            *[(f"n{p}", lambda c, d=d, side=side, to=to: F.when(c[d] * to > 0, side - half(side)).otherwise(half(side) + 1).cast("double")) for p, d, side, to in sides],
        ],
        [("rdx", lambda c: far(c, "dx") / c["longer"]), ("rdy", lambda c: far(c, "dy") / c["longer"]), *[(f"k{p}", lambda c, p=p, d=d: F.ceil(c[f"n{p}"] * c["longer"] / far(c, d)).cast("double")) for p, d, *_ in sides]],
        [("ina", lambda c: inside(c, "a", aw, ah)), ("inb", lambda c: inside(c, "b", bw, bh))],
        [("gap", lambda c: F.when((c["dx"] == 0) & (c["dy"] == 0), F.lit(0)).otherwise(centre_distance(c["dx"], c["dy"]) + 1 - c["ina"] - c["inb"]).cast("long"))],
    ]


def box_gap(*sides: Column) -> Column:
    """Distance of the centres and 1, less the steps from each centre that stay in its own box; 0 for equal centres. ``sides``: x, y, w, h of either box."""
    known: dict[str, Column] = {}
    for found in _gap_steps(*sides):
        known |= {name: f(known) for name, f in found}
    return known["gap"]


def with_box_gap(df: DataFrame, name: str, *sides: str) -> DataFrame:
    """``df`` with ``box_gap`` of the columns ``sides``. It is worked out step by step: as one expression it is too long for the JVM to compile."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    own, known = df.columns, {}
    for found in _gap_steps(*map(F.col, sides)):
        df = df.withColumns({prefix + n: f(known) for n, f in found})
        known |= {n: F.col(prefix + n) for n, _ in found}
    return df.select(*[F.col(f"`{c}`") for c in own], known["gap"].alias(name))


def box_angle(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Angle in degrees, 0 to 90, of the line between the centres; axes on which the boxes overlap count as 0."""
    dx = F.when((ax < bx + bw) & (bx < ax + aw), 0).otherwise(F.abs(centre_x(bx, bw) - centre_x(ax, aw)))
    dy = F.when((ay < by + bh) & (by < ay + ah), 0).otherwise(F.abs(centre_y(by, bh) - centre_y(ay, ah)))
    return F.when(dx == 0, F.when(dy == 0, 0.0).otherwise(90.0)).otherwise(F.degrees(F.atan(dy / dx)))


def point_to_line(px: Column, py: Column, angle: Column, x: Column, y: Column) -> Column:
    """Whole distance of (x, y) from the line through (px, py) that falls 1000 sin(angle) on 1000."""
    fall = _truncate(1000 * F.sin(angle)).cast("long")
    off = F.abs((x - px) * fall - 1000 * (y - py)).cast("double")
    return F.floor(off / F.sqrt((F.lit(1000 * 1000) + fall * fall).cast("double"))).cast("long")
