"""Operators that hold one page at a time: glyph features, line growth, recognition of whole pages."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators import components, kernels, lexicon, network
from glyphmill.operators.components import label_pixels
from glyphmill.operators.layout import PLACEHOLDERS


def glyphs(page: pd.DataFrame, least: int = 8) -> Iterator[tuple[int, np.ndarray]]:
    """comp_id and plane of the components (comp_id, x, y) of a page with at least ``least`` pixels."""
    for comp, g in page.groupby("comp_id", sort=True):
        if len(g) >= least:
            x, y = g["x"].to_numpy(), g["y"].to_numpy()
            plane = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), dtype=bool)
            plane[y - y.min(), x - x.min()] = True
            yield int(comp), plane


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by ``key`` for work that is long for its bytes: to a number of partitions that adaptive execution doesn't lower."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key)


def per_glyph(labelled: DataFrame, schema: str, f: Callable[[np.ndarray], tuple], least: int = 8) -> DataFrame:
    """page_id, comp_id and what ``f`` tells of each component's plane."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(page: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(page["page_id"].iloc[0]), comp, *f(plane)) for comp, plane in glyphs(page, least)]
        return pd.DataFrame(rows, columns=["page_id", "comp_id", *names])

    return labelled.groupBy("page_id").applyInPandas(run, f"page_id long, comp_id long, {schema}")


def thinned(labelled: DataFrame, kind: str) -> DataFrame:
    """page_id, comp_id, before, after: pixels of the normalised glyph and of its skeleton."""
    f = {"condensed": kernels.thin_condensed, "standard": kernels.thin_standard, "eroding": kernels.thin_eroding, "midpoints": kernels.thin_midpoints, "staircases": kernels.drop_staircases, "runs": kernels.prune_runs, "spurs": kernels.drop_spurs}[kind]

    def one(plane: np.ndarray) -> tuple:
        n = kernels.normalise(plane)
        return int(n.sum()), int(f(n).sum())

    return per_glyph(labelled, "before long, after long", one)


def features(labelled: DataFrame) -> DataFrame:
    """page_id, comp_id, features: the 48 inputs of each glyph, without a position; a page's glyphs are thinned as one stack."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        own = list(glyphs(page))
        found = kernels.features48_of([(kernels.normalise(p), p.shape[1], p.shape[0], (0, 0, 0, 0, 0)) for _, p in own])
        rows = [(int(page["page_id"].iloc[0]), comp, f.tolist()) for (comp, _), f in zip(own, found, strict=True)]
        return pd.DataFrame(rows, columns=["page_id", "comp_id", "features"])

    return labelled.groupBy("page_id").applyInPandas(run, "page_id long, comp_id long, features array<double>")


def stroke_counts(labelled: DataFrame) -> DataFrame:
    def one(plane: np.ndarray) -> tuple:
        codes, n = kernels.strokes(kernels.thin_condensed(kernels.normalise(plane)))
        return n, *[int((codes == c).sum()) for c in (16, 32, 48, 64)]

    return per_glyph(labelled, "strokes long, upright long, rising long, level long, falling long", one)


def split_cuts(labelled: DataFrame) -> DataFrame:
    return per_glyph(labelled, "cuts array<long>", lambda p: (kernels.cuts(p),))


def shapes(labelled: DataFrame) -> DataFrame:
    """page_id, comp_id, holes, class of each glyph, by the mean area of its page."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        own = list(glyphs(page))
        mean = float(np.mean([p.size for _, p in own])) if own else 0.0
        rows = [(int(page["page_id"].iloc[0]), comp, kernels.holes(p), kernels.shape_class(p, mean)) for comp, p in own]
        return pd.DataFrame(rows, columns=["page_id", "comp_id", "holes", "class"])

    return labelled.groupBy("page_id").applyInPandas(run, "page_id long, comp_id long, holes long, class string")


# --- lines ------------------------------------------------------------------------------------------------------


def _overlap(a: tuple, b: tuple) -> bool:
    return a[1] < b[1] + b[3] and b[1] < a[1] + a[3]


def _apart(a: tuple, b: tuple) -> tuple[int, int]:
    dx = 0 if a[0] < b[0] + b[2] and b[0] < a[0] + a[2] else abs(b[0] + b[2] // 2 - a[0] - a[2] // 2)
    return dx, 0 if _overlap(a, b) else abs(b[1] + b[3] // 2 - a[1] - a[3] // 2)


def _angle(a: tuple, b: tuple) -> float:
    dx, dy = _apart(a, b)
    return math.degrees(math.atan2(dy, dx)) if dx or dy else 0.0


def _gap(a: tuple, b: tuple) -> int:
    acx, acy, bcx, bcy = a[0] + a[2] // 2, a[1] + a[3] // 2, b[0] + b[2] // 2, b[1] + b[3] // 2
    dx, dy = bcx - acx, bcy - acy
    if not dx and not dy:
        return 0

    longest = max(abs(dx), abs(dy))

    def inside(w: int, h: int, dx: int, dy: int) -> int:
        """Steps from the centre that stay in the box: on an axis, the first one beyond n whole ones is ceil(n * longest / d)."""
        if w < 1 or h < 1:
            return 0
        return min(-(-(s - s // 2 if d > 0 else s // 2 + 1) * longest // abs(d)) for d, s in ((dx, w), (dy, h)) if d)

    return math.isqrt(dx * dx + dy * dy) + 1 - inside(a[2], a[3], dx, dy) - inside(b[2], b[3], -dx, -dy)


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``_gap`` of columns of boxes: x, y, w, h as rows."""
    dx, dy = b[0] + b[2] // 2 - a[0] - a[2] // 2, b[1] + b[3] // 2 - a[1] - a[3] // 2
    longest = np.maximum(np.abs(dx), np.abs(dy))

    def inside(w: np.ndarray, h: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
        first = [np.where(d != 0, -(-np.where(d > 0, s - s // 2, s // 2 + 1) * longest // np.maximum(np.abs(d), 1)), np.iinfo(np.int64).max) for d, s in ((dx, w), (dy, h))]
        return np.where((w < 1) | (h < 1), 0, np.minimum(*first))

    square = dx * dx + dy * dy
    out = np.sqrt(square.astype(float)).astype(np.int64) + 1
    away = square > 0
    return np.where(away, out - np.where(away, inside(a[2], a[3], dx, dy) + inside(b[2], b[3], -dx, -dy), 0), 0)


def _near(boxes: np.ndarray, cw: int, ch: int, side: int) -> tuple[list[int], list[int], list[int], list[bool]]:
    """For each box (columns x, y, w, h) those on a side of it that a line can go on with, looked for in its own and the next
    column of cells, the nearest first, then as they stand in the cells: where a box's begin, their numbers, gaps, and whether level within 5 degrees."""
    x, y, w, h = boxes
    cx, cy, reach = x + w // 2, y + h // 2, np.maximum(w, h) // 2 + 1
    column, row = cx // cw, cy // ch
    tall = int(row.max() - row.min()) + 3
    cell = (column - column.min() + 1) * tall + row - row.min() + 1  # three rows of a column follow each other
    order = np.argsort(cell, kind="stable")
    there = cell[order]
    ask = np.stack([cell, cell + side * tall], 1).ravel()
    low, high = np.searchsorted(there, ask - 1, "left"), np.searchsorted(there, ask + 1, "right")
    most = min(2000, int(1.5 * int(h.max())))
    found = []
    ends = np.cumsum(high - low)
    first = 0
    while first < len(ask):  # a million pairs at a time
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + 1_000_000, "right")))
        n = high[first:last] - low[first:last]
        at = np.repeat(np.arange(first, last), n)
        place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + low[at]
        a, b = at // 2, order[place]
        keep = (side * (x[b] - x[a]) > 0) & (np.maximum(np.abs(cx[b] - cx[a]), np.abs(cy[b] - cy[a])) - reach[a] - reach[b] < most)
        a, b, at, place = a[keep], b[keep], at[keep], place[keep]
        gap = _gaps(boxes[:, a], boxes[:, b])
        keep = gap < most
        found.append((a[keep], gap[keep], at[keep], place[keep], b[keep]))
        first = last
    a, gap, at, place, b = (np.concatenate(c) for c in zip(*found, strict=True))
    by = np.lexsort((place, at, gap, a))
    a, b, gap = a[by], b[by], gap[by]
    dx = np.where((x[a] < x[b] + w[b]) & (x[b] < x[a] + w[a]), 0, np.abs(cx[b] - cx[a]))
    dy = np.where((y[a] < y[b] + h[b]) & (y[b] < y[a] + h[a]), 0, np.abs(cy[b] - cy[a]))
    return np.searchsorted(a, np.arange(len(x) + 1)).tolist(), b.tolist(), gap.tolist(), (np.degrees(np.arctan2(dy, dx)) < 5).tolist()


def grow(boxes: list[tuple], cell: tuple[int, int]) -> list[list[int]]:
    """Lines as lists of numbers of ``boxes`` (x, y, w, h), from left to right.

    A line starts with the first free box, cell by cell. It takes the nearest free box to its right end, then to its
    left end, until neither has one: within one and a half times the line's mean height, level within 5 degrees or
    overlapping the line vertically, looked for in the end's own and the next column of cells, three rows each.
    """
    if not boxes:
        return []
    cw, ch = max(1, cell[0]), max(1, cell[1])
    sides = np.array(boxes, dtype=np.int64).reshape(-1, 4).T
    near = {side: _near(sides, cw, ch, side) for side in (1, -1)}
    column, row = (sides[0] + sides[2] // 2) // cw, (sides[1] + sides[3] // 2) // ch
    order = np.lexsort((column, row)).tolist()
    tops, bottoms, heights = sides[1].tolist(), (sides[1] + sides[3]).tolist(), sides[3].tolist()
    free = [True] * len(boxes)
    lines = []

    top = bottom = tall = count = 0  # of the line that grows

    def taken(k: int) -> None:
        nonlocal top, bottom, tall, count
        top, bottom = (min(top, tops[k]), max(bottom, bottoms[k])) if count else (tops[k], bottoms[k])
        tall, count = tall + heights[k], count + 1
        free[k] = False

    def nearest(end: int, side: int) -> int | None:
        starts, found, gaps, level = near[side]
        most = min(2000, int(1.5 * tall / count))
        for j in range(starts[end], starts[end + 1]):
            if gaps[j] >= most:
                return None
            k = found[j]
            if free[k] and (level[j] or (tops[k] < bottom and top < bottoms[k])):
                return k
        return None

    for first in order:
        if not free[first]:
            continue
        count = tall = 0
        taken(first)
        line = [first]
        while True:
            right = nearest(line[-1], 1)
            if right is not None:
                taken(right)
                line.append(right)
            left = nearest(line[0], -1)
            if left is not None:
                taken(left)
                line.insert(0, left)
            if right is None and left is None:
                break
        lines.append(line)
    return lines


def _union(a: tuple, b: tuple) -> tuple:
    x, y = min(a[0], b[0]), min(a[1], b[1])
    return x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y


def _columns(boxes: list[tuple]) -> np.ndarray:
    """x, y, w, h, the centres' x and y, and the longer sides of boxes."""
    out = np.array([(*b, b[0] + b[2] // 2, b[1] + b[3] // 2, max(b[2:])) for b in boxes], dtype=np.int64).reshape(-1, 7)
    return out.T.copy()


def _host(orphan: tuple, line: list[int], own: np.ndarray, boxes: list[tuple]) -> int | None:
    """The place in a line of the member that a box inside the line belongs to: above or below it, near, better than those before.

    ``own``: the members' ``_columns``.
    """
    tilt = _angle(boxes[line[0]], boxes[line[-1]]) if len(line) > 1 else 0.0
    ox, oy, ow, oh = orphan
    # a host is within three times its longer side, or exactly square to the line, which few members are: only these need a look
    wide = 4 * own[6] + (max(ow, oh) + 1)
    across, down = np.abs(own[4] - (ox + ow // 2)), np.abs(own[5] - (oy + oh // 2))
    if tilt in (0, 90):
        near = (down if tilt else across) <= wide
    else:
        run, rise = _apart(boxes[line[0]], boxes[line[-1]])
        near = ((across <= wide) & (down <= wide)) | (down * rise == across * run)
    some = np.flatnonzero(near)
    if not len(some):
        return None
    x, y, w, h = own[:4, some]
    dx = np.where((x < ox + ow) & (ox < x + w), 0, np.abs(ox + ow // 2 - x - w // 2))
    dy = np.where((y < oy + oh) & (oy < y + h), 0, np.abs(oy + oh // 2 - y - h // 2))
    off = np.abs(np.degrees(np.arctan2(dy, dx)) % 180 - 90 + tilt)
    host, nearest, squarest = None, 1000, 90.0
    # a gap is no less than the centres' distance without both boxes' longer sides: most members need no closer look
    least = np.hypot(ox + ow // 2 - x - w // 2, oy + oh // 2 - y - h // 2).astype(np.int64) - np.maximum(w, h) - max(ow, oh) - 1
    for j in np.flatnonzero((off <= 10 + 1e-9) & (least < nearest) & ((least <= 3 * np.maximum(w, h)) | (off < 1e-9))).tolist():
        b = boxes[line[some[j]]]
        off_k = abs(_angle(b, orphan) % 180 - 90 + tilt)
        if off_k <= min(10, squarest) and least[j] < nearest:
            d = _gap(b, orphan)
            if d < nearest and (d <= 3 * max(b[2], b[3]) or off_k == 0):
                host, nearest, squarest = int(some[j]), d, off_k
    return host


def clean(boxes: list[tuple], lines: list[list[int]], least: int = 3, margin: int = 2, merged: list[tuple[int, int]] | None = None) -> tuple[list[list[int]], list[tuple]]:
    """Lines cleaned up, by top and left, and the boxes; a merged box stands in the place of its first part, ``merged`` gets (its place, the other part's).

    The boxes of a line inside another (by ``margin``) go to the members above or below them, or are dropped; lines that
    meet become one; lines of under ``least`` members are dropped; parts stacked on each other become one box.
    """
    boxes, lines = list(boxes), [list(x) for x in lines]

    def area(line: list[int]) -> tuple:
        out = boxes[line[0]]
        for k in line[1:]:
            out = _union(out, boxes[k])
        return out

    # areas as columns: of each line, the next other line that lies within it or meets it is found at once
    found = [area(x) if x else (0, 0, 0, 0) for x in lines]
    x0, y0, w, h = np.array(found, dtype=np.int64).reshape(-1, 4).T.copy()
    alive = np.array([bool(x) for x in lines], dtype=bool)

    def wider(k: int, box: tuple) -> None:
        """The area of line ``k`` with a box that it has got."""
        x0[k], y0[k], w[k], h[k] = _union((int(x0[k]), int(y0[k]), int(w[k]), int(h[k])), box)

    for outer in range(len(lines)):
        inner = -1
        own = None  # the outer line's boxes as columns, until it gets members
        while alive[outer]:
            ax, ay, aw, ah = x0[outer], y0[outer], w[outer], h[outer]
            after = slice(inner + 1, None)
            bx, by, bw, bh = x0[after], y0[after], w[after], h[after]
            within = (bx + margin >= ax) & (by + margin >= ay) & (bx + bw - margin <= ax + aw) & (by + bh - margin <= ay + ah)
            hit = alive[after] & (within | ((ax < bx + bw) & (bx < ax + aw) & (ay < by + bh) & (by < ay + ah)))
            if inner < outer:
                hit[outer - inner - 1] = False
            k = int(hit.argmax()) if len(hit) else 0
            if not len(hit) or not hit[k]:
                break
            inner += 1 + k
            if within[k]:
                if own is None:
                    own = _columns([boxes[j] for j in lines[outer]])
                for part in lines[inner]:
                    at = _host(boxes[part], lines[outer], own, boxes)
                    if at is not None:
                        host = lines[outer][at]
                        boxes[host] = _union(boxes[host], boxes[part])
                        own[:, at : at + 1] = _columns([boxes[host]])
                        wider(outer, boxes[part])
                        if merged is not None:
                            merged.append((host, part))
                lines[inner], alive[inner] = [], False
            else:
                left, right = (outer, inner) if ax <= x0[inner] else (inner, outer)
                lines[left] += lines[right]
                lines[right], alive[right] = [], False
                own = None
                wider(left, (int(x0[right]), int(y0[right]), int(w[right]), int(h[right])))
        lines[outer].sort(key=lambda k: (boxes[k][0], k))
    out = []
    for line in lines:
        line.sort(key=lambda k: (boxes[k][0], k))
        if len(line) < least:
            continue
        k = 0
        while k + 1 < len(line):
            if 88 < _angle(boxes[line[k]], boxes[line[k + 1]]) < 92:
                if merged is not None:
                    merged.append((line[k], line[k + 1]))
                boxes[line[k]] = _union(boxes[line[k]], boxes[line.pop(k + 1)])
            k += 1
        out.append(line)
    out.sort(key=lambda x: (area(x)[1], area(x)[0]))
    return out, boxes


def base_and_descent(bottoms: list[int]) -> tuple[int, int]:
    """Heights of the base and the descent line: the cut of the sorted bottoms whose halves lie nearest to their medians."""
    y = np.sort(np.asarray(bottoms, dtype=np.int64))
    best, lines = None, (int(y[len(y) // 2]),) * 2
    for cut in range(len(y) - 1, 0, -1):
        base, descent = int(y[cut // 2]), int(y[cut + (len(y) - cut) // 2])
        cost = int(((y[:cut] - base) ** 2).sum() + ((y[cut:] - descent) ** 2).sum())
        if best is None or cost < best:
            best, lines = cost, (base, descent)
    return lines


def line_bases_of(members: DataFrame) -> DataFrame:
    """page_id, line_id, base, descent of lines' members; a task holds one line."""

    def run(line: pd.DataFrame) -> pd.DataFrame:
        base, descent = base_and_descent((line["y0"] + line["h"]).tolist())
        return pd.DataFrame([(int(line["page_id"].iloc[0]), int(line["line_id"].iloc[0]), base, descent)], columns=["page_id", "line_id", "base", "descent"])

    return members.groupBy("page_id", "line_id").applyInPandas(run, "page_id long, line_id long, base long, descent long")


def _cell(n: int, width: int, height: int) -> tuple[int, int]:
    target = max(1, n // 20)
    dx = next(d for d in range(target + 1) if (d + 1) * (d * height // width + 1) >= target)
    return width // (dx + 1), height // (dx * height // width + 1)


def lines(boxes: DataFrame, width: int, height: int, cleaned: bool = True) -> DataFrame:
    """page_id, line_id, pos, comp_id, x0, y0, w, h: the members of the lines of each page."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("comp_id", ignore_index=True)
        own = list(page[["x0", "y0", "w", "h"]].astype(int).itertuples(index=False, name=None))
        found = grow(own, _cell(len(own), width, height))
        if cleaned:
            found, own = clean(own, found)
        rows = [(int(page["page_id"].iloc[0]), line, pos, int(page["comp_id"].iloc[k]), *own[k]) for line, members in enumerate(found) for pos, k in enumerate(members)]
        return pd.DataFrame(rows, columns=["page_id", "line_id", "pos", "comp_id", "x0", "y0", "w", "h"])

    return spread(boxes, "page_id").groupBy("page_id").applyInPandas(run, "page_id long, line_id long, pos long, comp_id long, x0 long, y0 long, w long, h long")


# --- whole pages ------------------------------------------------------------------------------------------------


def page_components(pages: DataFrame, threshold: int = 170, least: int = 8, straighten: bool = True) -> DataFrame:
    """path, comp_id, x0, y0, w, h, pixel_count, glyph (its gray raster, 255 around it) of page images (path, width, height, raster), row by row.

    A page is one row, so nothing is shuffled; the same function serves batches and streams.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                gray = np.frombuffer(r.raster, np.uint8).reshape(r.height, r.width)
                if straighten:
                    gray = kernels.deskew(gray, kernels.skew(gray <= threshold))
                y, x = np.nonzero(gray <= threshold)
                rows = []
                if len(x):
                    first = label_pixels(x, y)
                    page = pd.DataFrame({"comp_id": y[first].astype(np.int64) * gray.shape[1] + x[first], "x": x, "y": y})[np.bincount(first, minlength=len(x))[first] >= least]
                    for comp, g in page.groupby("comp_id", sort=True):
                        u, v = g["x"].to_numpy(), g["y"].to_numpy()
                        w, h = int(u.max() - u.min()) + 1, int(v.max() - v.min()) + 1
                        if len(g) >= least and w < 0.9 * r.width and h < 0.9 * r.height:
                            plane = np.full((h, w), 255, dtype=np.uint8)
                            plane[v - v.min(), u - u.min()] = gray[v, u]
                            rows.append((r.path, int(comp), int(u.min()), int(v.min()), w, h, len(g), plane.tobytes()))
                yield pd.DataFrame(rows, columns=["path", "comp_id", "x0", "y0", "w", "h", "pixel_count", "glyph"])

    return pages.select("path", "width", "height", "raster").mapInPandas(run, "path string, comp_id long, x0 long, y0 long, w long, h long, pixel_count long, glyph binary")


def typed_components(comps: DataFrame) -> DataFrame:
    """Components of pages without outsized ones, with type."""
    return components.classify(components.drop_outsized(comps, key="path"), key="path")


def position_flags(top: int, bottom: int, line_top: int, line_bottom: int) -> list[int]:
    """Ascent, height, center, base, descent of a glyph between its line's thresholds."""
    inset = int(0.11 * (line_bottom - line_top))
    ascent, descent, centre = line_top + inset, line_bottom - inset, line_top + (line_bottom - line_top) // 2
    out = [0] * 5
    out[0 if top < ascent else 1 if top < centre else 2] = 1
    out[4 if bottom > descent else 3 if bottom > centre else 2] = 1
    return out


PLACED = "path string, line_id long, pos long, comp_id long, x0 long, y0 long, w long, h long, pixel_count long, glyph binary, position array<int>, spaces long"


def placed_components(comps: DataFrame, width: int, height: int, least: int = 3, spaces: float = 0.6) -> DataFrame:
    """Characters (type) on lines: line_id, pos, position (five flags) and the spaces before them; what is on no line has line_id null.

    Parts that clean-up merges become one glyph: boxes and rasters united, pixel counts added, the later part's pixels above
    the earlier one's. A task holds one page.
    """

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("comp_id", ignore_index=True)
        path = page["path"].iloc[0]
        chars = page[page["type"] == "character"].reset_index(drop=True)
        own = list(chars[["x0", "y0", "w", "h"]].astype(int).itertuples(index=False, name=None))
        merged: list[tuple[int, int]] = []
        found, boxes = clean(own, grow(own, _cell(len(own), width, height)), least, merged=merged) if own else ([], [])
        parts: dict[int, list[int]] = {}
        for a, b in merged:
            parts.setdefault(a, [a]).extend(parts.pop(b, [b]))
        rows, used = [], set()
        for number, line in enumerate(found):
            area = boxes[line[0]]
            for k in line[1:]:
                area = _union(area, boxes[k])
            t = int(spaces * sum(boxes[k][2] for k in line) / len(line))
            for pos, k in enumerate(line):
                x, y, w, h = boxes[k]
                raster = np.full((h, w), 255, dtype=np.uint8)
                for part in parts.get(k, [k]):
                    px, py, pw, ph = own[part]
                    glyph = np.frombuffer(chars["glyph"].iloc[part], np.uint8).reshape(ph, pw)
                    view = raster[py - y : py - y + ph, px - x : px - x + pw]
                    view[glyph != 255] = glyph[glyph != 255]
                    used.add(part)
                gap = x - (boxes[line[pos - 1]][0] + boxes[line[pos - 1]][2]) if pos else 0
                count = int(sum(chars["pixel_count"].iloc[part] for part in parts.get(k, [k])))
                rows.append((path, number, pos, int(chars["comp_id"].iloc[k]), x, y, w, h, count, raster.tobytes(), position_flags(y, y + h, area[1], area[1] + area[3]), gap // t if pos and t > 0 and gap >= t else 0))
        on_lines = {int(chars["comp_id"].iloc[k]) for k in used}
        for r in page.itertuples(index=False):
            if r.comp_id not in on_lines:
                rows.append((path, None, None, r.comp_id, r.x0, r.y0, r.w, r.h, r.pixel_count, r.glyph, [0] * 5, 0))
        out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in PLACED.split(", ")])
        return out.astype({"line_id": "Int64", "pos": "Int64"})

    return comps.groupBy("path").applyInPandas(run, PLACED)


def glyph_features(glyphs: list[tuple[np.ndarray, tuple[int, ...]]], threshold: int = 170) -> np.ndarray:
    """The network's inputs of gray rasters and positions."""
    planes = [(*kernels.glyph_plane(g, 0, threshold), tuple(at)) for g, at in glyphs]
    return np.array(kernels.features48_of(planes)).reshape(-1, 48)


def recognise(comps: DataFrame, layers: network.Layers, labels: list[str], input_max: np.ndarray | None = None, split: bool = False, threshold: int = 170, least: float = 0.2) -> DataFrame:
    """``comps`` (glyph, w, h, and position where there is one) with label and prob, the network's best answer; no shuffle, weights are shared once.

    ``split``: glyphs whose best answer is under ``least`` or that may be ``connected`` are cut into parts that are told
    better; label is then what all parts say, prob their mean.
    """
    shared = comps.sparkSession.sparkContext.broadcast((layers, labels, input_max))
    placed = "position" in comps.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, names, most = shared.value

        def answers(glyphs: list) -> np.ndarray:
            return network.forward_numpy(glyph_features(glyphs, threshold) / (most if most is not None else 1), net)

        for batch in batches:
            rasters = [np.frombuffer(g, np.uint8).reshape(h, w) for g, w, h in zip(batch["glyph"], batch["w"], batch["h"], strict=True)]
            at = [tuple(p) for p in batch["position"]] if placed else [(0,) * 5] * len(rasters)
            said, probs, unsure = [], [], []
            for k, out in enumerate(answers(list(zip(rasters, at, strict=True))) if rasters else []):
                b = int(out.argmax())
                said.append(names[b])
                probs.append(float(out[b]))
                results = [names[j] for j in np.argsort(-out, kind="stable")[:4] if out[j] > 0.01]
                if split and results and (probs[k] < least or "connected" in results):
                    unsure.append(k)
            for some in (unsure[j : j + kernels.STACK] for j in range(0, len(unsure), kernels.STACK)):
                owners: list[int] = []

                def told(planes: list[np.ndarray], some: list[int] = some, owners: list[int] = owners) -> list[tuple[str, float]]:
                    asked = [(np.where(p, 0, 255).astype(np.uint8), at[some[j]]) for p, j in zip(planes, owners, strict=True)]  # noqa: B023
                    return [(names[int(o.argmax())], float(o.max())) for o in answers(asked)]

                for k, parts in zip(some, kernels.split_all([rasters[k] != 255 for k in some], told, owners=owners), strict=True):
                    if len(parts) > 1:
                        said[k], probs[k] = "".join(PLACEHOLDERS.get(x[2], x[2]) for x in parts), float(np.mean([x[3] for x in parts]))
            yield batch.drop(columns=["glyph", *(["position"] if placed else [])]).assign(label=said, prob=np.array(probs, dtype=float))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in comps.schema if f.name not in ("glyph", "position"))
    return comps.mapInPandas(run, f"{schema}, label string, prob double")


def lines_text(recognised: DataFrame) -> DataFrame:
    """path, line_id, content of recognised components on lines: their labels or placeholders, with the spaces before them."""
    label = F.col("label")
    for name, shown in PLACEHOLDERS.items():
        label = F.when(F.col("label") == name, shown).otherwise(label)
    said = recognised.where("line_id is not null").select("path", "line_id", "pos", F.concat(F.repeat(F.lit(" "), F.col("spaces").cast("int")), label).alias("s"))
    return said.groupBy("path", "line_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), "").alias("content"))


def corrected(lines: DataFrame, dictionary: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``lines`` (keys, content) with what their words are in the ``dictionary`` (w): its spelling, else its best suggestion, else the word as it is.

    Words are the runs between single spaces; each different word is looked up once. Lines are read several times, by
    jobs of their own, too, so they are kept (``persist``: a lost executor costs its own lines only) until the cache is cleared.
    """
    keys = keys or ["path", "line_id"]
    lines = lines.select(*keys, "content").persist()
    words = lines.select(*keys, F.posexplode(F.split("content", " ")).alias("k", "word"))
    asked = words.select(F.col("word").alias("w")).where("word <> ''").distinct()
    known = lexicon.members(asked, dictionary)
    better = lexicon.trie_suggestions(known.where("known is null").select(F.lower("w").alias("w")).distinct(), dictionary.select(F.lower("w").alias("w")).distinct())
    told = known.join(better.withColumnRenamed("w", "l"), F.lower("w") == F.col("l"), "left").select(F.col("w").alias("word"), F.coalesce("known", "suggestion", "w").alias("said"))
    out = words.join(told, "word", "left").groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", F.coalesce("said", F.lit("")).alias("said")))), lambda x: x["said"]).alias("said"))
    return out.select(*keys, F.array_join("said", " ").alias("content"))


def read_text(pages: DataFrame, width: int, height: int, layers: network.Layers, labels: list[str], input_max: np.ndarray | None = None, dictionary: DataFrame | None = None, threshold: int = 170, least: int = 3, split: bool = True) -> DataFrame:
    """path, line_id, content of page images: components, types, lines, positions, recognition, words."""
    comps = typed_components(spread(page_components(pages, threshold), "path"))
    placed = placed_components(comps, width, height, least)
    lines = lines_text(recognise(placed, layers, labels, input_max, split, threshold))
    return corrected(lines, dictionary) if dictionary is not None else lines


# --- learning glyphs --------------------------------------------------------------------------------------------


def training_set(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """path, label, label_id, features of glyph samples (path, width, height, raster, label).

    ``labels`` (label, label_id, position): the network's outputs. A sample's position is the one its label is expected at.
    """
    known = labels.select("label", "label_id", F.array(*[F.col(f"position.{f}").cast("int") for f in ("ascent", "height", "center", "base", "descent")]).alias("position"))
    rows = samples.select("path", "width", "height", "raster", "label").join(F.broadcast(known), "label")  # one row for each output of a network

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            glyphs = [(np.frombuffer(r, np.uint8).reshape(h, w), tuple(p)) for r, w, h, p in zip(batch["raster"], batch["width"], batch["height"], batch["position"], strict=True)]
            yield batch[["path", "label", "label_id"]].assign(features=list(glyph_features(glyphs))) if glyphs else pd.DataFrame(columns=["path", "label", "label_id", "features"])

    return rows.select("path", "label", "label_id", "width", "height", "raster", "position").mapInPandas(run, "path string, label string, label_id int, features array<double>")


def learn(examples: DataFrame, labels: int, per_label: int = 100, hidden: tuple[int, ...] = (20, 20), repetitions: int = 50, **options) -> tuple[network.Layers, np.ndarray]:
    """A network and its input maxima, from up to ``per_label`` examples of each label: they come to the driver, no others."""
    place = Window.partitionBy("label_id").orderBy(F.xxhash64("path"), "path")
    rows = examples.withColumn("k", F.row_number().over(place)).where(F.col("k") <= per_label).orderBy("label_id", "k").select("label_id", "features").collect()
    x, y = np.array([r.features for r in rows]), np.array([r.label_id for r in rows])
    most = np.maximum(1.0, x.max(0))
    return network.train(x / most, np.eye(labels)[y], hidden, repetitions, **options), most


def tested(samples: DataFrame, layers: network.Layers, labels: list[str], input_max: np.ndarray | None = None) -> DataFrame:
    """path, label, predicted, prob, right of samples; the label counts whatever its case. ``where("predicted = ...")`` is the list for a label."""
    comps = samples.select("path", F.col("label").alias("expected") if "label" in samples.columns else F.lit(None).cast("string").alias("expected"), F.col("width").cast("long").alias("w"), F.col("height").cast("long").alias("h"), F.col("raster").alias("glyph"))
    out = recognise(comps, layers, labels, input_max)
    return out.select("path", F.col("expected").alias("label"), F.col("label").alias("predicted"), "prob", (F.lower("label") == F.lower("expected")).alias("right"))
