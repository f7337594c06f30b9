"""Kernels over one glyph: numpy planes indexed [y, x], True is foreground, outside is background."""

from __future__ import annotations

from collections.abc import Callable, Generator
from functools import lru_cache

import numpy as np

SIDE = 32
#: Planes that are worked on at once, at most.
STACK = 4096

# Thinning templates as offsets (dx, dy), y down: on, off, and on the plate of fully surrounded pixels.
TEMPLATES = {
    "A": ([(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1)], [(1, 0)], []),
    "B": ([(-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0)], [(0, 1)], []),
    "C": ([(0, -1), (1, -1), (1, 0), (2, 0), (0, 1), (1, 1)], [(-1, 0)], []),
    "D": ([(-1, 0), (-1, 1), (0, 1), (0, 2), (1, 0), (1, 1)], [(0, -1)], []),
    "E": ([(-1, 0), (0, 1)], [(1, 0), (1, -1), (0, -1)], []),
    "F": ([(0, -1), (1, -1), (1, 0)], [(-1, 0), (-1, 1), (0, 1)], []),
    "G": ([(0, -1), (1, 0)], [(-1, -1), (1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1)], []),
    "H": ([(0, -1), (-1, 0)], [(1, 0), (1, 1), (0, 1)], []),
    "I": ([(0, 1), (1, 1), (1, 0)], [(-1, -1), (-1, 0), (0, -1)], []),
    "K": ([(-1, 1), (0, 1), (1, 1)], [(-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0)], []),
    "L": ([(-1, -1), (-1, 0), (-1, 1)], [(0, -1), (1, -1), (1, 0), (0, 1), (1, 1)], []),
    "M": ([(-1, -1), (0, -1), (1, -1)], [(-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)], []),
    "N": ([(1, -1), (1, 0), (1, 1)], [(-1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)], []),
    "O": ([(-1, -1), (0, -1), (0, -2), (-2, 0), (2, 0)], [(1, -1)], [(0, 1)]),
    "P": ([(-1, -1), (-2, 0), (-1, 0)], [(-1, 1)], [(1, -1), (1, 1)]),
    "Q": ([], [(-1, -1)], [(-1, 1), (1, -1), (1, 1)]),
    "R": ([(-1, -1), (0, -1), (0, -2), (1, -1), (-1, 0), (-2, 0), (1, 0), (2, 0), (-1, 1), (0, 1), (0, 2)], [(1, 1)], []),
}


def shifted(plane: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """plane[y + dy, x + dx], background outside; of a stack of planes, each plane's."""
    h, w = plane.shape[-2:]
    out = np.zeros_like(plane)
    out[..., max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = plane[..., max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


AROUND = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]


def neighbours(plane: np.ndarray) -> np.ndarray:
    return sum(shifted(plane, dx, dy).astype(np.int64) for dx, dy in AROUND)


def pixel_types(plane: np.ndarray) -> np.ndarray:
    """0 background, 1 regular, 2 end, 3 junction."""
    n = neighbours(plane)
    return np.where(plane, np.where(n == 1, 2, np.where(n >= 3, 3, 1)), 0)


def _in_columns(plane: np.ndarray) -> tuple[list[list[bool]], list[tuple[int, int]]]:
    """The plane with a border of background as lists, and its foreground (y, x) column by column."""
    p = np.pad(plane, 1)
    x, y = np.nonzero(p.T)
    return p.tolist(), list(zip(y.tolist(), x.tolist(), strict=True))


def drop_diagonal_pairs(plane: np.ndarray) -> np.ndarray:
    """Without pairs that touch by a corner alone, in either direction; column by column, later tests see earlier effects."""
    p, found = _in_columns(plane)
    for y, x in found:
        here, below = p[y], p[y + 1]
        if here[x] and not below[x]:
            for side in (1, -1):
                if here[x] and below[x + side] and not here[x + side]:
                    here[x] = below[x + side] = False
    return np.array(p, dtype=bool)[1:-1, 1:-1].copy()


def thin_condensed(plane: np.ndarray, iterations: int = 255) -> np.ndarray:
    """Thinning by templates: pixels that match any are erased together, until none does. A stack of planes is thinned plane by plane at once.

    Rows of up to 64 pixels are thinned as whole numbers, a bit a pixel, and planes that no longer change are left alone.
    """
    if not plane.size or plane.shape[-1] > 64:
        return _thin_condensed_wide(plane, iterations)
    w = plane.shape[-1]
    kind = np.uint32 if w <= 32 else np.uint64
    packed = np.packbits(plane, axis=-1, bitorder="little")
    rows = np.zeros((*packed.shape[:-1], kind().itemsize), dtype=np.uint8)
    rows[..., : packed.shape[-1]] = packed
    stack = rows.view(np.dtype(kind).newbyteorder("<")).astype(kind).reshape(-1, plane.shape[-2])
    mask = kind((1 << w) - 1)

    def moved(bits: np.ndarray, dx: int, dy: int) -> np.ndarray:
        """As ``shifted``."""
        h = bits.shape[1]
        out = np.zeros_like(bits)
        out[:, max(0, -dy) : h - max(0, dy)] = bits[:, max(0, dy) : h - max(0, -dy)]
        return out >> kind(dx) if dx >= 0 else (out << kind(-dx)) & mask

    live = np.arange(len(stack))
    for _ in range(iterations):
        own = stack[live]
        at = {o: moved(own, *o) for o in {*AROUND, *(o for on, off, _ in TEMPLATES.values() for o in [*on, *off])}}
        plate = own.copy()
        for o in AROUND:
            plate &= at[o]
        gone = np.zeros_like(own)
        for on, off, solid in TEMPLATES.values():
            hit = own.copy()
            for o in on:
                hit &= at[o]
            for o in off:
                hit &= ~at[o]
            for o in solid:
                hit &= moved(plate, *o)
            gone |= hit
        changed = gone.any(1)
        if not changed.any():
            break
        stack[live] = own & ~gone
        live = live[changed]
    out = np.ascontiguousarray(stack.astype(np.dtype(kind).newbyteorder("<"))).view(np.uint8).reshape(*plane.shape[:-1], kind().itemsize)
    return np.unpackbits(out, axis=-1, count=w, bitorder="little").astype(bool)


def _thin_condensed_wide(plane: np.ndarray, iterations: int) -> np.ndarray:
    plane = plane.copy()
    for _ in range(iterations):
        plate = plane & (neighbours(plane) == 8)
        at = {o: shifted(plane, *o) for on, off, _ in TEMPLATES.values() for o in [*on, *off]}
        gone = np.zeros_like(plane)
        for on, off, solid in TEMPLATES.values():
            hit = plane.copy()
            for o in on:
                hit &= at[o]
            for o in off:
                hit &= ~at[o]
            for o in solid:
                hit &= shifted(plate, *o)
            gone |= hit
        if not gone.any():
            break
        plane &= ~gone
    return plane


def thin_standard(plane: np.ndarray, iterations: int = 255) -> np.ndarray:
    """Two-step thinning: 2 to 6 neighbours, one change from off to on around, and one side free in each step."""
    plane = plane.copy()
    for _ in range(iterations):
        changed = False
        for step in range(2):
            ring = [shifted(plane, *o) for o in AROUND]
            count = sum(r.astype(np.int64) for r in ring)
            turns = sum((~a & b).astype(np.int64) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))
            n, e, s, w = ring[0], ring[2], ring[4], ring[6]
            free = ~(n & e & s) & ~(e & s & w) if step == 0 else ~(n & e & w) & ~(n & s & w)
            gone = plane & (count >= 2) & (count <= 6) & (turns == 1) & free
            if gone.any():
                plane &= ~gone
                changed = True
        if not changed:
            break
    return plane


def thin_eroding(plane: np.ndarray, iterations: int = 16) -> np.ndarray:
    """Erosion from four sides: a pixel with nothing before and something behind goes, unless a corner before it hangs on it alone."""
    plane = plane.copy()
    for _ in range(min(iterations, 16)):
        changed = False
        for turn in range(4):
            p = np.rot90(plane, turn)
            corner = lambda side: shifted(p, side, -1) & ~shifted(p, side, 0)  # noqa: B023, E731
            gone = p & ~shifted(p, 0, -1) & shifted(p, 0, 1) & ~corner(-1) & ~corner(1)
            changed |= bool(gone.any())
            plane = np.rot90(p & ~gone, -turn)
        if not changed:
            break
    return plane.copy()


def thin_midpoints(plane: np.ndarray) -> np.ndarray:
    """The middle pixel of each run of every row and column."""
    out = np.zeros_like(plane)
    for p, o in ((plane, out), (plane.T, out.T)):
        for line, marks in zip(p, o, strict=True):
            edge = np.diff(np.concatenate([[0], line.astype(np.int8), [0]]))
            for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                marks[(a + b - 1) // 2] = True
    return out


def drop_staircases(plane: np.ndarray) -> np.ndarray:
    """Without pixels at the inner corner of a step; column by column, later tests see earlier effects."""
    p, found = _in_columns(plane)
    for y, x in found:
        above, here, below = p[y - 1], p[y], p[y + 1]
        for v, near, far in ((-1, above, below), (1, below, above)):
            if near[x] and ((here[x - 1] and not far[x + 1]) or (here[x + 1] and not far[x - 1])):
                here[x] = False
                break
    return np.array(p, dtype=bool)[1:-1, 1:-1].copy()


def drop_spurs(plane: np.ndarray) -> np.ndarray:
    """Without pixels that on some side have nothing beside and before them, until none is left."""
    plane = plane.copy()
    sides = [[(-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0)], [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1)], [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0)], [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1)]]
    while True:
        at = {o: shifted(plane, *o) for o in AROUND}
        gone = np.zeros_like(plane)
        for side in sides:
            hit = plane.copy()
            for o in side:
                hit &= ~at[o]
            gone |= hit
        if not gone.any():
            return plane
        plane &= ~gone


def prune(gray: np.ndarray, peak: int, threshold: int, depth: int = 1) -> np.ndarray:
    """Gray plane without pale runs along edges: a run starts at a step of 1 to ``depth`` rows and lasts while it is the edge.

    Runs with a pixel as dark as a quarter of the way from ``peak`` to ``threshold`` stay.
    """
    gray = gray.copy()
    dark = peak + (threshold - peak) // 4
    if not ((gray > dark) & (gray != 255)).any():
        return gray  # nothing that may go
    for _ in range(depth):
        changed = False
        for turn in range(4):
            g = np.rot90(gray, turn).copy()
            p = np.pad(g != 255, ((1, depth + 1), (1, 1)))
            w = g.shape[1]
            at, found = 0, True  # rows before ``at`` pixels are done
            while found:
                found = False
                # a run holds no further start, so those on dark pixels need no look
                for k in (at + np.flatnonzero((_run_starts(p, depth) & (g > dark)).ravel()[at:])).tolist():
                    y, x = k // w + 1, k % w + 1
                    end = x
                    while end <= w and p[y, end] and p[y + 1, end] and not p[y - 1, end]:
                        end += 1
                    if end > x and (g[y - 1, x - 1 : end - 1] > dark).all():
                        g[y - 1, x - 1 : end - 1] = 255
                        p[y, x:end] = False
                        changed = found = True  # starts after it may be others
                        at = (y - 1) * w + end - 1
                        break
            gray = np.rot90(g, -turn).copy()
        if not changed:
            break
    return gray


def _run_starts(p: np.ndarray, depth: int) -> np.ndarray:
    """Edge pixels with a step of 1 to ``depth`` rows on their left; ``p`` has a border of one pixel, below of ``depth`` + 1."""
    h, w = p.shape[0] - depth - 2, p.shape[1] - 2
    edge = p[1 : h + 1, 1:-1] & ~p[:h, 1:-1]
    out = np.zeros((h, w), dtype=bool)
    full, beside = edge, p[:h, :w]
    for d in range(1, depth + 1):
        beside = beside | p[d : h + d, :w]
        full = full & p[d + 1 : h + d + 1, 1:-1]
        out |= full & ~beside & p[d + 1 : h + d + 1, :w]
    return out


def prune_runs(plane: np.ndarray, depth: int = 3) -> np.ndarray:
    """Plane without runs along an edge that are shorter than what they stand on is deep.

    A run starts and ends at a step of 1 to ``depth`` rows. From above and below in turn until nothing changes, then
    from the right and the left.
    """
    plane = plane.copy()

    def step(p: np.ndarray, y: int, x: int, side: int) -> bool:
        """Whether the edge pixel at (y, x) ends at a step on that side."""
        return any(not p[y - 1 : y + d, x + side].any() and p[y + d, x + side] and not p[y - 1, x] and p[y : y + d + 1, x].all() for d in range(1, depth + 1))

    def once(turn: int) -> bool:
        nonlocal plane
        own = np.rot90(plane, turn)
        h, w = own.shape
        p = np.pad(own, ((1, depth + 1), (1, 1)))
        changed = False
        for y in range(1, h + 1):
            x = 1
            while x <= w:
                if not p[y, x] or not step(p, y, x, -1):
                    x += 1
                    continue
                end = x
                while end <= w and p[y, end] and p[y + 1, end] and not p[y - 1, end]:
                    end += 1
                if end > x and step(p, y, end - 1, 1):
                    below = p[y : h + 1, x:end].all(1)
                    deep = len(below) if below.all() else int(np.argmin(below))
                    if deep > end - x:
                        p[y, x:end] = False
                        changed = True
                x = max(end, x + 1)
        plane = np.rot90(p[1 : h + 1, 1 : w + 1], -turn).copy()
        return changed

    while once(0) | once(2):
        pass
    once(3)
    once(1)
    return plane


def holes(plane: np.ndarray) -> int:
    """Background regions, connected by sides, that do not reach the border."""
    free = np.pad(~plane, 1, constant_values=True)
    count = -1  # the outside is one
    for start in zip(*np.nonzero(free), strict=True):
        if not free[start]:
            continue
        count += 1
        todo = [start]
        free[start] = False
        while todo:
            y, x = todo.pop()
            for v, u in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if 0 <= v < free.shape[0] and 0 <= u < free.shape[1] and free[v, u]:
                    free[v, u] = False
                    todo.append((v, u))
    return count


def run_variance(plane: np.ndarray) -> float:
    """Variance of the differences between the numbers of runs of successive rows."""
    runs = (np.diff(np.pad(plane, ((0, 0), (1, 0))).astype(np.int8), axis=1) == 1).sum(1)
    return float(np.abs(np.diff(runs)).var()) if len(runs) > 1 else 0.0


def shape_class(plane: np.ndarray, mean_area: float) -> str:
    """A classification by area, elongation, density and run variances: character, inverted or image."""
    h, w = plane.shape
    if h * w <= mean_area:
        return "character"
    busy = -1.09 * run_variance(plane) + 2.8 <= run_variance(plane.T)
    if min(w, h) / max(w, h) <= 0.8:
        return "image" if plane.mean() >= 0.7 or not busy else "inverted"
    return "character" if busy else "image"


def crop(plane: np.ndarray) -> np.ndarray:
    """Without empty rows and columns at the border."""
    if not plane.any():
        return plane[:0, :0]
    ys, xs = np.flatnonzero(plane.any(1)), np.flatnonzero(plane.any(0))
    return plane[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1]


def normalise(plane: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Scaled into side x side: nearest neighbour, the larger scale at most twice the smaller, centred."""
    h, w = plane.shape
    out = np.zeros((side, side), dtype=bool)
    if not h or not w:
        return out
    sx, sy = min(side / w, 2 * side / h), min(side / h, 2 * side / w)
    tw, th = int(w * sx), int(h * sy)
    xs = np.minimum((np.arange(tw) / sx).astype(int), w - 1)
    ys = np.minimum((np.arange(th) / sy).astype(int), h - 1)
    x0, y0 = (side - tw) // 2, (side - th) // 2
    out[y0 : y0 + th, x0 : x0 + tw] = plane[np.ix_(ys, xs)]
    return out


#: Directions of a stroke, clockwise from up.
DIRECTIONS = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]


#: Directions from each heading, the straightest first.
TURNS = [[(heading + t) % 8 for k in range(4) for t in ((k, -k) if k else (0,))] for heading in range(8)]


@lru_cache(maxsize=64)
def _shells(h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """x and y of a plane's pixels in growing shells from the lower left corner."""
    each = [at for k in range(max(h, w)) for at in [*((x, h - 1 - k) for x in range(k)), *((k, y) for y in range(h - 1, h - 2 - k, -1))]]
    x, y = np.array([(x, y) for x, y in each if 0 <= x < w and 0 <= y < h], dtype=np.int64).reshape(-1, 2).T
    return x, y


def strokes(plane: np.ndarray) -> tuple[np.ndarray, int]:
    """Direction codes of a skeleton's pixels, and the number of strokes of over four points.

    Codes: 16 upright, 32 rising, 48 level, 64 falling; 0 where no stroke passes. Strokes start in growing shells from
    the lower left corner and are followed as straight as they go, then the other way from the same start.
    """
    h, w = plane.shape
    free = np.pad(plane, 1).tolist()
    codes = np.zeros((h, w), dtype=np.int64)
    count = 0

    def follow(x: int, y: int, heading: int) -> list[tuple[int, int, int]]:
        points: list[tuple[int, int, int]] = []
        while True:
            for nxt in TURNS[heading]:
                if free[y + 1 + DIRECTIONS[nxt][1]][x + 1 + DIRECTIONS[nxt][0]]:
                    break
            else:
                return points
            free[y + 1][x + 1] = False
            if not points:
                points.append((x, y, nxt))
            x, y, heading = x + DIRECTIONS[nxt][0], y + DIRECTIONS[nxt][1], nxt
            points.append((x, y, nxt))

    xs, ys = _shells(h, w)
    for k in np.flatnonzero(plane[ys, xs]).tolist():
        x, y = int(xs[k]), int(ys[k])
        if free[y + 1][x + 1]:
            first = follow(x, y, 0)
            whole = first + (follow(x, y, (first[0][2] + 4) % 8) if first else [])
            for px, py, d in whole:
                free[py + 1][px + 1] = False
                codes[py, px] = 16 + 16 * (d & 3)
            count += len(whole) > 4
    return codes, count


def glyph_plane(gray: np.ndarray, peak: int = 0, threshold: int = 170) -> tuple[np.ndarray, int, int]:
    """The 32 x 32 plane of a glyph's gray raster (255 is background), and its width and height.

    A glyph smaller than the plane is pruned by one row as it is, and cropped; the scaled one is pruned by up to three.
    Black pixels on white keep all, for pruning erases pale edges only.
    """
    h, w = gray.shape
    if w < SIDE and h < SIDE:
        pruned = prune(gray, peak, threshold, 1)
        ys, xs = np.flatnonzero((pruned != 255).any(1)), np.flatnonzero((pruned != 255).any(0))
        if len(ys):
            gray = pruned[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1]
    h, w = gray.shape
    out = np.full((SIDE, SIDE), 255, dtype=gray.dtype)
    scaled = normalise(gray != 255)
    sx, sy = min(SIDE / w, 2 * SIDE / h), min(SIDE / h, 2 * SIDE / w)
    tw, th = int(w * sx), int(h * sy)
    xs, ys = np.minimum((np.arange(tw) / sx).astype(int), w - 1), np.minimum((np.arange(th) / sy).astype(int), h - 1)
    x0, y0 = (SIDE - tw) // 2, (SIDE - th) // 2
    out[y0 : y0 + th, x0 : x0 + tw] = gray[np.ix_(ys, xs)]
    return scaled & (prune(out, peak, threshold, 3) != 255), w, h


def features48(plane: np.ndarray, width: int, height: int, position: tuple[int, ...] = (0, 0, 0, 0, 0)) -> np.ndarray:
    """The network's 48 inputs of a normalised glyph of ``width`` x ``height``.

    8 column and 8 row sums of stroke codes, 4 and 4 counts of diagonal codes by quadrant, 9 and 9 flags of ends and
    junctions by ninth, the ratio of width to height, and 5 flags of the position on the line.
    """
    return features48_of([(plane, width, height, position)])[0]


def features48_of(glyphs: list[tuple[np.ndarray, int, int, tuple[int, ...]]]) -> list[np.ndarray]:
    """The same for many (plane, width, height, position); their planes are thinned as one stack."""
    out: list[np.ndarray] = []
    for k in range(0, len(glyphs), STACK):
        own = glyphs[k : k + STACK]
        out += _features(skeletons([g[0] for g in own]), own)
    return out


def skeletons(planes: list[np.ndarray]) -> list[np.ndarray]:
    """Skeletons of planes of one size."""
    if not planes:
        return []
    return [drop_staircases(p) for p in thin_condensed(np.stack([drop_diagonal_pairs(p) for p in planes]))]


def _features(skeletons: list[np.ndarray], glyphs: list[tuple[np.ndarray, int, int, tuple[int, ...]]]) -> list[np.ndarray]:
    n = len(glyphs)
    codes = np.stack([strokes(s)[0] for s in skeletons])
    types = pixel_types(np.stack(skeletons))
    columns = 16 * (codes == 16).sum(1).reshape(n, 8, -1).sum(2)
    rows = 48 * (codes == 48).sum(2).reshape(n, 8, -1).sum(2)
    quarter = lambda hit: hit.reshape(n, 2, 16, 2, 16).sum((2, 4)).reshape(n, 4)
    thirds = [0, 11, 22]
    ninths = [np.logical_or.reduceat(np.logical_or.reduceat(types == kind, thirds, axis=1), thirds, axis=2).reshape(n, 9) for kind in (2, 3)]
    ratio = [[width / max(1, height)] for _, width, height, _ in glyphs]
    return list(np.concatenate([columns, rows, quarter(codes == 64), quarter(codes == 32), *ninths, ratio, [g[3] for g in glyphs]], axis=1).astype(float))


def cuts(plane: np.ndarray) -> list[int]:
    """Columns at which touching glyphs may part, from the profile of background above and below each column.

    From right to left, a cut is where the depth from one side, having risen, falls again. Cuts nearer than 3 are
    merged into their mean.
    """
    h, w = plane.shape
    filled = plane.any(0)
    top = np.where(filled, plane.argmax(0), h)
    bottom = np.where(filled, plane[::-1].argmax(0), h)
    found: list[int] = []
    rising, last = [False, False], [top[w - 1], bottom[w - 1]] if w else []
    for x in range(w - 1, -1, -1):
        for k, depth in enumerate((top[x], bottom[x])):
            if rising[k] and depth < last[k]:
                found.insert(0, x + 1)
                rising[k] = False
            elif depth > last[k]:
                rising[k] = True
            last[k] = depth
    return merge_cuts(found)


def merge_cuts(found: list[int], apart: int = 3) -> list[int]:
    out = list(found)
    for k in range(len(out) - 1, 0, -1):
        if out[k] - out[k - 1] < apart:
            out[k - 1] = (out[k - 1] + out.pop(k)) // 2
    return out


def split(plane: np.ndarray, classify: Callable[[list[np.ndarray]], list[tuple[str, float]]], rejected: tuple[str, ...] = ("connected", "garbage"), ahead: int = 6) -> list[tuple[int, int, str, float]]:
    """Parts (from, to, label, probability) of touching glyphs: each part grows while a longer slice is told better.

    ``classify`` tells slices of a part, ``ahead`` of them at a time, the longer ones only once they are asked for.
    """
    return split_all([plane], classify, rejected, ahead)[0]


def split_all(planes: list[np.ndarray], classify: Callable[[list[np.ndarray]], list[tuple[str, float]]], rejected: tuple[str, ...] = ("connected", "garbage"), ahead: int = 6, owners: list[int] | None = None) -> list[list[tuple[int, int, str, float]]]:
    """``split`` of many planes: what all of them ask for next is told at once. ``owners`` holds the numbers of the planes that the slices to tell are of."""
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in planes]
    waiting = [(k, steps, next(steps, None)) for k, steps in enumerate(_splitting(p, rejected, ahead, out[k]) for k, p in enumerate(planes))]
    while waiting := [x for x in waiting if x[2] is not None]:
        if owners is not None:
            owners[:] = [k for k, _, pieces in waiting for _ in pieces]
        told = iter(classify([piece for _, _, pieces in waiting for piece in pieces]))
        waiting = [(k, steps, _next(steps, [next(told) for _ in pieces])) for k, steps, pieces in waiting]
    return out


def _next(steps: Generator, told: list[tuple[str, float]]) -> list[np.ndarray] | None:
    try:
        return steps.send(told)
    except StopIteration:
        return None


def _splitting(plane: np.ndarray, rejected: tuple[str, ...], ahead: int, parts: list[tuple[int, int, str, float]]) -> Generator[list[np.ndarray], list[tuple[str, float]], None]:
    """Asks for the slices that it needs told, and adds to ``parts``."""
    h, w = plane.shape
    edges = sorted({0, *(c for c in cuts(plane) if 0 < c < w), w})
    start = 0
    while start < len(edges) - 1:
        best, grows = None, True
        for first in range(start + 1, len(edges), ahead):
            ends = range(first, min(first + ahead, len(edges)))
            pieces = {end: piece for end in ends if (piece := crop(plane[:, edges[start] : edges[end]])).size}
            told = (yield list(pieces.values())) if pieces else []
            for end, (label, p) in zip(pieces, told, strict=True):
                grows = best is None or (p > best[3] and label not in rejected)
                if not grows:
                    break
                best = (edges[start], edges[end], label, p)
            if not grows:
                break
        if best is None:
            break
        parts.append(best)
        start = edges.index(best[1])


def skew(plane: np.ndarray, most: float = 5.0, step: float = 0.25) -> float:
    """Degrees by which rows are turned, found by the sharpest row profile; an approximation by projection."""
    ys, xs = np.nonzero(plane)
    if len(ys) < 2:
        return 0.0
    best, angle = -1.0, 0.0
    for a in np.arange(-most, most + step / 2, step):
        rows = np.round(ys - xs * np.tan(np.radians(a))).astype(int)
        score = float((np.bincount(rows - rows.min()).astype(float) ** 2).sum())
        if score > best + 1e-9 or (abs(score - best) <= 1e-9 and abs(a) < abs(angle)):
            best, angle = score, float(a)
    return angle


def deskew(gray: np.ndarray, degrees: float, least: float = 2.0) -> np.ndarray:
    """Turned back about the centre where the skew is over ``least``; white beyond the border."""
    if abs(degrees) <= least:
        return gray
    h, w = gray.shape
    t = np.radians(degrees)
    y, x = np.mgrid[:h, :w]
    cx, cy = (w - 1) / 2, (h - 1) / 2
    sx = np.round(np.cos(t) * (x - cx) - np.sin(t) * (y - cy) + cx).astype(int)
    sy = np.round(np.sin(t) * (x - cx) + np.cos(t) * (y - cy) + cy).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full_like(gray, 255)
    out[inside] = gray[sy[inside], sx[inside]]
    return out


def line_distance(px: int, py: int, angle: float, x: int, y: int) -> int:
    """Whole distance of (x, y) from the line through (px, py) that falls 1000 sin(angle) on 1000."""
    fall = int(1000 * np.sin(angle))
    return int(abs((x - px) * fall - 1000 * (y - py)) / np.sqrt(1_000_000 + fall * fall))


def line_cost(px: int, py: int, angle: float, points: list[tuple[int, int]], quirk: bool = False) -> int:
    """Sum of the squared distances of points from a line; ``quirk``: of the distances XOR 2."""
    each = [line_distance(px, py, angle, x, y) for x, y in points]
    return sum(d ^ 2 if quirk else d * d for d in each)


def fit_angle(px: int, py: int, angle: float, points: list[tuple[int, int]], quirk: bool = False, most: int = 90) -> float:
    """The angle with the least cost, looked for from ``angle`` on one degree farther either way in each step, until a step finds none as good."""
    best, cost, step = angle, line_cost(px, py, angle, points, quirk), 1
    while step <= most:
        found = False
        for side in (1, -1):
            turned = angle + side * step * np.pi / 180
            if (c := line_cost(px, py, turned, points, quirk)) <= cost:
                best, cost, found = turned, c, True
        if not found:
            break
        step += 1
    return float(best)


def fit_height(px: int, py: int, angle: float, points: list[tuple[int, int]], quirk: bool = False, most: int = 10_000) -> int:
    """The height of the line with the least cost, looked for a row farther up and down in each step. ``quirk``: costs are those of the first height, which therefore stays."""
    best, cost, step = py, line_cost(px, py, angle, points, quirk), 1
    while step <= most:
        found = False
        for y in (py + step, py - step):
            if (c := line_cost(px, py if quirk else y, angle, points, quirk)) < cost:
                best, cost, found = y, c, True
        if not found:
            break
        step += 1
    return best
