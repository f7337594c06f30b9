"""Small cases worked out by hand, and properties of the kernels."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays
from pyspark.sql import functions as F

from glyphmill.functions import geometry
from glyphmill.operators import components, kernels, layout, lexicon, network, pages, raster


def plane(*lines):
    return np.array([[c == "#" for c in line] for line in lines])


planes = arrays(bool, st.tuples(st.integers(1, 14), st.integers(1, 14)))


def test_binarise_and_peaks(spark):
    px = spark.createDataFrame([(1, 0, 0, 170), (1, 1, 0, 171)], "page_id long, x long, y long, gray int")
    assert [r.bit for r in raster.binarise(px).orderBy("x").collect()] == [0, 255]
    levels = [10] * 5 + [20] * 5 + [200] * 7 + [255] * 100
    px = spark.createDataFrame([(1, k, 0, g) for k, g in enumerate(levels)], "page_id long, x long, y long, gray int")
    assert raster.peaks(px).first()[1:] == (10, 200)


def test_grid(spark):
    b = spark.createDataFrame([(1, k, 595, 695, 10, 10) for k in range(100)], "page_id long, comp_id long, x0 int, y0 int, w int, h int")
    assert {r.cell_id for r in layout.grid(b, 1000, 2000).collect()} == {4}


def test_geometry(spark):
    cases = [((0, 0, 10, 10), (20, 0, 10, 10), 10, 0.0), ((0, 0, 10, 10), (20, 20, 10, 10), None, 45.0), ((0, 0, 10, 10), (2, 20, 10, 10), None, 90.0)]
    for a, b, gap, angle in cases:
        row = spark.range(1).select(geometry.box_gap(*map(F.lit, a), *map(F.lit, b)).alias("g"), geometry.box_angle(*map(F.lit, a), *map(F.lit, b)).alias("a")).first()
        assert gap is None or row.g == gap == pages._gap(a, b)
        assert row.a == pytest.approx(angle) == pytest.approx(pages._angle(a, b))
        assert row.g == pages._gap(a, b)


@pytest.mark.parametrize(("w", "h", "size", "at"), [(8, 4, (32, 32), (0, 0)), (16, 4, (32, 16), (0, 8)), (3, 30, (6, 32), (13, 0))])
def test_normalise(w, h, size, at):
    out = kernels.normalise(np.ones((h, w), bool))
    ys, xs = np.nonzero(out)
    assert (xs.max() - xs.min() + 1, ys.max() - ys.min() + 1) == size
    assert (xs.min(), ys.min()) == at


def test_normalise_in_sql_equals_kernel(spark):
    rng = np.random.default_rng(4)
    for h, w in ((5, 9), (40, 7), (33, 33), (3, 50)):
        p = rng.random((h, w)) < 0.5
        p[0, :] = p[-1, :] = p[:, 0] = p[:, -1] = True
        y, x = np.nonzero(p)
        df = spark.createDataFrame(pd.DataFrame({"k": 1, "x": x, "y": y}))
        got = raster.normalise32(df, ["k"]).toPandas()
        out = np.zeros((32, 32), bool)
        out[got["y"], got["x"]] = True
        assert (out == kernels.normalise(p)).mean() > 0.99


def test_pixel_types():
    assert kernels.pixel_types(plane("###")).tolist() == [[2, 1, 2]]
    plus = plane("..#..", "..#..", "#####", "..#..", "..#..")
    inner = plane(".#.", "###", ".#.")
    assert set(kernels.pixel_types(inner)[inner].tolist()) == {3}
    assert kernels.pixel_types(plus)[0, 2] == 2


@settings(max_examples=60, deadline=None)
@given(planes)
def test_thinning_keeps_within(p):
    for f in (kernels.thin_condensed, kernels.thin_standard, kernels.thin_eroding, kernels.thin_midpoints, kernels.drop_staircases, kernels.drop_diagonal_pairs):
        assert not (f(p) & ~p).any()
    once = kernels.thin_condensed(p)
    assert (kernels.thin_condensed(once) == once).all()


def test_thin_bar():
    bar = np.zeros((20, 30), bool)
    bar[5:12, 3:27] = True
    for f in (kernels.thin_condensed, kernels.thin_standard):
        thin = f(bar)
        assert 0 < thin.sum() < bar.sum() / 4


def test_strokes_of_a_line():
    line = np.zeros((32, 32), bool)
    line[4:28, 10] = True
    codes, n = kernels.strokes(line)
    assert n == 1
    assert set(codes[codes > 0].tolist()) == {16}
    level = np.zeros((32, 32), bool)
    level[20, 3:30] = True
    codes, n = kernels.strokes(level)
    assert n == 1 and set(codes[codes > 0].tolist()) == {48}


@settings(max_examples=40, deadline=None)
@given(arrays(bool, (32, 32)))
def test_features_layout(p):
    f = kernels.features48(p, 10, 20, (1, 0, 0, 0, 1))
    assert f.shape == (48,)
    assert f[42] == 0.5 and f[43:].tolist() == [1, 0, 0, 0, 1]
    assert set(f[24:42].tolist()) <= {0.0, 1.0}


def test_cuts_and_split():
    assert kernels.merge_cuts([5, 7, 20]) == [6, 20]
    two = np.zeros((10, 20), bool)
    two[0:10, 2:6] = two[0:10, 13:17] = True
    two[9, 2:17] = True

    def classify(planes):
        return [("I", 0.9) if p.shape[1] < 9 else ("connected", 0.3) for p in planes]

    parts = kernels.split(two, classify)
    assert parts == kernels.split(two, classify, ahead=1)
    assert parts and parts[0][0] == 0 and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))


def test_prune_gray():
    g = np.full((12, 12), 255)
    g[5:8, 2:10] = 0
    g[4, 4:7] = 160  # a pale run on the edge
    out = kernels.prune(g, peak=0, threshold=170, depth=1)
    assert (out[4] == 255).all() and (out[5:8, 2:10] == 0).all()
    assert (kernels.prune(np.where(g < 255, 0, 255), 0, 170) == np.where(g < 255, 0, 255)).all()


def test_skew():
    page = np.zeros((200, 300), bool)
    for y in range(20, 190, 20):
        for x in range(10, 290):
            page[int(y + x * np.tan(np.radians(3)) - 8), x] = True
    assert abs(kernels.skew(page) - 3) <= 0.5
    gray = np.where(page, 0, 255)
    assert abs(kernels.skew(kernels.deskew(gray, 3.0) <= 170)) <= 0.75


@settings(max_examples=60, deadline=None)
@given(planes)
def test_labels_partition_the_pixels(p):
    y, x = np.nonzero(p)
    if not len(x):
        return
    label = components.label_pixels(x, y)
    at = {(int(a), int(b)): int(label[k]) for k, (a, b) in enumerate(zip(x, y, strict=True))}
    for (a, b), own in at.items():
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                assert at.get((a + dx, b + dy), own) == own
    seen = set()
    todo = [next(iter(at))]
    while todo:
        q = todo.pop()
        if q in seen:
            continue
        seen.add(q)
        todo += [(q[0] + dx, q[1] + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (q[0] + dx, q[1] + dy) in at]
    assert sum(v == at[next(iter(at))] for v in at.values()) == len(seen)


def test_huge_page_labels_equal(spark, tmp_path):
    rng = np.random.default_rng(2)
    y, x = np.nonzero(rng.random((30, 30)) < 0.35)
    dark = spark.createDataFrame(pd.DataFrame({"page_id": 1, "x": x, "y": y}))
    a = components.connected_components(dark).orderBy("y", "x").collect()
    b = components.connected_components_of_huge_pages(dark, str(tmp_path)).orderBy("y", "x").select("page_id", "x", "y", "comp_id").collect()
    assert a == b


@pytest.mark.parametrize(("a", "b", "d"), [("CA", "ABC", 3), ("ab", "ba", 1), ("", "abc", 3), ("kitten", "sitting", 3)])
def test_osa(a, b, d):
    assert lexicon.osa_distance(a, b) == d


def test_trie_suggestions():
    trie = lexicon.Trie(["cat", "car", "cart"])
    assert trie.suggest("cbt") == (1, ["cat"])
    assert trie.suggest("caat") == (1, ["cart", "cat"])
    assert trie.suggest("caat", delete=False) == (1, ["cart"])
    assert lexicon.Trie(["sold"]).suggest("5old")[0] == 0


@pytest.mark.parametrize(("words", "trie", "dawg"), [(["cat", "bat"], 9, 6), (["tap", "top"], 8, 6)])
def test_dictionary_sizes(spark, words, trie, dawg):
    lex = spark.createDataFrame([(w,) for w in words], "w string")
    assert lexicon.trie_size(lex).first().nodes == trie
    assert lexicon.dawg_size(lex).first().nodes == dawg


def test_network(spark):
    layers = [(np.array([[0.5, -0.25]]), np.array([0.1])), (np.array([[1.0]]), np.array([0.0]))]
    assert network.forward_numpy(np.array([[1.0, 1.0]]), layers)[0, 0] == pytest.approx(0.631214, abs=1e-6)
    df = spark.createDataFrame([([1.0, 1.0],)], "f array<double>")
    assert df.select(network.forward(F.col("f"), layers)[0]).first()[0] == pytest.approx(0.631214, abs=1e-6)
    net = network.synthetic()
    x = np.random.default_rng(1).normal(size=(20, 48))
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "k int, f array<double>")
    a = np.array([r.o for r in df.select("k", network.forward(F.col("f"), net).alias("o")).orderBy("k").collect()])
    b = np.array([r.o for r in df.select("k", network.forward_udf(net)("f").alias("o")).orderBy("k").collect()])
    assert np.allclose(a, b, atol=1e-9) and np.allclose(a, network.forward_numpy(x, net), atol=1e-9)


def test_ranked_results(spark):
    df = spark.createDataFrame([(1, [0.5, 0.4, 0.3, 0.2, 0.6, 0.1])], "k int, outputs array<double>")
    assert [r.prob for r in network.ranked(df, "k").orderBy("rank").collect()] == [0.6, 0.5, 0.4, 0.3]
    assert [s.prob for s in df.select(network.ranked_as_inserted(F.col("outputs")).alias("r")).first().r] == [0.6, 0.5, 0.4, 0.3, 0.2]
    res = spark.createDataFrame([(1, 0, 0.19), (2, 0, 0.9), (2, 9, 0.05), (3, 1, 0.9)], "k int, label int, prob double")
    assert {r.k: r.connected for r in network.could_be_connected(res, "k", 9).collect()} == {1: True, 2: True, 3: False}


def test_training_learns():
    rng = np.random.default_rng(0)
    x = rng.random((60, 4))
    y = np.eye(2)[(x[:, 0] > 0.5).astype(int)]
    net = network.train(x, y, hidden=(6,), repetitions=150)
    assert (network.forward_numpy(x, net).argmax(1) == y.argmax(1)).mean() > 0.9
    more = network.train(x, y, hidden=(6,), repetitions=1, layers=net)
    assert not np.array_equal(more[0][0], net[0][0]) and np.abs(more[0][0] - net[0][0]).max() < 1


def test_words_and_spaces(spark):
    chars = spark.createDataFrame([(1, 0, k, c) for k, c in enumerate("ab  cd")], "conv_id long, turn long, pos long, ch string")
    assert [r.word for r in layout.word_islands(chars).orderBy("word_no").collect()] == ["ab", "cd"]
    members = spark.createDataFrame([(1, 1, 1, 0, 0, 10, 10), (1, 1, 2, 23, 0, 10, 10), (1, 1, 3, 38, 0, 10, 10)], "page_id long, line_id long, comp_id long, x0 int, y0 int, w int, h int")
    assert [(r.comp_id, r.n_spaces) for r in layout.spaces(members).collect()] == [(2, 2)]
    m = layout.line_metrics(spark.createDataFrame([(1, 1, 1, 0, 100, 10, 50)], "page_id long, line_id long, comp_id long, x0 int, y0 int, w int, h int"))
    assert layout.line_thresholds(m).first()[2:] == (105, 145, 125)
    assert layout.line_thresholds(m, quirk=True).first()[4] == 50


def test_line_growth_takes_each_box_once():
    rng = np.random.default_rng(3)
    boxes = [(int(x), int(20 * r + rng.integers(0, 3)), 8, 12) for r in range(5) for x in range(0, 300, 12)]
    lines = pages.grow(boxes, (100, 60))
    assert sorted(k for line in lines for k in line) == list(range(len(boxes)))
    assert max(map(len, lines)) >= 20
    cleaned, _ = pages.clean(boxes, lines)
    assert all(len(x) >= 3 for x in cleaned)


def test_orphans_and_line_merges():
    line = [(x, 10, 8, 12) for x in range(0, 120, 12)]
    dot = [(25, 4, 3, 3)]  # above the third box
    boxes = line + dot
    cleaned, merged = pages.clean(boxes, [list(range(10)), [10]], 3)
    assert len(cleaned) == 1
    apart, _ = pages.clean(line + [(0, 200, 8, 12)], [list(range(10)), [10]], 3)
    assert len(apart) == 1 and len(apart[0]) == 10
    assert pages.base_and_descent([100] * 8 + [106] * 3) == (100, 106)


def test_holes_and_shapes():
    ring = plane("####", "#..#", "####")
    assert kernels.holes(ring) == 1 and kernels.holes(plane("##", "##")) == 0 and kernels.holes(plane("###", "#.#", "###", "#.#", "###")) == 2
    assert kernels.shape_class(ring, 100) == "character"
    assert kernels.shape_class(np.ones((4, 40), bool), 10) == "image"


def test_prune_runs():
    block = np.zeros((14, 14), bool)
    block[4:12, 2:12] = True
    bump = block.copy()
    bump[3, 6:8] = True
    assert (kernels.prune_runs(bump) == block).all()
    assert (kernels.prune_runs(block) == block).all()


def test_gaps_are_counted_without_steps(spark):
    rng = np.random.default_rng(12)
    at = rng.integers(0, 60, (300, 4)), rng.integers(0, 24, (300, 4))
    rows = [tuple(int(v) for v in (a, b, w, h, c, d, u, v)) for (a, b, c, d), (w, h, u, v) in zip(*at, strict=True)]
    names = [f"{p}{c}" for p in "ab" for c in "xywh"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))

    def inside(x, y, w, h, dx, dy):
        longer = max(abs(dx), abs(dy))
        sx, sy = (float(np.sign(dx)), dy / longer) if abs(dx) >= abs(dy) else (dx / longer, float(np.sign(dy)))
        cx, cy = x + w // 2, y + h // 2
        return sum(x <= cx + int(k * sx) < x + w and y <= cy + int(k * sy) < y + h for k in range(max(w, h) + 1))

    def gap(ax, ay, aw, ah, bx, by, bw, bh):
        dx, dy = bx + bw // 2 - ax - aw // 2, by + bh // 2 - ay - ah // 2
        return int((dx * dx + dy * dy) ** 0.5) + 1 - inside(ax, ay, aw, ah, dx, dy) - inside(bx, by, bw, bh, -dx, -dy) if dx or dy else 0

    staged = geometry.with_box_gap(df.withColumn("g", geometry.box_gap(*map(F.col, names))), "gap", *names)
    got = staged.collect()
    assert [(r.g, r.gap) for r in got] == [(gap(*r),) * 2 for r in rows]
    assert "lambda" not in staged._jdf.queryExecution().executedPlan().toString()


def test_lines_grow_as_by_looking_at_every_box():
    def plain(boxes, cell):
        where = [((b[0] + b[2] // 2) // cell[0], (b[1] + b[3] // 2) // cell[1]) for b in boxes]
        free, out = sorted(range(len(boxes)), key=lambda k: (where[k][1], where[k][0], k)), []

        def nearest(line, side):
            e, own = line[-1 if side > 0 else 0], [boxes[k] for k in line]
            top, bottom, most = min(b[1] for b in own), max(b[1] + b[3] for b in own), min(2000, int(1.5 * sum(b[3] for b in own) / len(own)))
            each = []
            for k in free:
                b, (dc, dr) = boxes[k], (where[k][0] - where[e][0], where[k][1] - where[e][1])
                if dc in (0, side) and abs(dr) < 2 and side * (b[0] - boxes[e][0]) > 0 and (pages._angle(boxes[e], b) < 5 or (b[1] < bottom and top < b[1] + b[3])):
                    each.append((pages._gap(boxes[e], b), side * dc, dr, k))
            return min((x for x in each if x[0] < most), default=(None,))[-1]

        while free:
            line = [free.pop(0)]
            grown = True
            while grown:
                grown = False
                for side in (1, -1):
                    if (k := nearest(line, side)) is not None:
                        free.remove(k)
                        line.insert(len(line) if side > 0 else 0, k)
                        grown = True
            out.append(line)
        return out

    rng = np.random.default_rng(3)
    for _ in range(25):
        boxes = [tuple(int(v) for v in (*rng.integers(0, 200, 2), *rng.integers(1, 25, 2))) for _ in range(60)]
        cell = tuple(int(v) for v in rng.integers(5, 60, 2))
        assert pages.grow(boxes, cell) == plain(boxes, cell)
        a, b = np.array(boxes[:30]).T, np.array(boxes[30:]).T
        assert pages._gaps(a, b).tolist() == [pages._gap(p, q) for p, q in zip(boxes[:30], boxes[30:], strict=True)]
    far = 10**12  # no step is taken
    assert pages._gap((0, 0, far, far), (3 * far, 0, far, far)) == 2 * far
