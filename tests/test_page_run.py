"""Pages from pixels to corrected words, and the learning of glyphs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import components, glyphs, kernels, layout, lexicon, network, pages
from glyphmill.sources import images, models

#: Letters of 12 x 12 pixels, a few strokes each.
LETTERS = {
    "o": [(2, 2, 10, 4), (2, 8, 10, 10), (2, 2, 4, 10), (8, 2, 10, 10)],
    "l": [(4, 0, 7, 12)],
    "t": [(0, 0, 12, 3), (5, 0, 8, 12)],
    "c": [(2, 2, 10, 4), (2, 8, 10, 10), (2, 2, 4, 10)],
    "a": [(2, 2, 10, 4), (2, 6, 10, 8), (8, 2, 10, 12), (2, 6, 4, 12), (2, 10, 10, 12)],
}


def letter(name, rng=None):
    plane = np.full((12, 12), 255, np.uint8)
    for x0, y0, x1, y1 in LETTERS[name]:
        if rng is not None:
            x1 = min(12, x1 + int(rng.integers(0, 2)))
        plane[y0:y1, x0:x1] = 0
    ys, xs = np.flatnonzero((plane < 255).any(1)), np.flatnonzero((plane < 255).any(0))
    return plane[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1]


def page_of(lines):
    """A page of 400 x 200 with these lines of words, letters 2 apart, words 10."""
    gray = np.full((200, 400), 255, np.uint8)
    for row, line in enumerate(lines):
        x = 10
        for ch in line:
            if ch == " ":
                x += 8
                continue
            g = letter(ch)
            y = 20 + 50 * row + 12 - g.shape[0]
            gray[y : y + g.shape[0], x : x + g.shape[1]] = g
            x += g.shape[1] + 2
    return gray


@pytest.fixture(scope="module")
def learned(spark):
    rng = np.random.default_rng(2)
    samples = []
    for k, name in enumerate(sorted(LETTERS) * 12):
        g = letter(name, rng if k >= 5 else None)
        samples.append((f"{name}/{k:08d}.bmp", g.shape[1], g.shape[0], g.tobytes(), name))
    df = spark.createDataFrame([(p, w, h, bytearray(r), n) for p, w, h, r, n in samples], "path string, width int, height int, raster binary, label string")
    names = sorted(LETTERS)
    spot = {"ascent": False, "height": False, "center": False, "base": False, "descent": False}
    labels = spark.createDataFrame([(n, k, spot) for k, n in enumerate(names)], "label string, label_id int, position struct<ascent: boolean, height: boolean, center: boolean, base: boolean, descent: boolean>")
    examples = pages.training_set(df, labels)
    layers, most = pages.learn(examples, len(names), repetitions=60)
    return df, examples, names, layers, most


def test_training_set_and_batch_test(learned):
    df, examples, names, layers, most = learned
    rows = examples.collect()
    assert len(rows) == df.count() and all(len(r.features) == 48 and r.features[43:] == [0.0] * 5 for r in rows)
    assert (most >= 1).all() and len(most) == 48
    out = pages.tested(df, layers, names, most).collect()
    assert np.mean([r.right for r in out]) > 0.9
    assert all((r.label == r.predicted) == r.right for r in out)


def test_page_to_words(spark, learned):
    _, _, names, layers, most = learned
    page = page_of(["cat ool", "toc lato", "coat"])
    df = spark.createDataFrame([("p1", 400, 200, bytearray(page.tobytes()))], images.PAGE)
    comps = pages.typed_components(pages.page_components(df))
    assert comps.count() == 17 and {r.type for r in comps.select("type").distinct().collect()} == {"character"}
    placed = pages.placed_components(comps, 400, 200)
    rows = sorted((r.line_id, r.pos, r.x0, r.spaces, sum(r.position)) for r in placed.collect())
    assert [r[0] for r in rows] == [0] * 6 + [1] * 7 + [2] * 4 and all(1 <= r[4] <= 2 for r in rows)
    assert [r[1] for r in rows if r[3]] == [3, 3]
    plain = placed.drop("position")  # learned without positions
    said = pages.lines_text(pages.recognise(plain, layers, names, most)).orderBy("line_id").collect()
    got = [" ".join(r.content.split()) for r in said]
    assert [len(g) for g in got] == [7, 8, 4]
    dictionary = spark.createDataFrame([(w,) for w in ("cat", "tool", "toc", "Lato", "coat")], "w string")
    fixed = pages.corrected(spark.createDataFrame([("p", 0, "cat ool  lato"), ("p", 1, ""), ("p", 2, "coax zzzzzzz")], "path string, line_id long, content string"), dictionary).orderBy("line_id").collect()
    assert [r.content for r in fixed] == ["cat tool  Lato", "", "coat zzzzzzz"]
    whole = pages.read_text(df, 400, 200, layers, names, most, dictionary).orderBy("line_id").collect()
    assert len(whole) == 3


def test_parts_of_a_glyph_are_united(spark):
    gray = np.full((60, 200), 255, np.uint8)
    for x in range(10, 190, 20):
        gray[20:36, x : x + 8] = 30
    gray[10:16, 50:58] = 90  # above the third box
    df = spark.createDataFrame([("p", 200, 60, bytearray(gray.tobytes()))], images.PAGE)
    placed = pages.placed_components(pages.page_components(df).withColumn("type", F.lit("character")), 200, 60).collect()
    on = [r for r in placed if r.line_id is not None]
    tall = [r for r in on if r.h > 16]
    assert len(tall) <= 1 and sum(r.pixel_count for r in placed) == 9 * 128 + 48
    for r in tall:
        raster = np.frombuffer(r.glyph, np.uint8).reshape(r.h, r.w)
        assert (raster != 255).sum() == r.pixel_count == 176 and set(np.unique(raster)) == {30, 90, 255}


def test_split_of_touching_glyphs(spark):
    net = [(np.zeros((2, 48)), np.zeros(2))]
    net[0][0][0, 42], net[0][0][1, 42] = -9.0, 9.0  # told by the ratio of width and height alone
    net[0][1][:] = [-6.0, 6.0]
    two = np.full((12, 22), 255, np.uint8)
    two[0:12, 0:6] = two[0:12, 16:22] = 0
    two[11, :] = 0
    df = spark.createDataFrame([(1, 22, 12, bytearray(two.tobytes()))], "comp_id long, w long, h long, glyph binary")
    whole, parts = (pages.recognise(df, net, ["I", "connected"], split=s).first() for s in (False, True))
    assert whole.label == "connected"
    assert parts.label != "connected" and parts.prob >= 0


def test_wide_pages_and_huge_ones(spark, tmp_path):
    rng = np.random.default_rng(6)
    y, x = np.nonzero(rng.random((12, 2480)) < 0.4)
    dark = spark.createDataFrame(pd.DataFrame({"page_id": 1, "x": x, "y": y})).union(spark.createDataFrame([(2, 1500, 0), (2, 500, 1)], "page_id long, x long, y long"))
    a = components.connected_components(dark)
    b = components.connected_components_of_huge_pages(dark, str(tmp_path))
    key = lambda d: sorted(tuple(r) for r in d.select("page_id", "x", "y", "comp_id").collect())
    assert key(a) == key(b)
    assert a.where("page_id = 2").select("comp_id").distinct().count() == 2
    with pytest.raises(RuntimeError):
        components.connected_components_of_huge_pages(dark, str(tmp_path / "few"), most_rounds=1)
    with pytest.raises(Exception, match="wider"):
        components.connected_components(dark, 1000).collect()


def test_nets_as_xml(spark, tmp_path):
    (tmp_path / "nets.xml").write_text(
        """<?xml version="1.0"?><ShapeNeuralNetworkCollection><ShapeNets>
        <ShapeNet Name="one" lNumberExamples="5" bSearchFolders="true"><ShapeList/><NeuralNetwork><Nodes/></NeuralNetwork></ShapeNet>
        <ShapeNet Name="two" lNumberExamples="9" bSearchFolders="false"><ShapeList>
          <ShapeListEntry Shape="a" SampleFolder="s/a"><Position Ascent="false" Height="true" Center="false" Base="true" Descent="false"/></ShapeListEntry>
          <ShapeListEntry Shape="g" SampleFolder="s/g"><Position Ascent="false" Height="true" Center="false" Base="false" Descent="true"/></ShapeListEntry></ShapeList>
        <NeuralNetwork><Nodes>
          <Node InputMax="2" Treshold="0" Type="eInput" Layer="0" Id="0"><Connections/></Node>
          <Node InputMax="1" Treshold="0.25" Type="eOutput" Layer="1" Id="1"><Connections><Connection Start="0" End="1" Weight="0.5"/></Connections></Node>
          <Node InputMax="1" Treshold="-0.5" Type="eOutput" Layer="1" Id="2"><Connections><Connection Start="0" End="2" Weight="-1.5"/></Connections></Node>
        </Nodes></NeuralNetwork></ShapeNet></ShapeNets></ShapeNeuralNetworkCollection>"""
    )
    nets = models.read_nets(spark, str(tmp_path / "nets.xml"))
    two = nets.where("net_id = 1").first()
    assert nets.count() == 2 and (two.name, two.examples, two.search_folders) == ("two", 9, False)
    assert [(e.label, e.position.descent, e.position.base) for e in two.labels] == [("a", False, True), ("g", True, False)]
    layers, most = models.network_of(*models.chosen_net(nets, 1))
    assert layers[0][0].tolist() == [[0.5], [-1.5]] and layers[0][1].tolist() == [0.25, -0.5] and most.tolist() == [2.0]
    models.write_nets(nets, str(tmp_path / "again"))
    again = models.read_nets(spark, str(tmp_path / "again")).where("net_id = 1").first()
    assert again.labels == two.labels and sorted(again.edges) == sorted(two.edges) and sorted(again.nodes) == sorted(two.nodes)


def test_samples_and_traces(spark, tmp_path):
    (tmp_path / "x").mkdir()
    g = np.full((4, 5), 255, np.uint8)
    g[1, 1:4] = [0, 90, 200]
    (tmp_path / "x" / "a.bmp").write_bytes(images.encode_bmp(g))
    (tmp_path / "image_000001_org.bmp").write_bytes(images.encode_bmp(np.full((2, 2), 255, np.uint8)))
    rows = {r.label: (r.pixel_count, r.threshold) for r in images.read_samples(spark, str(tmp_path)).collect()}
    assert rows["x"] == (3, 200) and (0, None) in rows.values()
    assert images.read_unlabelled(spark, str(tmp_path)).count() == 1
    images.write_trace({"org": images.read_pages(spark, str(tmp_path))}, str(tmp_path / "trace"))
    assert spark.read.parquet(str(tmp_path / "trace/org")).count() == 2


def test_kernels_of_lines_and_spurs():
    line = [(x, 100 + x // 10) for x in range(0, 300, 20)]
    angle = kernels.fit_angle(0, 100, 0.0, line)
    assert kernels.line_cost(0, 100, angle, line) == min(kernels.line_cost(0, 100, k * np.pi / 180, line) for k in range(-10, 11))
    flat = [(x, 120) for x in range(0, 200, 10)]
    assert kernels.fit_height(0, 117, 0.0, flat) == 120 and kernels.fit_height(0, 117, 0.0, flat, quirk=True) == 117
    p = np.zeros((9, 9), bool)
    p[3:6, 2:7] = True
    spur = p.copy()
    spur[2, 4] = spur[1, 4] = True
    assert (kernels.drop_spurs(spur) <= spur).all() and not kernels.drop_spurs(spur)[1, 4]
    gray = np.full((20, 20), 255)
    gray[4:16, 5:15] = 0
    assert kernels.glyph_plane(gray)[0].any() and kernels.glyph_plane(gray)[1:] == (10, 12)


def test_bases_equal_the_plain_version(spark):
    rng = np.random.default_rng(7)
    rows, k = [], 0
    for line in range(12):
        for x in range(int(rng.integers(1, 30))):
            rows.append((1, line, k, x * 10, int(rng.integers(0, 9)), 8, int(rng.choice([10, 11, 16]))))
            k += 1
    df = spark.createDataFrame(rows, "page_id long, line_id long, comp_id long, x0 int, y0 int, w int, h int")
    got = {r.line_id: (r.base, r.descent) for r in layout.line_bases(df).collect()}
    assert got == {line: pages.base_and_descent([r[4] + r[6] for r in rows if r[1] == line]) for line in range(12)}
    told = {r.line_id: (r.base, r.descent) for r in layout.sequential_bases(df, layout.line_metrics(df)).collect()}
    for line in range(12):
        own = sorted((r[3], r[2], r[4] + r[6]) for r in rows if r[1] == line)
        top, foot = min(r[4] for r in rows if r[1] == line), max(r[4] + r[6] for r in rows if r[1] == line)
        base, descent = [foot - (foot - top) // 10], [foot]
        for _, _, y in own:
            (base if abs(descent[-1] - y) > abs(base[-1] - y) else descent).append(y)
        assert [p.y for p in told[line][0]] == base and [p.y for p in told[line][1]] == descent


def test_relational_glyphs_equal_the_kernels(spark):
    rng = np.random.default_rng(9)
    planes = {}
    while len(planes) < 25:
        p = rng.random((int(rng.integers(2, 14)), int(rng.integers(2, 14)))) < 0.7
        if p.any(0).all() and p.any(1).all():
            planes[len(planes)] = p
    rows = [(1, c, int(x), int(y)) for c, p in planes.items() for y, x in zip(*np.nonzero(p), strict=True)]
    df = spark.createDataFrame(rows, "page_id long, comp_id long, x long, y long")
    mids, once = {}, {}
    for r in glyphs.run_midpoints(df).collect():
        mids.setdefault(r.comp_id, set()).add((r.y, r.x))
    for r in glyphs.thinned_once(df, ["page_id", "comp_id"]).collect():
        once.setdefault(r.comp_id, set()).add((r.y, r.x))
    shapes = {r["comp_id"]: r["class"] for r in glyphs.shape_classes(components.boxes(df), glyphs.run_statistics(df)).collect()}
    cuts = {}
    for r in glyphs.cut_candidates(glyphs.column_profiles(df)).collect():
        cuts.setdefault(r.comp_id, []).append(r.cut)
    mean = float(np.mean([p.size for p in planes.values()]))
    for c, p in planes.items():
        assert mids[c] == set(zip(*np.nonzero(kernels.thin_midpoints(p)), strict=True))
        assert shapes[c] == kernels.shape_class(p, mean)
        assert kernels.merge_cuts(sorted(cuts.get(c, []))) == kernels.cuts(p)
        ring = [kernels.shifted(p, *o) for o in kernels.AROUND]
        count = sum(r.astype(int) for r in ring)
        turns = sum((~a & b).astype(int) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))
        gone = p & (count >= 2) & (count <= 6) & (turns == 1) & ~(ring[0] & ring[2] & ring[4]) & ~(ring[2] & ring[4] & ring[6])
        assert once.get(c, set()) == set(zip(*np.nonzero(p & ~gone), strict=True))


def test_suggestions_equal_the_walk(spark):
    import random

    rng = random.Random(5)
    lex = sorted({"".join(rng.choices("abeilmnst", k=rng.randint(2, 7))) for _ in range(150)})
    words = sorted({"".join(rng.choices("abeilmnst?5", k=rng.randint(1, 8))) for _ in range(120)} | {"lilililililililililil"})
    known, asked = spark.createDataFrame([(w,) for w in lex], "w string"), spark.createDataFrame([(w,) for w in words], "w string")
    trie = lexicon.Trie(lex)
    want = {w: (s[0], d) for w in words for d, s in [trie.suggest(w)] if s}
    for out in (lexicon.trie_suggestions(asked, known, most=8), lexicon.walked(asked, known, trie_words=40, task_words=50)):
        assert {r.w: (r.suggestion, r.distance) for r in out.collect()} == want
    pairs = [("".join(rng.choices("abc", k=rng.randint(0, 9))), "".join(rng.choices("abc", k=rng.randint(0, 9)))) for _ in range(200)] + [("", ""), ("😀b", "b😀")]
    assert lexicon.osa_distances([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [lexicon.osa_distance(a, b) for a, b in pairs]
    df = spark.createDataFrame([(None, "a"), ("ab", "ba")], "a string, b string")
    assert sorted(str(r[0]) for r in df.select(lexicon.osa("a", "b")).collect()) == ["1", "None"]


def test_training_keeps_and_ends(spark):
    x, y = np.eye(4), np.eye(4)
    seen = []
    network.train(x, y, hidden=(3,), repetitions=9, after=lambda k, layers: seen.append(layers[0][0].copy()) or k == 2)
    assert len(seen) == 3
    drawn = network.train(np.array([[0.0], [9.0]]), np.array([[0.0], [1.0]]), hidden=(2,), repetitions=40, quirk=True)
    assert network.forward_numpy(np.array([[0.0]]), drawn)[0, 0] < 0.5


def test_lines_are_read_once_and_pages_spread(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    given = spark.createDataFrame([("p", k, f"caat w{'rn' * 9}{k}") for k in range(5)], "path string, line_id long, content string").mapInPandas(seen, "path string, line_id long, content string")
    dictionary = spark.createDataFrame([("cat",)], "w string")
    out = pages.corrected(given, dictionary).orderBy("line_id").collect()
    assert [r.content.split(" ")[0] for r in out] == ["cat"] * 5 and read.value == 5
    spark.catalog.clearCache()
    many = spark.range(40).select(F.col("id").alias("page"))
    assert pages.spread(many, "page").groupBy("page").applyInPandas(lambda p: p, "page long").rdd.getNumPartitions() >= 16


def test_splits_of_many_glyphs_ask_together():
    rng = np.random.default_rng(4)
    planes = [rng.random((9, w)) < 0.5 for w in (12, 20, 31, 40)]
    calls = []

    def told(pieces):
        calls.append(len(pieces))
        return [("garbage" if p.sum() % 7 == 0 else "a", int(p.sum()) * 37 % 101 / 101) for p in pieces]

    alone = [kernels.split(p, told) for p in planes]
    one_by_one, calls[:] = len(calls), []
    assert kernels.split_all(planes, told) == alone and len(calls) < one_by_one


def test_stacked_thinning_and_pruning_are_as_plain_ones():
    rng = np.random.default_rng(9)
    for k in range(60):
        h, w = rng.integers(1, 70, 2)
        plane = rng.random((h, w)) < rng.choice([0.3, 0.6, 0.9])
        assert (kernels.thin_condensed(plane) == kernels._thin_condensed_wide(plane, 255)).all()
    stack = rng.random((20, 32, 32)) < 0.7
    assert (kernels.thin_condensed(stack) == np.stack([kernels.thin_condensed(p) for p in stack])).all()
    pale = np.full((8, 12), 255, np.uint8)
    pale[3:6, 1:11] = 0
    pale[2, 4:7] = 150
    assert (kernels.prune(pale, 0, 170)[2] == 255).all() and (kernels.prune(pale, 0, 170)[3:6, 1:11] == 0).all()
