"""Bitmaps, models, streams and a whole page from file to text."""

import numpy as np

from glyphmill.operators import network, pages
from glyphmill.sources import images, models
from glyphmill.streaming.pages import stream_components


def page():
    gray = np.full((100, 160), 255, dtype=np.uint8)
    for y in (10, 40, 70):
        for x in range(10, 150, 14):
            gray[y : y + 12, x : x + 8] = 0
    return gray


def test_bitmap_round_trip():
    for w in (1, 3, 4, 37):
        g = np.random.default_rng(w).integers(0, 256, (5, w)).astype(np.uint8)
        assert (images.decode_bmp(images.encode_bmp(g)) == g).all()


def test_page_end_to_end(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "p.bmp").write_bytes(images.encode_bmp(page()))
    df = images.read_pages(spark, str(tmp_path))
    assert df.select("width", "height").first() == (160, 100)
    assert images.to_pixels(df).count() == 3 * 10 * 96
    comps = pages.page_components(df)
    assert comps.count() == 30
    names = [chr(97 + k) for k in range(10)]
    placed = pages.placed_components(pages.typed_components(comps), 160, 100)
    said = pages.recognise(placed, network.synthetic(), names)
    text = pages.lines_text(said).orderBy("line_id").collect()
    assert len(text) == 3 and all(len(r.content.replace(" ", "")) == 10 for r in text)
    assert images.sample_counts(images.read_samples(spark, str(tmp_path))).first() == ("a", 1)
    assert images.decode_bmp(images.encode_pages(df).first().content).shape == (100, 160)


def test_models(spark, tmp_path):
    (tmp_path / "w.txt").write_text("cat\n\nbat\ncat\n")
    assert sorted(r.w for r in models.read_words(spark, str(tmp_path / "w.txt")).collect()) == ["bat", "cat"]
    nodes, edges = models.network_tables(spark, network.synthetic((3, 2, 2)), np.ones(3))
    models.save_network(nodes, edges, str(tmp_path / "net"))
    layers, most = models.network_of(*models.load_network(spark, str(tmp_path / "net")))
    for (a, t), (b, u) in zip(layers, network.synthetic((3, 2, 2)), strict=True):
        assert np.allclose(a, b) and np.allclose(t, u)
    words = spark.createDataFrame([(2, [1, 2]), (99, [3])], "ch int, children array<long>").coalesce(1)
    models.write_word_nodes(words, str(tmp_path / "trie"))
    assert models.read_word_nodes(spark, str(tmp_path / "trie")).collect() == words.collect()


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "p.bmp").write_bytes(images.encode_bmp(page()))
    q = stream_components(spark, str(folder)).writeStream.format("memory").queryName("comps").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) from comps").first()[0] == 30


def test_labels_and_curation(spark, tmp_path):
    labels = spark.createDataFrame([("a", "d1", (True, False, False, True, False)), ("g", "d2", (False, True, False, False, True))], "label string, sample_dir string, position struct<ascent: boolean, height: boolean, center: boolean, base: boolean, descent: boolean>")
    models.write_labels(labels, str(tmp_path / "labels"))
    assert sorted(models.read_labels(spark, str(tmp_path / "labels")).collect()) == sorted(labels.collect())
    existing = spark.createDataFrame([("a", "00000007.bmp"), ("a", "00000003.bmp")], "label string, sample string")
    chosen = spark.createDataFrame([("x", "a"), ("y", "a"), ("z", "b")], "path string, label string")
    assert sorted(tuple(r) for r in models.curated_names(existing, chosen).collect()) == [("x", "a", "00000008.bmp"), ("y", "a", "00000009.bmp"), ("z", "b", "00000001.bmp")]
