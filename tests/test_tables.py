"""Signals, images, files, streams, and the registered queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import image, signal
from scriptorium.sources import files
from scriptorium.streaming import texts


def series(spark, values):
    return spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(values)], "series string, pos int, val double")


def test_moving_mean(spark):
    got = signal.moving_mean(series(spark, [1] * 5)).orderBy("pos").collect()
    assert [round(r.smooth, 6) for r in got] == [0.6, 0.8, 1.0, 0.8, 0.6]


def test_bands(spark):
    got = signal.bands(series(spark, [0] * 20 + [9] * 10 + [0] * 20 + [9] * 10)).orderBy("top").collect()
    assert [(r.top, r.bottom) for r in got] == [(14, 36), (44, 60)]


def test_thresholds(spark):
    values = [10] * 30 + [12] * 10 + [200] * 20
    assert signal.otsu(series(spark, values)).first().threshold == 12
    assert image.otsu_level(np.array(values, np.uint8).reshape(6, 10)) == 12
    stretched = signal.contrast_stretch(series(spark, range(101))).orderBy("pos").collect()
    assert (stretched[0].stretched, stretched[100].stretched, stretched[50].stretched) == (0, 255, 127.5)
    assert signal.contrast_stretch(series(spark, [7, 7])).first().stretched == 7


def test_measures(spark):
    assert signal.variation(series(spark, [5] * 9), ["series"]).first().cov == 0.5
    assert signal.variation(series(spark, [0, 2] * 5), ["series"]).first().cov == 0.5
    assert signal.median_angle(spark.createDataFrame([("s", a) for a in (1.0, 3.0, 80.0)], "series string, angle double"), ["series"]).first().slant == 2
    boxes = spark.createDataFrame([("s", 10.0, 9.0, 100.0)] * 5 + [("s", 50.0, 9.0, 100.0)], "series string, height double, width double, page_height double")
    assert signal.box_variation(boxes, ["series"]).first().height_variance == 0
    width, height = signal.scaled_size(F.lit(600), F.lit(300))
    assert tuple(spark.range(1).select(width, height).first()) == (1200, 600)


def test_images(spark):
    page = np.full((40, 60), 255, np.uint8)
    for i in range(6):
        page[4:8, 4 + 9 * i : 9 + 9 * i] = 0
    ink = page < 128
    assert len(np.unique(image.components(ink))) == 7
    got = image.measures(page)
    assert got["height_variance"] == 0 and abs(got["connectivity"] - 20 / 2400) < 1e-9
    rows = spark.createDataFrame([(1, 0, 40, 60, bytearray(page.tobytes()))], "doc_id long, page_idx int, h int, w int, data binary")
    assert image.page_measures(rows).first().sharpness == pytest.approx(image.sharpness(page))
    rgb = np.full((50, 50, 3), 255, np.uint8)
    rgb[:, 5] = (220, 20, 20)
    assert (image.red_margin_cut(rgb)[:, :17] == 255).all()
    assert set(np.unique(image.sauvola(page))) <= {0, 255} and image.gray(rgb).shape == (50, 50) and 0 < image.ink_share(page) < 0.2
    pixels = spark.createDataFrame([(1, r, c, 0, 30, 30) for r in range(30) for c in range(30)], "doc long, row int, col int, val int, h int, w int")
    assert signal.cropped(pixels).count() == 100


def test_files(spark, tmp_path):
    for name in ("a.pdf", "b.pdf", "c.txt"):
        (tmp_path / name).write_bytes(name[0].encode() * 3)

    def fails(content):
        raise ValueError("no such kind")

    def pages(content):
        return [] if content.startswith(b"b") else [(i, content, None) for i in range(60)]

    got = files.read_pages(files.read_files(spark, str(tmp_path), files.PDF_GLOB), [fails, pages])
    assert {(r.path[-5:], r.pages) for r in files.page_counts(got).collect()} == {("a.pdf", 50), ("b.pdf", 0)}
    assert "no such kind" in got.where("status = 'error'").first().error
    images = spark.createDataFrame([(1, bytearray(b"x")), (2, None)], "doc_id long, image binary")
    read = files.recognise(images, {"one": lambda b: b.decode(), "bad": fails}).orderBy("doc_id", "ord").collect()
    assert [(r.engine, r.text) for r in read] == [("one", "x"), ("bad", ""), ("one", ""), ("bad", "")]
    files.write_text(spark.createDataFrame([("a",), (" ",), (None,)], "text string"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a"]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "hello.World a@b.com"), (2, None)], "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = texts.cleaned(texts.read_stream(spark, str(tmp_path / "in"), rows.schema))
    texts.write(stream, str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination(120)
    wanted = {tuple(map(str, r)) for r in texts.cleaned(rows).collect()}
    assert {tuple(map(str, r)) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == wanted


def test_registry(spark):
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 60
    assert entry.entry(spark).count() == 4
