"""Images, artefacts and the registry."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from inkframe.plans import catalogue, catalogue2  # noqa: F401
from inkframe.sources import images as I
from inkframe.sources import sinks as K


def png(rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in rgb)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_images_are_pixels(spark, tmp_path):
    rgb = np.random.default_rng(0).integers(0, 256, (5, 7, 3))
    (tmp_path / "a.png").write_bytes(png(rgb))
    im = I.open_images(spark, str(tmp_path), page_w_mm=70.0)
    row = im.first()
    assert (row.width, row.height, row.mm_per_px, row.page_h_mm) == (7, 5, 10.0, 50.0)
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in I.pixels(im).collect()}
    assert got == {(y, x): tuple(rgb[y, x].tolist()) for y in range(5) for x in range(7)}
    assert I.crop_left(I.pixels(im), 2).agg(F.max("x")).first()[0] == 4
    assert I.crop_left(I.pixels(im), 99, keep_last=True).agg(F.max("x"), F.count("x")).first()[:] == (0, 5)
    assert I.image_widths(spark, str(tmp_path)).first().width == 7


def test_readers(spark, tmp_path):
    (tmp_path / "scan.json").write_text(json.dumps({"texts": [{"text": "a", "score": 0.5, "box": [1, 2, 3, 4]}]}))
    (tmp_path / "no.json").write_text("{}")
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "list.txt").write_text("# note\n\n a=1 \n")
    assert tuple(I.scan_texts(spark, str(tmp_path / "scan.json")).first())[:7] == ("a", 0.5, 1, 2, 3, 4, 0)
    with pytest.raises(PySparkException):
        I.scan_texts(spark, str(tmp_path / "no.json")).collect()
    assert I.read_json(spark, str(tmp_path / "bad.json"), "a int").count() == 0
    assert I.read_json(spark, str(tmp_path / "none.json"), "a int").count() == 0
    assert [r.line for r in I.read_lines(spark, str(tmp_path / "list.txt")).collect()] == ["a=1"]
    found = I.find_first(spark, [f"{tmp_path}/missing", str(tmp_path)], "*.json").first().path
    assert I.find_first(spark, [f"{tmp_path}/missing"], "*.json").count() == 0
    assert found.endswith("bad.json")
    (tmp_path / "Some-Bold.ttf").write_bytes(b"x")
    assert I.font_files(spark, str(tmp_path)).first().family == "Some"


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([("a", 10, 10, 20, 14, None, 0, False), ("b", 0, 0, 5, 5, "#abc", 180, True)], "name string, x0 int, y0 int, x1 int, y1 int, color string, rot int, suspect boolean")
    assert [r.line for r in K.live_region_lines(t, 100, 50).collect()] == ["a=8,16,8,22"]
    assert K.live_region_lines(t, 100, 50, include_suspect=True).where("line like 'b=%'").first().line == "b=0,7,0,7,#abc,rot=180"
    assert [r.line for r in K.trace_region_lines(t.withColumn("invert", F.col("name") == "b")).collect()] == ["a:10,10,20,14", "b:0,0,5,5,invert,#abc"]
    p = K.placement(t.withColumn("kind", F.lit("art")), 0.5, 100.0).where("name = 'a'").first()
    assert (p.layer, p.x, p.y, p.w, p.h) == ("ART", 5.0, 93.0, 5.0, 2.0)
    m = K.manifest(t.select("name", "x0"), {"source": "s"}, {"u": 8}).first()
    assert m.params.u == 8 and m.regions["b"].x0 == 0
    K.write_json(t, f"{tmp_path}/out")
    with pytest.raises(PySparkException):
        K.write_json(t, f"{tmp_path}/out")
    assert "unknown" in K.report(spark.createDataFrame([("x", None), ("y", 1.5)], "name string, iou double"))
    assert json.loads(K.report_json(spark.createDataFrame([("x", None)], "name string, iou double"))) == [{"name": "x", "iou": None}]
    scores = spark.createDataFrame([("x", 1.5)], "name string, iou double")
    whole = spark.createDataFrame([(9.5,)], "iou double")
    assert K.metrics(scores, whole).first().regions["x"].iou == 1.5 and K.metrics(scores.limit(0), whole).count() == 0
    assert K.run_log([("scan", 1.25, "ok")]) == "scan\t1.2\tok"
    v = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", False)], "name string, convert boolean")
    e = spark.createDataFrame([("b", 0.05), ("c", 0.06)], "name string, max_error double")
    assert {r.name: r.action for r in K.actions(v, e).collect()} == {"a": "create", "b": "replace", "c": "skip_existing"}


def test_registry():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) > 90
