import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from inkledger.operators import engines, imaging
from inkledger.plans import workbench
from inkledger.sources import files, sinks
from inkledger.streaming import landing

SF = "/root/testdata/sf0.001"
GOLDEN = "Ledger — shop\nDate Item Qty Price Total\n2026-01-03 Maize meal 2 3.50 7.00\n2026-01-09 Sugar 2kg 3 2.10 6.30"


@pytest.mark.parametrize("name", sorted(workbench.QUERIES))
def test_against_sql(spark, name):
    con, made = duckdb.connect(), workbench.QUERIES[name](spark, SF)
    columns = sorted(made.columns)
    mine = sorted((tuple(r) for r in made.select(*columns).collect()), key=repr)
    if name not in workbench.ORACLES:
        assert mine
        return
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    assert mine == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({workbench.ORACLES[name]})").fetchall(), key=repr)


def page(height=120, width=160):
    out = np.full((height, width), 220, np.uint8)
    for y in range(30, 90, 10):
        out[y : y + 4, 20:140] = 40
    return out


@pytest.mark.parametrize("angle", [-7.0, -3.0, 0.0, 4.0])
def test_tilt_is_found_and_undone(angle):
    tilted = imaging.turn(page(), -angle)
    assert imaging.tilt(tilted) == pytest.approx(angle, abs=0.6)
    level, turned = imaging.deskew(tilted)
    assert level.shape == tilted.shape and abs(imaging.tilt(level)) < 0.8 and (turned == 0.0) == (angle == 0.0)


def test_image_steps():
    rng = np.random.default_rng(1)
    noisy = np.clip(page().astype(float) + rng.normal(0, 8, (120, 160)), 0, 255).astype(np.uint8)
    assert imaging.grey(np.dstack([noisy] * 3)).tolist() == imaging.grey(noisy[:, :, None]).tolist() == noisy.tolist()
    quiet = imaging.denoise(noisy)
    assert np.abs(quiet - page().astype(float)).mean() < np.abs(noisy - page().astype(float)).mean() / 2
    even = imaging.even_out(quiet)
    assert even.shape == noisy.shape and np.ptp(even.astype(int)) >= np.ptp(quiet.astype(int))
    black = imaging.binarise(quiet)
    assert set(np.unique(black)) <= {0, 255} and ((black == 0) == (page() < 100)).mean() > 0.98
    assert imaging.threshold(page()) in range(40, 220)
    assert imaging.deskew(np.full((9, 9), 7, np.uint8))[1] == 0.0


def test_images_through_files(spark, tmp_path):
    colour = np.dstack([page(), page() // 2, page() // 3])
    rows = [("a", 120, 160, 1, page().tobytes()), ("b", 120, 160, 3, colour.tobytes()), ("none", 0, 0, 1, None)]
    images = spark.createDataFrame([(*r[:4], bytearray(r[4]) if r[4] else None) for r in rows], "stem string, height int, width int, channels int, data binary")
    made = {r.stem: r.cleaned for r in imaging.clean(images).collect()}
    assert made["none"].png is None and set(bytes(made["a"].data)) <= {0, 255}
    stages = {r.stem: r.stages for r in imaging.clean_stages(images).collect()}
    assert all(bytes(stages["b"][s]).startswith(b"\x89PNG") for s in imaging.STAGES)
    with pytest.raises(Exception, match="without pixels"):
        imaging.clean(images, strict=True).select("cleaned.png").collect()
    names = [("b.PNG", bytearray(stages["b"].original)), ("broken.png", bytearray(b"no")), ("x.txt", bytearray(b"no")), ("gone.png", None)]
    sinks.write_files(spark.createDataFrame(names, "name string, content binary"), str(tmp_path / "scans"), "name", "content")
    found = files.image_files(spark, str(tmp_path / "scans"))
    assert sorted((r.name, r.stem) for r in found.collect()) == [("b.PNG", "b"), ("broken.png", "broken")]
    (back,) = files.decoded_images(spark, str(tmp_path / "scans")).collect()
    assert (back.stem, back.channels) == ("b", 3) and bytes(back.data) == colour.tobytes()
    assert files.image_files(spark, str(tmp_path / "nowhere")).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.image_files(spark, str(tmp_path / "nowhere"), strict=True)


def test_texts_and_truth(spark, tmp_path):
    for name, text in (("a.tesseract.txt", GOLDEN), ("a.easyocr.txt", GOLDEN), ("b.tesseract.txt", "x"), ("c.txt", " c \n"), ("skip.csv", "no")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    assert sorted(r.stem for r in files.texts(spark, str(tmp_path)).collect()) == ["a.easyocr", "a.tesseract", "b.tesseract", "c"]
    readings = files.engine_texts(spark, str(tmp_path), ("tesseract", "easyocr"))
    assert sorted((r.stem, r.engine) for r in readings.collect()) == [("a", "easyocr"), ("a", "tesseract")]
    assert {r.stem: r.text for r in files.text_truth(spark, str(tmp_path)).collect()}["c"] == "c"
    truth = tmp_path / "truth"
    truth.mkdir()
    (truth / "a_fields.csv").write_text('date,item,qty,price,total\n2026-01-03,Maize meal,2,3.50,7.00\n2026-01-09,"Sugar, ""2kg""",3,,6.30\n')
    (truth / "e_fields.csv").write_text("date,item,qty,price,total\n")
    rows, stems = files.field_truth(spark, str(truth))
    got = [tuple(r) for r in rows.orderBy("stem", "row_pos").collect()]
    assert got == [("a", 0, "2026-01-03", "Maize meal", "2", "3.50", "7.00"), ("a", 1, "2026-01-09", 'Sugar, "2kg"', "3", "", "6.30")]
    assert sorted(r.stem for r in stems.collect()) == ["a", "e"]
    scores = engines.score_fusion(readings, rows, stems).collect()
    assert {(r.stem, r.engine) for r in scores} == {("a", e) for e in ("tesseract", "easyocr", "fused")} and all(0 < r.cer < 1 for r in scores)
    sinks.write_csv(rows, str(tmp_path / "out"))
    again = spark.read.csv(str(tmp_path / "out"), header=True, quote='"', escape='"')
    assert sorted(r.item for r in again.collect()) == ["Maize meal", 'Sugar, "2kg"']
    sinks.write_csv(rows, str(tmp_path / "flat"), order="stem", by=None, fields=("stem", "item"))
    assert spark.read.csv(str(tmp_path / "flat"), header=True).columns == ["stem", "item"]
    sinks.write_json(rows, str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json"), wholetext=True).first().value.startswith('[\n  {\n    "date": "2026-01-03",\n    "item": "Maize meal"')


def test_engines(spark):
    kind = "stem string, path string, content binary"
    raw = spark.createDataFrame([("a", "raw/a.png", bytearray(b"A")), ("b", "raw/b.png", bytearray(b"B"))], kind)
    cleaned = spark.createDataFrame([("a_clean", "c/a_clean.png", bytearray(b"old")), ("a_clean", "c/a_clean.tif", bytearray(b"new"))], kind)
    upper = lambda: lambda raw: f" {raw.decode()}! "
    got = {(r.stem, r.engine): r.text for r in engines.run_engines(raw, cleaned, ("one", upper), ("two", upper)).collect()}
    assert got == {("a", "one"): "new!", ("b", "one"): "B!", ("a", "two"): "A!", ("b", "two"): "B!"}


def test_images_to_rows(spark, tmp_path):
    """Cleaned where no cleaned image is there, read by both engines, fused and scored."""
    levels = [("a", 120, 160, 1, bytearray(page().tobytes())), ("b", 120, 160, 1, bytearray(page().tobytes()))]
    decoded = spark.createDataFrame(levels, "stem string, height int, width int, channels int, data binary")
    kind = "stem string, path string, content binary"
    raw = spark.createDataFrame([("a", "raw/a.png", bytearray(b"raw")), ("b", "raw/b.png", bytearray(b"raw"))], kind)
    cleaned = spark.createDataFrame([("a_clean", "c/a_clean.png", bytearray(b"kept"))], kind)
    whole = lambda: lambda data: GOLDEN if data == b"kept" else GOLDEN.replace("7.00", "7.50") if data.startswith(b"\x89PNG") else "none"
    other = lambda: lambda data: GOLDEN if data == b"raw" else "none"
    rows = engines.fuse_images(raw, cleaned, decoded, ("tesseract", whole), ("easyocr", other)).orderBy("stem", "row_pos").collect()
    assert [(r.stem, r["item"], r.total) for r in rows] == [(s, i, t) for s in "ab" for i, t in (("Maize meal", "7.00"), ("Sugar 2kg", "6.30"))]
    images = raw.withColumn("name", F.concat("stem", F.lit(".png")))
    truth = spark.createDataFrame([("a", GOLDEN)], "stem string, text string")
    scores = {(r.name, r.engine): (r.cer, r.wer) for r in engines.score_images(images, truth, {"tesseract": whole, "easyocr": other}).collect()}
    assert scores["a.png", "easyocr"] == (0.0, 0.0) and scores["a.png", "tesseract"] == (pytest.approx(1.0, abs=0.05), 1.0) and scores["b.png", "easyocr"] == (None, None)
    sinks.write_stages(imaging.clean_stages(decoded), str(tmp_path / "stages"))
    assert sorted(p.name for p in (tmp_path / "stages").glob("a_*.png")) == sorted(f"a_{s}.png" for s in imaging.STAGES)
    (tmp_path / "scans").mkdir()
    read = lambda images: images.select("stem", F.lit(GOLDEN).alias("text"))
    assert files.ledger_texts(spark, str(tmp_path / "no"), str(tmp_path / "no"), read)[0] is None
    found, told = files.ledger_texts(spark, str(tmp_path / "no"), str(tmp_path / "stages"), read)
    assert found.count() == 12 and "are read" in told
    (tmp_path / "scans" / "x.txt").write_text(GOLDEN, encoding="utf-8")
    assert files.ledger_texts(spark, str(tmp_path / "scans"), str(tmp_path / "stages"), read)[0].first().stem == "x"


def test_landing(spark, tmp_path):
    inbox, store, marks = (tmp_path / d for d in ("in", "store", "marks"))
    inbox.mkdir()
    for n in range(3):
        (inbox / f"s{n}.tesseract.txt").write_text(GOLDEN, encoding="utf-8")
        landing.parse_landing(landing.landed_texts(spark, str(inbox), 1), str(store), str(marks), once=True).awaitTermination()
    rows = spark.read.parquet(str(store)).collect()
    assert sorted({(r.stem, r.engine) for r in rows}) == [(f"s{n}", "tesseract") for n in range(3)] and len(rows) == 6
