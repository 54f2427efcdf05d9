import json
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from inkledger.operators import extraction, fusion, records, scoring
from inkledger.plans import queries

SF = "/root/testdata/sf0.001"
FIELDS = ("date", "item", "qty", "price", "total")

GOLDEN = "Ledger — shop\nDate Item Qty Price Total\n2026-01-03 Maize meal 2 3.50 7.00\n2026-01-09 Sugar 2kg 3 2.10 6.30"


def parse(spark, text):
    rows = extraction.extract_fields(spark.createDataFrame([("s", text)], "stem string, text string")).orderBy("row_pos").collect()
    return [tuple(r[f] for f in FIELDS) for r in rows]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("", []),
        (None, []),
        (" \n\t ", []),
        ("no dates here 3.50", []),
        (GOLDEN, [("2026-01-03", "Maize meal", "2", "3.50", "7.00"), ("2026-01-09", "Sugar 2kg", "3", "2.10", "6.30")]),
        ("only one 2026-01-03 Tea 1 2.75 2.75\nThanks 4 coming", [("2026-01-03", "Tea Thanks 4 coming", "1", "2.75", "2.75")]),
        ("2026-01-03\nMaize meal\n2\n3.50\n7.00", [("2026-01-03", "Maize meal", "2", "3.50", "7.00")]),
        ("2026-01-05 Cooking oil 1 4,25 €4.25", [("2026-01-05", "Cooking oil", "1", "4.25", "4.25")]),
        ("2026-01-09 Sugar 2kg 3 2.10 6.30 12", [("2026-01-09", "Sugar 2kg 12", "3", "2.10", "6.30")]),
        ("2026-01-09 Oil 1.00 2.00 3.00", [("2026-01-09", "Oil", "", "2.00", "3.00")]),
        ("2026-01-09 Oil 3.00", [("2026-01-09", "Oil", "", "", "3.00")]),
        (GOLDEN + "\n2026-01-04, Tea 1 2.00 x", [("2026-01-03", "Maize meal", "2", "3.50", "7.00"), ("2026-01-09", "Sugar 2kg", "3", "2.10", "6.30"), ("2026-01-04", "2026-01-04, Tea x", "1", "", "2.00")]),
        ("2026-01-05 A 5 5 1.00", [("2026-01-05", "A 5", "5", "", "1.00")]),
    ],
)
def test_extraction(spark, text, expected):
    assert parse(spark, text) == expected


def fused(spark, a, b):
    make = lambda t: extraction.extract_fields(spark.createDataFrame([("s", t)], "stem string, text string"))
    return fusion.fuse(make(a), make(b)).orderBy("row_pos").collect()


def test_fusion_of_equal_readings(spark):
    rows = fused(spark, GOLDEN, GOLDEN)
    assert [tuple(r[f] for f in FIELDS) for r in rows] == parse(spark, GOLDEN)
    assert {r[f"{f}_source"] for r in rows for f in ("date", "qty", "price", "total")} == {"agree"}


def test_fusion_rules(spark):
    rows = fused(spark, "2026/01/03 Soap bar 300 2 350 7.00\n2026-01-04 Tea 1 1.00 1.00", "2026-01-03 Soap 2 3.50 7.00\n2026-02-04 Tea 1 1.10 1.10\n2026-03-01 Surplus 1 1.00 2.00")
    assert [r["date"] for r in rows] == ["2026-01-03", "2026-02-04"]
    assert rows[0]["price"] == "3.50" and rows[0]["price_source"] == "easyocr" and rows[0]["date_source"] == "easyocr"
    assert len(rows) == 2
    alone = fused(spark, "2026-01-03 Soap 2 3.50 7.00", "")
    assert alone[0]["date_source"] == "tesseract" and alone[0]["qty_source"] == "tesseract"


def test_rates(spark):
    df = spark.createDataFrame([("abc", "abd"), ("", ""), ("x", ""), ("x", None), ("a b c", "a x c")], "p string, t string")
    got = df.select(scoring.cer(df.p, df.t).alias("c"), scoring.wer(df.p, df.t).alias("w")).collect()
    assert [r.c for r in got][1:4] == [0.0, 1.0, None] and [r.w for r in got][1:4] == [0.0, 1.0, None]
    assert got[0].c == pytest.approx(1 / 3) and got[4].w == pytest.approx(1 / 3)


def test_records(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2026-01-03", "a", "1", "", "", "x.png"), (2, " ", "", "", "", "", "x.png"), (3, "", "b", "", "", "", "x.png")], "n int, date string, item string, qty string, price string, total string, source_file string")
    for _ in range(2):
        records.save(spark, rows, str(tmp_path / "records"), ["n"], "2026-01-01T00:00:00+00:00")
    saved = spark.read.parquet(str(tmp_path / "records"))
    assert sorted(r.id for r in saved.collect()) == [1, 2, 3, 4]
    assert records.export_name(saved).first().name == "x"
    assert records.export_name(saved.limit(0)).first().name == "records"
    told = records.export(saved, str(tmp_path / "json"), "json").first()
    assert told.message == "Exported 4 record(s) as x.json (source: x.png)."
    parts = sorted((tmp_path / "json").glob("part-*.txt"))
    made = json.loads("".join(p.read_text() for p in parts))
    assert [r["id"] for r in made] == [1, 2, 3, 4] and list(made[0]) == list(records.COLUMNS) and made[1]["item"] == "b"
    assert parts[0].read_text().startswith('[\n  {\n    "id": 1,\n    "date": "2026-01-03"')
    records.export(saved, str(tmp_path / "csv"), "csv")
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert [r.id for r in back.collect()] == ["1", "2", "3", "4"] and tuple(back.columns) == records.COLUMNS
    with pytest.raises(ValueError, match="unknown export format"):
        records.export(saved, str(tmp_path / "xml"), "xml")


def test_store_and_forms(spark):
    for _ in range(2):
        records.create_store(spark, "ledger_records")
    assert tuple(spark.table("ledger_records").columns) == records.COLUMNS
    spark.sql("DROP TABLE ledger_records")
    forms = [("a.png ", "2", {"date_0": " 2026-01-03", "item_1": "é", "date_2": "x"}), ("b.png", "two", {"date_0": "x"}), ("c.png", "-1", {}), ("d.png", None, {})]
    got = records.corrections(spark.createDataFrame(forms, "source_file string, num_rows string, cells map<string,string>")).collect()
    assert [(r.source_file, r.i, r.date, r.item, r.qty) for r in got] == [("a.png", 0, "2026-01-03", "", ""), ("a.png", 1, "", "é", "")]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("block", [1, 3, 8, 2048])
def test_word_edits(monkeypatch, block):
    monkeypatch.setattr(scoring, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 20))] for _ in range(2))
        assert scoring.word_edits(a, b) == distance(a, b)


def test_word_errors_of_long_texts(spark):
    rng = random.Random(7)
    words = [f"w{rng.randrange(70_000)}" for _ in range(50_000)]
    few, other = [*words[100:20_000], "new", *words[20_000:]], [f"v{k}" for k in range(9_000)]
    mixed = [w if k % 50 else "x" for k, w in enumerate(words[:20_000])]
    rows = [(" ".join(few), " ".join(words)), (" ".join(other), " ".join(words[:9_000])), (" ".join(mixed), " ".join(words[:20_000]))]
    df = spark.createDataFrame(rows, "p string, t string")
    got = [r.w for r in df.select(scoring.wer(df.p, df.t).alias("w")).collect()]
    assert got == [pytest.approx(101 / 50_000), 1.0, pytest.approx(400 / 20_000)]


def test_character_errors(spark):
    rng = random.Random(3)
    pairs = [("x" * 99, "y"), *[tuple("".join(rng.choice("abé") for _ in range(rng.randint(1, 90))) for _ in range(2)) for _ in range(60)]]
    df = spark.createDataFrame(pairs, "p string, t string")
    assert [r.c for r in df.select(scoring.cer(df.p, df.t).alias("c")).collect()] == [pytest.approx(min(1, distance(t, p) / len(t))) for p, t in pairs]


def test_naming_of_empty_items(spark):
    df = spark.createDataFrame([("s", "2026-01-03 1 2,50 €5.00\n2026-01-04 Tea 1 2.50 2.50")], "stem string, text string")
    rows = extraction.extract_fields(df, name_item=lambda line: F.concat(F.lit("<"), line, F.lit(">"))).orderBy("row_pos").collect()
    assert [r["item"] for r in rows] == ["<2026-01-03 1 2,50 €5.00>", "Tea"]


def test_golden_ledger(spark):
    text = """Shop Ledger — January
Date Item Qty Price Total
2026-01-03 Maize meal 2 3.50 7.00
2026-01-05 Cooking oil 1 4.25 4.25
2026-01-09 Sugar 2kg 3 2.10 6.30
2026-01-12 Bread 5 1.15 5.75
2026-01-15 Soap bar 4 0.90 3.60
2026-01-20 Tea leaves 1 2.75 2.75"""
    expected = [
        ("2026-01-03", "Maize meal", "2", "3.50", "7.00"), ("2026-01-05", "Cooking oil", "1", "4.25", "4.25"), ("2026-01-09", "Sugar 2kg", "3", "2.10", "6.30"),
        ("2026-01-12", "Bread", "5", "1.15", "5.75"), ("2026-01-15", "Soap bar", "4", "0.90", "3.60"), ("2026-01-20", "Tea leaves", "1", "2.75", "2.75"),
    ]
    assert parse(spark, text) == expected


@pytest.mark.parametrize("name", ("detect_shape", "align_rows", "fuse_rows", "truth_left_join", "partial_summary", "records_save", "export_name", "records_export", "form_corrections", "corrections_save", "unique_stem", "choose_date", "image_names"))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    columns = sorted(queries.QUERIES[name](spark, SF).columns)
    mine = {tuple(r) for r in queries.QUERIES[name](spark, SF).select(*columns).collect()}
    theirs = set(con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall())
    assert mine == theirs
