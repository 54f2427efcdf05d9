"""What keeps queries within time and disk on larger tables: rows made once, dealt once, and left out of checkpoints."""

import os
import random
import sys

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from inkledger.functions import semantics as S
from inkledger.operators import extraction, fusion, imaging, records, scoring
from inkledger.plans import lineage, queries, workbench
from inkledger.sources import render
from inkledger.streaming import landing

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["fuse_rows", "align_rows", "rows_to_text"])
def test_rows_are_dealt_by_ledger_once(spark, name):
    """No checkpoint of parsed rows, and no shuffle after the one of order lines."""
    plan = plan_of(queries.QUERIES[name](spark, SF))
    assert plan.count("Exchange hashpartitioning(stem") == plan.count("Exchange hashpartitioning(") == 1
    assert "Scan ExistingRDD" not in plan


def test_rows_of_other_engines_are_not_paired(spark):
    rows = [("s", e, k, d, "Tea", "1", "", t) for e, t in (("one", "1.00"), ("two", "2.00"), ("third", "3.00")) for k, d in enumerate(("2026-01-03", "2026-01-04"))]
    rows = spark.createDataFrame(rows, "stem string, engine string, row_pos int, date string, item string, qty string, price string, total string")
    made = sorted((r.engine, r.row_pos, r.total) for r in fusion.with_fused(rows, "one", "two").collect())
    assert made == sorted((e, k, t) for e, t in (("one", "1.00"), ("two", "2.00"), ("third", "3.00"), ("fused", "2.00")) for k in range(2))


def test_blanks_are_stripped_as_the_pattern_says(spark):
    points = [p for p in range(1, sys.maxunicode + 1) if not 0xD800 <= p < 0xE000]
    texts = spark.createDataFrame([(chr(p),) for p in points[:0x11000]], "c string")
    old = F.regexp_replace(F.concat("c", F.lit("x y"), "c"), r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    assert texts.where(old != S.strip(F.concat("c", F.lit("x y"), "c"))).isEmpty()


def test_plain_texts_are_read_like_odd_ones(spark):
    """A text of printable ASCII with single blanks takes a shorter way to the same lines."""
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "1", " ", "\n", "\t", "\r\n", "é", "2026-01-03", "1.00"][: 4 + 5 * (k % 2)]) for _ in range(rng.randrange(12))) for k in range(600)]
    t, ends = F.col("t"), F.lit(" \n")
    blanks = F.regexp_replace(F.regexp_replace(t, S.LINE_END, "\n"), r"(?U)[\s\x1c-\x1f&&[^\n]]+", " ")
    old = F.concat(F.lit(" "), F.regexp_replace(F.btrim(blanks, ends), r" ?\n[ \n]*", "\n "))
    assert spark.createDataFrame([(x,) for x in texts], "t string").where(old != extraction.plain(t)).isEmpty()


def test_scores_are_made_once_for_their_means(spark):
    """Means don't filter by a score, as that made each score a second time."""
    plan = plan_of(queries.engine_summary(spark, SF))
    assert plan.count("_cers(") == plan.count("_wers(") == 1 and "levenshtein" not in plan


def test_edits_of_long_texts(spark):
    rng = random.Random(3)
    plain = lambda a, b: _table(a, b)[-1]
    for _ in range(300):
        a, b = ("".join(rng.choice("ab c") for _ in range(rng.randrange(20))) for _ in range(2))
        assert scoring.word_edits(a, b) == scoring.word_edits(b, a) == plain(a, b)
    # 60,000 characters: the whole table would have 3.6e9 cells
    long = "".join(rng.choice("abcdefgh ") for _ in range(60_000)).strip()
    pred = "x" + long[1:20_000] + long[20_001:-1] + "x"
    rows = spark.createDataFrame([(pred, long), ("", ""), ("a", None), ("a", ""), ("abcd", "ab")], "p string, t string")
    assert [r.c for r in rows.select(scoring.cer(F.col("p"), F.col("t")).alias("c")).collect()] == [3 / len(long), 0.0, None, 1.0, 1.0]


def _table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row


def test_pages_are_dealt_and_quieted_together(spark):
    """A file of suppliers is one piece; pages of one size share their steps, and come out as each does alone."""
    assert render.pages(spark, SF).rdd.getNumPartitions() >= 4
    rng = np.random.default_rng(2)
    images = [rng.integers(0, 256, size).astype(np.uint8) for size in ((24, 40, 3), (9, 5), (24, 40, 3), (24, 40, 1), (1, 1), (9, 5))]
    for pixels, (pages, angle) in zip(images, imaging.stages_of(images), strict=True):
        alone, turned = imaging.stages(pixels)
        assert angle == turned and all((pages[s] == alone[s]).all() for s in imaging.STAGES)
    page = rng.integers(0, 40, (9, 12)).astype(np.uint8)
    wide = np.pad(page, 13, mode="symmetric").astype(float)
    patch = lambda y, x: wide[y + 10 : y + 17, x + 10 : x + 17]
    for y, x in ((0, 0), (4, 6), (8, 11)):
        near = [(dy, dx) for dy in range(-10, 11) for dx in range(-10, 11)]
        weights = [np.exp(-((patch(y, x) - patch(y + dy, x + dx)) ** 2).sum() / 4900) for dy, dx in near]
        mean = np.dot(weights, [wide[y + dy + 13, x + dx + 13] for dy, dx in near]) / sum(weights)
        assert abs(float(imaging.denoise(page)[y, x]) - mean) < 0.51


def test_ids_come_from_places_in_sorted_files(spark):
    """Rows are made once, though a sort looks at them twice, and no shuffle follows the sorted files."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def seen(k):
        made.add(1)
        return 7 * k % 1000

    rows = spark.range(0, 1000, 1, 6).select(seen.asNondeterministic()(F.col("id").cast("int")).alias("k"), F.lit("x").alias("item"))
    numbered = records.number(rows, ["k"], "t", after=5)
    assert sorted((r.k, r.id) for r in numbered.collect()) == [(k, k + 6) for k in range(1000)]
    assert made.value == 1000
    assert "hashpartitioning(_range" not in plan_of(numbered) and "Scan ExistingRDD" not in plan_of(numbered)


def test_tables_in_between_are_compressed(spark):
    """What is written to be read again is Parquet, smaller than the texts; a checkpoint is larger than them."""
    texts = queries.render_ledgers(spark, "/root/testdata/sf0.01")
    files = lineage.written(texts).inputFiles()
    assert files and sum(os.path.getsize(f.removeprefix("file://")) for f in files) < texts.agg(F.sum(F.octet_length("text"))).first()[0]


def test_landed_files_are_shared_by_tasks(spark, monkeypatch):
    """A batch takes two files; each is of several row groups, so that more than two tasks parse it."""
    folders = []

    def stop(_, folder, per_batch):
        folders.append((folder, per_batch))
        raise InterruptedError

    monkeypatch.setattr(landing, "landed_rows", stop)
    with pytest.raises(InterruptedError):
        workbench.landing_stream(spark, "/root/testdata/sf0.1")
    ((folder, per_batch),) = folders
    groups = [pq.ParquetFile(f"{folder}/{f}").metadata.num_row_groups for f in os.listdir(folder) if f.endswith(".parquet")]
    assert per_batch == 2 and groups and min(groups) > 1
