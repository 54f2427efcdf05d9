"""Queries over files, reports, streams and pages, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkledger.functions import semantics as S
from inkledger.operators import engines, fusion, imaging, reports, scoring
from inkledger.plans import queries as Q
from inkledger.plans.lineage import scratch
from inkledger.sources import sinks
from inkledger.sources.render import pages
from inkledger.streaming import landing


def _side(texts: DataFrame, engine: str) -> DataFrame:
    return texts.where(F.col("engine") == engine).select("stem", "text")


def csv_roundtrip(spark, sf_dir):
    """Fused rows written as CSV and read again."""
    rows, path = Q.fuse_rows(spark, sf_dir), scratch(spark)
    names = ("stem", "row_pos", *S.FIELDS)
    sinks.write_csv(rows.withColumn("at", F.struct("stem", "row_pos")), path, order="at", by=None, fields=names)
    schema = "stem bigint, row_pos int, " + ", ".join(f"{f} string" for f in S.FIELDS)
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"').na.fill("")


def ledger_json(spark, sf_dir):
    return sinks.ledger_json(Q.fuse_rows(spark, sf_dir))


def side_by_side(spark, sf_dir):
    texts = Q.render_ledgers(spark, sf_dir)
    return reports.side_by_side(_side(texts, "tesseract"), _side(texts, "easyocr"))


def rate_table(spark, sf_dir):
    means = scoring.summary(scoring.rounded(Q.fusion_scores(spark, sf_dir)))
    return reports.rate_table(means, scoring.best(means))


def processed_fallback(spark, sf_dir):
    """Scans of orders, of which some have one or two cleaned ones."""
    k = F.col("o_orderkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").distinct()
    stem = F.concat(F.lit("scan_"), k.cast("string"))
    raw = orders.select(stem.alias("stem"), F.concat(F.lit("raw/"), stem, F.lit(".png")).alias("path"), F.lit(None).cast("binary").alias("content"))
    suffix = F.explode(F.when(k % 6 == 0, F.array(F.lit("png"), F.lit("tif"))).otherwise(F.array(F.lit("png"))))
    cleaned = orders.where(k % 3 == 0).select(F.concat(stem, F.lit("_clean")).alias("stem"), suffix.alias("suffix"))
    cleaned = cleaned.select("stem", F.concat(F.lit("clean/"), "stem", F.lit("."), "suffix").alias("path"), F.lit(None).cast("binary").alias("content"))
    return engines.with_cleaned(raw, cleaned).select("stem", "path", "clean_path")


def cached_texts(spark, sf_dir):
    """Ledgers whose second reading is missing for every fifth are read anew."""
    texts = Q.render_ledgers(spark, sf_dir)
    stems = texts.select("stem").distinct()
    cached, missing = engines.with_cache(stems, texts.where("engine = 'tesseract' OR stem % 5 <> 0"), Q.ENGINES[:2])
    return cached.unionByName(missing.withColumns({"engine": F.lit(None).cast("string"), "text": F.lit(None).cast("string")}))


def blank_row_default(spark, sf_dir):
    """The second reading's rows; ledgers without any have one blank row."""
    texts = Q.render_ledgers(spark, sf_dir)
    rows = Q.extract_fields(spark, sf_dir).where("engine = 'easyocr'").drop("engine")
    return engines.with_blank(rows, texts.select("stem").distinct())


def truth_semi_join(spark, sf_dir):
    """Scores of fusion of the ledgers that have truth, which every fourth lacks."""
    truth = Q.truth_rows(spark, sf_dir).where("stem % 4 <> 0")
    return engines.score_fusion(Q.render_ledgers(spark, sf_dir), truth, truth.select("stem").distinct())


def choose_numeric(spark, sf_dir):
    """Quantities against prices, texts that are valid numbers or not, with the winner of each."""
    rows = Q.truth_rows(spark, sf_dir)
    a, b = F.when(F.col("stem") % 3 == 0, F.lit("x")).otherwise(F.col("qty")), F.when(F.col("stem") % 4 == 0, "").otherwise(F.col("price"))
    made = rows.withColumn("c", fusion.choose_numeric(a, b, lambda v: S.is_whole(v, S.MONEY_VALUE)))
    return made.select("stem", "row_pos", "c.value", "c.winner")


def strip_trailing(spark, sf_dir):
    rows = Q.truth_rows(spark, sf_dir)
    noisy = F.concat_ws("  ", "item", F.when(F.col("stem") % 2 == 0, F.col("qty")), F.when(F.col("stem") % 3 == 0, F.col("price")))
    return rows.select("stem", "row_pos", S.strip_trailing_numeric(noisy).alias("item"))


def landing_stream(spark, sf_dir):
    """Readings landed as files, parsed by a stream in several batches."""
    folder, store, marks = scratch(spark), scratch(spark), scratch(spark)
    # a batch takes two files: short row groups let several tasks share one
    Q.render_ledgers(spark, sf_dir).write.option("parquet.block.size", 2 << 20).parquet(folder)
    landing.parse_landing(landing.landed_rows(spark, folder, per_batch=2), store, marks, once=True).awaitTermination()
    return spark.read.parquet(store).select("stem", "engine", "row_pos", *S.FIELDS)


def grey_levels(spark, sf_dir):
    return imaging.grey_levels(pages(spark, sf_dir)).select("stem", "levels.*")


def preprocess_chain(spark, sf_dir):
    """The cleaned page of every supplier: its angle, and how many pixels are black and white."""
    made = imaging.clean(pages(spark, sf_dir)).select("stem", "cleaned.*")
    page = F.hex("data")
    part = lambda v: (F.size(F.regexp_extract_all(F.regexp_replace(page, "(..)", "$1 "), F.lit(f"{v} "), F.lit(0)))).cast("long")
    return made.select("stem", "angle", "threshold", "height", "width", part("00").alias("n_black"), part("FF").alias("n_white"))


QUERIES = {
    f.__name__: f
    for f in (
        csv_roundtrip, ledger_json, side_by_side, rate_table, processed_fallback, cached_texts, blank_row_default, truth_semi_join,
        choose_numeric, strip_trailing, landing_stream, grey_levels, preprocess_chain,
    )
}

_CELLS = " || ',' || chr(10) || ".join(f"""'    "{f}": ' || CAST(to_json({f}) AS VARCHAR)""" for f in S.FIELDS)
_BODY = {
    "csv_roundtrip": "SELECT stem, row_pos, date, item, qty, price, total FROM fused",
    "ledger_json": f"""SELECT stem, '[' || chr(10) || string_agg('  {{' || chr(10) || {_CELLS} || chr(10) || '  }}', ',' || chr(10) ORDER BY row_pos) || chr(10) || ']' AS json
        FROM fused GROUP BY stem""",
    "side_by_side": """SELECT stem, CAST(n AS INT) AS line_pos, rpad(left(coalesce(l[n + 1], ''), 44), 44, ' ') || ' | ' || coalesce(r[n + 1], '') AS line
        FROM (SELECT *, unnest(range(greatest(len(l), len(r)))) AS n FROM (
          SELECT a.stem, string_split(a.text, chr(10)) AS l, string_split(rtrim(b.text, chr(10)), chr(10)) AS r
          FROM readings a JOIN readings b ON a.stem = b.stem AND a.engine = 'tesseract' AND b.engine = 'easyocr'))""",
    "rate_table": """SELECT CAST(CASE engine WHEN 'tesseract' THEN 0 WHEN 'easyocr' THEN 1 ELSE 2 END AS INT) AS place,
        rpad(engine, 12, ' ') || ' ' || lpad(printf('%.4f', c), 10, ' ') || ' ' || lpad(printf('%.4f', w), 10, ' ') || ' ' || lpad(CAST(n AS VARCHAR), 4, ' ')
        || CASE WHEN row_number() OVER (ORDER BY c, CASE engine WHEN 'tesseract' THEN 0 WHEN 'easyocr' THEN 1 ELSE 2 END) = 1 THEN '  <-- best' ELSE '' END AS line
        FROM (SELECT engine, avg(round_even(cer, 6)) AS c, avg(round_even(wer, 6)) AS w, count(*) AS n FROM scores GROUP BY engine)""",
    "cached_texts": "SELECT stem, engine, text FROM readings WHERE stem % 5 <> 0 UNION ALL SELECT DISTINCT stem, NULL, NULL FROM readings WHERE stem % 5 = 0",
    "blank_row_default": """SELECT stem, row_pos, date, item, qty, price, total, 'fused (tesseract + easyocr)' AS used_engine FROM extracted WHERE engine = 'easyocr'
        UNION ALL SELECT DISTINCT stem, 0, '', '', '', '', '', 'none (manual entry)' FROM readings WHERE stem NOT IN (SELECT stem FROM extracted WHERE engine = 'easyocr')""",
    "truth_semi_join": "SELECT stem, engine, round_even(cer, 6) AS cer, round_even(wer, 6) AS wer FROM scores WHERE stem % 4 <> 0",
    "choose_numeric": r"""SELECT stem, row_pos, CASE winner WHEN 'easyocr' THEN b ELSE a END AS value, winner FROM (
        SELECT stem, row_pos, a, b, CASE WHEN a = b THEN 'agree' WHEN regexp_full_match(b, '\d+\.\d{1,2}') THEN 'easyocr' WHEN regexp_full_match(a, '\d+\.\d{1,2}') THEN 'tesseract'
               WHEN b <> '' THEN 'easyocr' ELSE 'tesseract' END AS winner
        FROM (SELECT stem, row_pos, CASE WHEN stem % 3 = 0 THEN 'x' ELSE qty END AS a, CASE WHEN stem % 4 = 0 THEN '' ELSE price END AS b FROM truth))""",
    "strip_trailing": rf"""SELECT stem, row_pos, regexp_replace(regexp_replace(concat_ws(' ', item, CASE WHEN stem % 2 = 0 THEN qty END, CASE WHEN stem % 3 = 0 THEN price END), '\s+', ' ', 'g'), '((^|\s+)(\d+|{Q._MONEY}))+$', '') AS item FROM truth""",
    "landing_stream": "SELECT stem, engine, row_pos, date, item, qty, price, total FROM extracted",
}
ORACLES = {name: Q._CTES + body for name, body in _BODY.items()}
ORACLES["processed_fallback"] = """
SELECT stem, 'raw/' || stem || '.png' AS path, CASE WHEN k % 6 = 0 THEN 'clean/' || stem || '_clean.tif' WHEN k % 3 = 0 THEN 'clean/' || stem || '_clean.png' ELSE 'raw/' || stem || '.png' END AS clean_path
FROM (SELECT DISTINCT o_orderkey AS k, 'scan_' || CAST(o_orderkey AS VARCHAR) AS stem FROM orders)"""
ORACLES["grey_levels"] = """
WITH p AS (SELECT s_suppkey AS stem, i // 40 AS y, i % 40 AS x FROM supplier, range(960) t(i)),
b AS (SELECT stem, x, y, CASE WHEN (y // 4 + stem) % 3 = 0 AND x BETWEEN 6 AND 33 AND (x * 7 + y * 5 + stem) % 4 <> 0 THEN 30 + (x + stem) % 20 ELSE 200 + (x * 3 + y * 7 + stem) % 40 END AS blue FROM p),
g AS (SELECT stem, (299 * (blue - (y % 2) * 5) + 587 * (blue - x % 3) + 114 * blue + 500) // 1000 AS v FROM b),
h AS (SELECT stem, v, count(*) AS c FROM g GROUP BY ALL),
r AS (SELECT stem, v, CAST(sum(c) OVER o AS DOUBLE) AS dark, CAST(sum(c * v) OVER o AS DOUBLE) AS mass, CAST(sum(c) OVER w AS DOUBLE) AS n, CAST(sum(c * v) OVER w AS DOUBLE) AS total
      FROM h WINDOW o AS (PARTITION BY stem ORDER BY v ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY stem)),
s AS (SELECT *, CASE WHEN dark < n THEN (total * dark - n * mass) * (total * dark - n * mass) / (dark * (n - dark)) ELSE -1 END AS spread FROM r)
SELECT stem, CAST(any_value(n) AS BIGINT) AS n, CAST(any_value(total) AS BIGINT) AS total, CAST(min(v) AS INT) AS low, CAST(max(v) AS INT) AS high,
       CAST(arg_max(v, (spread, -v)) AS INT) AS threshold FROM s GROUP BY stem"""
