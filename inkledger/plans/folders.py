"""Queries over folders of scans, texts and truth, written from the tables and read again; and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkledger.functions import semantics as S
from inkledger.plans.lineage import scratch
from inkledger.sources import files, render, sinks


def _little(n: int, size: int = 4) -> str:
    return n.to_bytes(size, "little").hex()


def bitmap(data: Column, height: int, width: int) -> Column:
    """A bitmap file of a page's bytes (blue, green, red, from the top), whose lines fill whole words of four bytes."""
    line = 3 * width
    if line % 4:
        raise ValueError("lines of three bytes a pixel that fill whole words are needed")
    head = "424d" + _little(54 + line * height) + _little(0) + _little(54) + _little(40) + _little(width) + _little(height) + _little(1, 2) + _little(24, 2) + _little(0) + _little(line * height) + 4 * _little(0)
    lines = [F.substring(data, F.lit(1 + y * line), F.lit(line)) for y in reversed(range(height))]
    return F.concat(F.unhex(F.lit(head)), *lines)


def _named(name: Column, content: Column) -> Column:
    return F.struct(name.alias("name"), content.cast("binary").alias("content"))


def _put(df: DataFrame, folder: str, *some: Column) -> None:
    rows = df.select(F.explode(F.array(*some)).alias("f")).select("f.*").where("name IS NOT NULL")
    sinks.write_files(rows, folder, "name", "content")


def scan_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans of suppliers' pages, among files that are no images or can't be decoded: what of each is read."""
    folder, k = scratch(spark), F.col("stem")
    name = lambda suffix: F.concat(F.lit("page "), k.cast("string"), suffix)
    scan = _named(name(F.when(k % 2 == 0, ".bmp").otherwise(".x.BMP")), bitmap(F.col("data"), render.HEIGHT, render.WIDTH))
    broken, other = _named(F.when(k % 3 == 0, name(F.lit("-broken.png"))), F.lit("no image")), _named(F.when(k % 5 == 0, name(F.lit(".txt"))), F.lit("a text"))
    _put(render.pages(spark, sf_dir), folder, scan, broken, other)
    pages = files.decoded_images(spark, folder)
    bytes_ = F.transform(F.sequence(F.lit(1), F.octet_length("data")), lambda i: F.conv(F.hex(F.substring("data", i, F.lit(1))), 16, 10).cast("bigint"))
    of = lambda c: F.aggregate(F.filter(bytes_, lambda b, i: i % 3 == c), F.lit(0).cast("bigint"), lambda a, b: a + b)
    found = files.image_files(spark, folder).select(F.col("stem").alias("_stem"), "name")
    both = pages.join(found, F.col("stem") == F.col("_stem"))
    return both.select("stem", "name", "height", "width", "channels", of(0).alias("blue"), of(1).alias("green"), of(2).alias("red"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, lines): the rows of ledger that each supplier delivered, in order."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    row = F.struct(
        "l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.format_string("%.2f", "l_extendedprice").alias("total"), F.col("l_quantity").cast("int").cast("string").alias("qty"),
    )
    return lines.groupBy(F.col("l_suppkey").alias("k")).agg(F.array_sort(F.collect_list(row)).alias("lines"))


def text_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of suppliers' ledgers as files, one of the two missing for every fourth: those of whole pairs, and the truth, stripped."""
    folder, k = scratch(spark), F.col("k").cast("string")
    body = F.array_join(F.transform("lines", lambda r: F.concat_ws(" ", r["date"], F.lit("é"), r["qty"], r["total"])), "\n")
    name = lambda suffix: F.concat(k, F.lit(suffix))
    second = F.when(F.col("k") % 4 != 0, name(".easyocr.txt"))
    _put(_orders(spark, sf_dir), folder, _named(name(".tesseract.txt"), F.concat(F.lit(" \n"), body, F.lit("\n"))), _named(second, F.concat(F.lit("two\r\n"), body)), _named(name(".csv"), body))
    read = files.engine_texts(spark, folder, ("tesseract", "easyocr"))
    truth = files.text_truth(spark, folder).select(F.regexp_replace("stem", r"\.tesseract$", "").alias("stem"), F.lit("truth").alias("engine"), "text").where("stem NOT LIKE '%.%'")
    return read.select("stem", "engine", "text").unionByName(truth)


def truth_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' rows as files of fields, some without rows: the rows, and the ledgers that have none."""
    folder = scratch(spark)
    cells = lambda r: F.concat_ws(",", r["date"], F.concat(F.lit('"say ""'), r["qty"], F.lit('"", twice"')), r["qty"], F.lit(""), r["total"])
    rows = F.when(F.col("k") % 7 == 0, "").otherwise(F.concat(F.array_join(F.transform("lines", cells), "\n"), F.lit("\n")))
    _put(_orders(spark, sf_dir), folder, _named(F.concat(F.col("k").cast("string"), F.lit("_fields.csv")), F.concat(F.lit("date,item,qty,price,total\n"), rows)))
    read, stems = files.field_truth(spark, folder)
    return stems.join(read, "stem", "left").select("stem", "row_pos", *S.FIELDS)


QUERIES = {f.__name__: f for f in (scan_folder, text_folder, truth_folder)}

_LINES = """
WITH r AS (SELECT l_suppkey AS k, strftime(l_shipdate, '%Y-%m-%d') AS date, CAST(CAST(trunc(l_quantity) AS INT) AS VARCHAR) AS qty, printf('%.2f', l_extendedprice) AS total, l_orderkey, l_linenumber FROM lineitem),
b AS (SELECT k, string_agg(concat_ws(' ', date, 'é', qty, total), chr(10) ORDER BY l_orderkey, l_linenumber, date, total, qty) AS body FROM r GROUP BY k)
"""
ORACLES = {
    "scan_folder": f"""
WITH p AS (SELECT s_suppkey AS k, i // {render.WIDTH} AS y, i % {render.WIDTH} AS x FROM supplier, range({render.HEIGHT * render.WIDTH}) t(i)),
c AS (SELECT k, x, y, CASE WHEN (y // 4 + k) % 3 = 0 AND x BETWEEN 6 AND 33 AND (x * 7 + y * 5 + k) % 4 <> 0 THEN 30 + (x + k) % 20 ELSE 200 + (x * 3 + y * 7 + k) % 40 END AS blue FROM p)
SELECT 'page ' || k || CASE WHEN k % 2 = 0 THEN '' ELSE '.x' END AS stem, 'page ' || k || CASE WHEN k % 2 = 0 THEN '.bmp' ELSE '.x.BMP' END AS name,
       {render.HEIGHT} AS height, {render.WIDTH} AS width, 3 AS channels, CAST(sum(blue) AS BIGINT) AS blue, CAST(sum(blue - x % 3) AS BIGINT) AS green, CAST(sum(blue - (y % 2) * 5) AS BIGINT) AS red
FROM c GROUP BY k""",
    "text_folder": _LINES + """SELECT CAST(k AS VARCHAR) AS stem, 'tesseract' AS engine, ' ' || chr(10) || body || chr(10) AS text FROM b WHERE k % 4 <> 0
UNION ALL SELECT CAST(k AS VARCHAR), 'easyocr', 'two' || chr(13) || chr(10) || body FROM b WHERE k % 4 <> 0 UNION ALL SELECT CAST(k AS VARCHAR), 'truth', body FROM b""",
    "truth_folder": _LINES + """SELECT CAST(k AS VARCHAR) AS stem, CAST(row_number() OVER (PARTITION BY k ORDER BY l_orderkey, l_linenumber, date, total, qty) - 1 AS INT) AS row_pos,
       date, 'say "' || qty || '", twice' AS item, qty, '' AS price, total FROM r WHERE k % 7 <> 0
UNION ALL SELECT DISTINCT CAST(k AS VARCHAR), NULL::INT, NULL, NULL, NULL, NULL, NULL FROM r WHERE k % 7 = 0""",
}
