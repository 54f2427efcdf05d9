"""Two noisy readings of ledgers, rendered from order lines: one with whole lines, one with a token a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def truth_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stem, row_pos, fields) with the keys the noise depends on."""
    lines, part = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part"))
    # named before the window, so that what follows knows how rows are dealt and doesn't deal them again
    lines = lines.withColumnRenamed("l_orderkey", "stem")
    order = Window.partitionBy("stem").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    return lines.join(part, lines["l_partkey"] == part["p_partkey"]).select(
        "stem",
        (F.row_number().over(order) - 1).alias("row_pos"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        F.col("p_name").alias("item"),
        F.col("l_quantity").cast("int").cast("string").alias("qty"),
        F.format_string("%.2f", "p_retailprice").alias("price"),
        F.format_string("%.2f", "l_extendedprice").alias("total"),
        "l_partkey",
        "l_suppkey",
    )


def readings(truth: DataFrame) -> DataFrame:
    """(stem, engine, text)."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    date_a = F.when(p % 5 == 0, F.translate("date", "-", "/")).otherwise(F.col("date"))
    qty_a = F.when(p % 11 == 0, F.translate("qty", "5", "S")).otherwise(F.col("qty"))
    price_a = F.when(p % 7 == 0, F.translate("price", ".", "")).otherwise(F.col("price"))
    date_b = F.when(s % 17 == 0, F.concat(F.substring("date", 1, 9), F.lit("9"))).otherwise(F.col("date"))
    price_b = F.when(s % 6 == 0, F.translate("price", ".", ",")).otherwise(F.col("price"))
    line_a = F.concat_ws(" ", date_a, "item", qty_a, price_a, "total")
    line_b = F.when(s % 13 != 0, F.concat_ws("\n", date_b, "item", "qty", price_b, "total"))
    both = truth.groupBy("stem").agg(F.sort_array(F.collect_list(F.struct("row_pos", line_a.alias("a"), line_b.alias("b")))).alias("x"))
    joined = lambda side: F.array_join(F.col("x").getField(side), "\n")  # noqa: E731  nulls are passed over
    foot = F.when(F.col("stem") % 3 == 0, F.lit("\nThank you")).otherwise(F.lit(""))
    a = F.concat(F.lit("Shop ledger\nDate Item Qty Price Total\n"), joined("a"), foot)
    b = F.concat(F.lit("Ledger\n"), joined("b"))
    made = F.array(F.struct(F.lit("tesseract").alias("engine"), a.alias("text")), F.struct(F.lit("easyocr").alias("engine"), b.alias("text")))
    return both.select("stem", F.explode(made).alias("r")).select("stem", "r.*")


#: Size of the drawn pages.
HEIGHT, WIDTH = 24, 40


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stem, height, width, channels, data): for each supplier a small coloured page with dark strokes."""
    k, p = F.col("s_suppkey"), F.sequence(F.lit(0), F.lit(HEIGHT * WIDTH - 1))

    def pixel(i):
        y, x = F.floor(i / WIDTH), i % WIDTH
        stroke = ((F.floor(y / 4) + k) % 3 == 0) & x.between(6, 33) & ((x * 7 + y * 5 + k) % 4 != 0)
        blue = F.when(stroke, 30 + (x + k) % 20).otherwise(200 + (x * 3 + y * 7 + k) % 40)
        return F.concat(*[F.lpad(F.hex(c.cast("long")), 2, "0") for c in (blue, blue - x % 3, blue - (y % 2) * 5)])

    data = F.unhex(F.array_join(F.transform(p, pixel), ""))
    # drawing and reading a page takes long, and its key next to nothing: a file of keys is one piece, and is dealt to all
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k).repartition(n)
    return supplier.select(k.alias("stem"), F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"), F.lit(3).alias("channels"), data.alias("data"))
