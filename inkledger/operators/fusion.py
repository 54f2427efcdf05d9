"""Alignment of two readings of a ledger and the choice of each field."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkledger.functions import semantics as S


def _met(rows: DataFrame, skeleton: str, values: str) -> DataFrame:
    """Rows (stem, engine, row_pos, fields) as (stem, engine, r, first, other): `first` says that a row is the skeleton's, `other` is its partner."""
    first = F.when(F.col("engine") == skeleton, True).when(F.col("engine") == values, False)
    both = rows.select("stem", "engine", F.struct("row_pos", *S.FIELDS).alias("r"), S.norm_date(F.col("date")).alias("nd"), first.alias("first"))
    met = lambda *keys: F.max(F.when(~F.col("first"), F.col("r"))).over(Window.partitionBy("stem", *keys))
    ranked = both.withColumn("k", F.row_number().over(Window.partitionBy("stem", "nd", "first").orderBy("r.row_pos")))
    # of other engines there is nothing to count
    dated = ranked.withColumn("size", F.count("first").over(Window.partitionBy("stem", "nd", "k"))).withColumn("other", F.when(F.col("size") > 1, met("nd", "k")))
    # rows with a partner by date are not numbered: they have no place among the rows left
    left = F.col("size") == 1
    j = F.when(left, F.sum(left.cast("int")).over(Window.partitionBy("stem", "first").orderBy("r.row_pos").rowsBetween(Window.unboundedPreceding, 0)))
    placed = dated.withColumn("j", j).withColumn("spare", F.when(left, met("j")))
    return placed.select("stem", "engine", "r", "first", F.coalesce("other", "spare").alias("other"))


def align_readings(rows: DataFrame, skeleton: str = "tesseract", values: str = "easyocr") -> DataFrame:
    """Each skeleton row (stem, row_pos, fields) with a partner struct `other`, null if there is none; of rows (stem, engine, row_pos, fields).

    The k-th row of a date meets the k-th of that date; of the rows left on both sides the
    j-th meets the j-th. Partners left over are dropped. Every window holds the ledger among
    its keys, so rows are dealt by ledger once at most, and not at all if they come so dealt.
    """
    known = rows.where(F.col("engine").isin(skeleton, values))
    return _met(known, skeleton, values).where("first").select("stem", "r.*", "other")


def _both(skeleton: DataFrame, values: DataFrame) -> DataFrame:
    side = lambda df, engine: df.select("stem", F.lit(engine).alias("engine"), "row_pos", *S.FIELDS)
    return side(skeleton, "tesseract").unionByName(side(values, "easyocr"))


def align(skeleton: DataFrame, values: DataFrame) -> DataFrame:
    """align_readings() of two sides (stem, row_pos, fields)."""
    return align_readings(_both(skeleton, values))


def choose_numeric(a: Column, b: Column, valid: Callable[[Column], Column]) -> Column:
    a, b = S.strip(a), S.strip(b)
    pick = lambda v, w: F.struct(v.alias("value"), F.lit(w).alias("winner"))
    return (
        F.when(a == b, pick(a, "agree")).when(valid(b), pick(b, "easyocr")).when(valid(a), pick(a, "tesseract"))
        .when(b != "", pick(b, "easyocr")).otherwise(pick(a, "tesseract"))
    )


def choose_date(a: Column, b: Column) -> Column:
    a, b = S.strip(a), S.strip(b)
    pick = lambda v, w: F.struct(v.alias("value"), F.lit(w).alias("winner"))
    return F.when(a == b, pick(a, "agree")).when(S.is_whole(b, S.DATE), pick(b, "easyocr")).otherwise(pick(a, "tesseract"))


def _chosen(rows: DataFrame) -> DataFrame:
    """Rows (fields, other and more) with the choice of each field: d, q, p and t, each (value, winner), and the item."""
    money, whole = (lambda v: S.is_whole(v, S.MONEY_VALUE)), (lambda v: S.is_whole(v, S.INT))
    other = lambda f: F.coalesce(F.col(f"other.{f}"), F.lit(""))
    c = rows.withColumns(
        {
            "d": choose_date(F.col("date"), other("date")),
            "q": choose_numeric(F.col("qty"), other("qty"), whole),
            "p": choose_numeric(F.col("price"), other("price"), money),
            "t": choose_numeric(F.col("total"), other("total"), money),
        }
    )
    full = (F.col("p.value") != "") & (F.col("t.value") != "")
    return c.withColumn("named", F.when(full, S.strip_trailing_numeric(F.col("item"))).otherwise(F.col("item")))


def fuse_readings(rows: DataFrame, skeleton: str = "tesseract", values: str = "easyocr") -> DataFrame:
    """(stem, row_pos, fields, date_source, qty_source, price_source, total_source), a row for each skeleton row of rows (stem, engine, row_pos, fields)."""
    return _chosen(align_readings(rows, skeleton, values)).select(
        "stem", "row_pos", F.col("d.value").alias("date"), F.col("named").alias("item"), F.col("q.value").alias("qty"), F.col("p.value").alias("price"),
        F.col("t.value").alias("total"), F.col("d.winner").alias("date_source"), F.col("q.winner").alias("qty_source"),
        F.col("p.winner").alias("price_source"), F.col("t.winner").alias("total_source"),
    )


def fuse(skeleton: DataFrame, values: DataFrame) -> DataFrame:
    """fuse_readings() of two sides (stem, row_pos, fields)."""
    return fuse_readings(_both(skeleton, values))


def with_fused(rows: DataFrame, skeleton: str = "tesseract", values: str = "easyocr") -> DataFrame:
    """Rows (stem, engine, row_pos, fields) and, as engine `fused`, those fused of the two engines' rows; each row is made once for both."""
    chosen = _chosen(_met(rows, skeleton, values).select("stem", "engine", "first", "r.*", "other"))
    row = lambda *of: F.struct(*[c.alias(n) for c, n in zip(of, ("engine", *S.FIELDS), strict=True)])
    own = row(F.col("engine"), *map(F.col, S.FIELDS))
    fused = row(F.lit("fused"), F.col("d.value"), F.col("named"), F.col("q.value"), F.col("p.value"), F.col("t.value"))
    return chosen.select("stem", "row_pos", F.explode(F.when(F.col("first"), F.array(own, fused)).otherwise(F.array(own))).alias("x")).select("stem", "x.engine", "row_pos", *[f"x.{f}" for f in S.FIELDS])
