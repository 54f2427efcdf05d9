"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, fresh, pieces_of, starts_of, table

#: Sources in code point order, null last, weigh so much, over and over.
WEIGHTS = (5.0, 2.0, 1.0)
#: How the weight of each source moves over training, likewise in turn: w(t) is in proportion to 1 + slope * (2t - 1).
SLOPES = (-0.5, 0.0, 0.5)

#: Columns that mixing and its order make, instead of those of the same name.
MADE = ("source_size", "target", "taken", "positions", "position")


def words(text: Column) -> Column:
    """How many runs of other characters than ASCII white space the text has; null has none."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}|{SPACE}$", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACE))).cast("long")


def _targets(sizes: DataFrame, source: str, share: float, most: float, weights, slopes) -> DataFrame:
    """Rows (source, source_size, target, slope).

    Of share * all words each source is due min(most * its size, level * its weight). The
    level is found by sorting the sources by most * size / weight: those below it are full.
    There are as many rows as sources, and sources are few.
    """
    by_name = Window.partitionBy("_all").orderBy(source)
    by_fill = Window.partitionBy("_all").orderBy("fill", source)
    w = F.array(*[F.lit(float(x)) for x in weights])
    a = F.array(*[F.lit(float(x)) for x in slopes])
    ranked = sizes.withColumn("_all", F.lit(1)).withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.get(w, F.pmod("rank", F.lit(len(weights))))).withColumn("slope", F.get(a, F.pmod("rank", F.lit(len(slopes)))))
    ranked = ranked.withColumn("limit", most * F.col("source_size")).withColumn("fill", F.col("limit") / F.col("weight"))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_all")
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    levels = ranked.withColumn("demand", share * F.sum("source_size").over(whole)).withColumn(
        "level", (F.col("demand") - so_far("limit")) / (F.sum("weight").over(whole) - so_far("weight"))
    )
    # the first source in order of fill that the level of the rest doesn't fill sets the level
    level = F.min(F.when(F.col("level") < F.col("fill"), F.struct("fill", "level"))).over(whole)["level"]
    return levels.withColumn("at", level).select(
        source, "source_size", F.least("limit", F.coalesce(F.col("at") * F.col("weight"), "limit")).alias("target"), "slope"
    )


def position(taken: Column, target: Column, slope: Column) -> Column:
    """When, from 0 to 1, a source has asked for so many words: the inverse of target * (t + slope * (t * t - t))."""
    u = F.when(target > 0, F.least(F.greatest(taken / target, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    b = 1 - slope
    # of the two forms of the root, the one that has no difference of near numbers, and holds for slope 0
    return F.when(u <= 0, F.lit(0.0)).otherwise(2 * u / (b + F.sqrt(b * b + 4 * slope * u)))


def mix(docs: DataFrame, size: str, source: str = "source", key: tuple[str, ...] = ("doc_id",), share: float = 1.5, most: float = 2.0, weights=WEIGHTS, slopes=SLOPES, pieces: int | None = None, whole: bool = False) -> DataFrame:
    """Give each row source_size, target, taken and positions.

    A source's words are laid end to end in an order that a hash of the key columns gives
    (ties by the columns themselves; rows alike in all are interchangeable), and as often
    again as the target asks. A row is taken for the words of its stretches that lie before
    the target; with `whole` a stretch counts, in full, if its middle lies before it.
    `positions` holds for each stretch taken the time in training at which the source's
    schedule has asked for the words before it. Rows without words are never taken, but
    with `whole` they have a position as if they held a word's middle there.

    `source` null is a source of its own. Empty tables give no rows. Columns of docs that
    bear the new names are replaced.
    """
    if any(not -1 < x < 1 for x in slopes):
        raise ValueError("slopes lie between -1 and 1")
    docs = docs.drop("source_size", "target", "taken", "positions")
    pieces = pieces or pieces_of(docs)  # no task sums a whole source
    if pieces & (pieces - 1):
        raise ValueError("the number of pieces is a power of two")
    h, piece, before, c, src, limit = fresh(docs, "_hash", "_piece", "_before", "_start", "_source", "_slope")
    keys = [F.col(f"`{x}`") for x in key]
    digest = F.md5(F.concat_ws("|", F.lit("mix"), *[x.cast("string") for x in keys]))
    d = docs.withColumn(h, F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    # by its first bits, so that the order is that of the hash into however many pieces it is cut
    d = d.withColumn(piece, F.shiftright(h, 60 - pieces.bit_length() + 1))
    d = d.withColumn(src, F.coalesce(F.concat(F.lit("0"), F.col(f"`{source}`")), F.lit("1")))  # null sorts last
    counts = d.groupBy(src, piece).agg(F.sum(size).alias("n"))
    targets = _targets(counts.groupBy(src).agg(F.sum("n").alias("source_size")), src, share, most, weights, slopes)
    starts = starts_of(counts, src, piece, "n", before).join(targets.withColumnRenamed("slope", limit), src)
    out = d.join(starts, [src, piece])
    run = Window.partitionBy(src, piece).orderBy(h, *keys).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn(c, F.col(before) + F.coalesce(F.sum(size).over(run), F.lit(0)))
    n = F.col(size)
    at = [F.col(c) + e * F.col("source_size") for e in range(int(-(-most // 1)))]
    if whole:
        # a row that would pass its limit of most times its size isn't taken once more
        some = [F.when(x + n / 2 < F.col("target"), n).otherwise(F.lit(0)) for x in at]
        used = [x + n / 2 < F.col("target") for x in at]
    else:
        some = [F.greatest(F.lit(0), F.least(n, F.floor("target") - x)) for x in at]
        used = [x > 0 for x in some]
    taken = sum(some[1:], some[0]).cast("long")
    # no schedule moves backwards: stretches come in the order of their words
    times = F.array(*[F.when(u, position(x.cast("double"), F.col("target"), F.col(limit))) for u, x in zip(used, at, strict=True)])
    return out.withColumn("taken", taken).withColumn("positions", F.array_compact(times)).drop(h, piece, before, c, src, limit)


def ordered(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row for each stretch taken, range-sorted by `position`."""
    at = mixed.drop("position").withColumn("position", F.explode("positions")).drop("positions")
    n = partitions or int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return at.repartitionByRange(n, "position").sortWithinPartitions("position")


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("size"), F.md5(F.col("text").cast("binary")).alias("text_hash"))
    mixed = mix(docs, "size", key=("doc_id", "text_hash")).withColumn("first_position", F.get("positions", F.lit(0)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    result = mixed.select("doc_id", "size", "source_size", "target", "taken", "first_position", F.size("positions").alias("times"))
    return result.repartitionByRange(n, F.col("first_position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("first_position").asc_nulls_last(), "doc_id")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('0' || source, '1') AS src,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(text) AS text_hash
  FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
r AS (SELECT *, row_number() OVER (ORDER BY src) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             CASE rank % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS slope,
             2.0::DOUBLE * source_size AS cap FROM r),
f AS (SELECT *, cap / weight AS fill, 1.5::DOUBLE * sum(source_size) OVER () AS demand FROM w),
l AS (SELECT *, (demand - coalesce(sum(cap) OVER (ORDER BY fill, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY fill, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
a AS (SELECT arg_min(level, fill) AS level FROM l WHERE level < fill),
t AS (SELECT src, source_size, least(cap, coalesce((SELECT level FROM a) * weight, cap)) AS target, slope FROM l),
h AS (SELECT d.*, CAST(('0x' || substr(md5(concat_ws('|', 'mix', CAST(doc_id AS VARCHAR), text_hash)), 1, 15)) AS BIGINT) AS h FROM d),
c AS (SELECT h.*, source_size, target, slope,
             CAST(coalesce(sum(size) OVER (PARTITION BY src ORDER BY h, doc_id, text_hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM h JOIN t USING (src)),
e AS (SELECT *, CAST(greatest(0, least(size, CAST(floor(target) AS BIGINT) - start)) AS BIGINT) AS one,
             CAST(greatest(0, least(size, CAST(floor(target) AS BIGINT) - start - source_size)) AS BIGINT) AS two,
             least(greatest(start / target, 0), 1) AS u FROM c)
SELECT doc_id, size, source_size, target, one + two AS taken,
       CASE WHEN one > 0 THEN CASE WHEN u <= 0 THEN 0.0 ELSE 2 * u / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * u)) END END AS first_position,
       CAST((one > 0)::INT + (two > 0)::INT AS INT) AS times
FROM e"""
