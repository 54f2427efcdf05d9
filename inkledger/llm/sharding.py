"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, pieces_of, starts_of, table


def _score(key: Column, shard: Column, weight: Column) -> Column:
    """-weight / ln(u) with u in (0, 1) from a hash of key and shard; the largest score takes the record."""
    u = (F.shiftrightunsigned(F.xxhash64(key, shard), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -weight / F.log(u)


def bid(key: Column, shard: Column, weight: Column) -> Column:
    return F.struct(_score(key, shard, weight).alias("s"), shard.alias("j"))


def winner(key: Column, weights: list[float]) -> Column:
    """(s, j) of key's shard: of the (score, shard) pairs the greatest, so equal scores go to the larger number. The expression is as short for many shards."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), lambda j: bid(key, j, w[j])))


def shard_records(docs: DataFrame, key: str = "doc_id", shards: int = 24, weights: list[float] | None = None, salt: tuple[str, ...] = ("text",), pieces: int | None = None) -> DataFrame:
    """Give each row `shard`, `grown_shard` (with one more shard of weight 1) and `slot`.

    The key's text and the weights alone decide the shard: equal keys share one, null keys
    too (a null counts as a key of its own, unlike the text "null"). Every key keeps its
    shard or moves into the new one when a shard is added.

    `slot` numbers the rows of a shard from 0 without gaps, by (hash, key): each shard is cut
    into pieces by a hash of key and salt columns, the pieces are counted before the shuffle,
    and rows are numbered inside a piece. Rows alike in key and salt are interchangeable.
    Empty tables give no rows; columns of docs called shard, slot or grown_shard are replaced.
    """
    weights = list(weights or [1.0] * shards)
    if len(weights) != shards or min(weights) <= 0:
        raise ValueError("one positive weight for each shard is needed")
    k = F.coalesce(F.concat(F.lit("k"), F.col(f"`{key}`").cast("string")), F.lit("null"))
    docs = docs.drop("shard", "slot", "grown_shard")
    top, best, grown, piece, order, start = fresh(docs, "_top", "_best", "_grown", "_piece", "_order", "_start")
    pieces = pieces or pieces_of(docs)
    if pieces & (pieces - 1):
        raise ValueError("the number of pieces is a power of two")
    more = bid(k, F.lit(shards), F.lit(1.0))
    placed = docs.withColumn(top, winner(k, weights)).withColumns({best: F.col(top)["j"], grown: F.greatest(F.col(top), more)["j"]}).drop(top)
    placed = placed.withColumn(order, F.xxhash64(F.lit("slot"), k, *[F.col(f"`{c}`") for c in salt]))
    # by its first bits, so that the order doesn't depend on the number of pieces
    placed = placed.withColumn(piece, F.shiftrightunsigned(order, 64 - pieces.bit_length() + 1))
    counts = placed.groupBy(best, piece).agg(F.count("*").alias("n"))
    starts = starts_of(counts, best, piece, "n", start)
    within = F.row_number().over(Window.partitionBy(best, piece).orderBy(order, k))
    keep = [c for c in docs.columns]
    return placed.join(starts, [best, piece]).select(
        *[F.col(f"`{c}`") for c in keep],
        F.col(best).cast("int").alias("shard"),
        (F.col(start) + within - 1).cast("long").alias("slot"),
        F.col(grown).cast("int").alias("grown_shard"),
    )


def op10_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = shard_records(docs, salt=("text_crc32",))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
