"""Reading tables, cutting lineage and linking components: what several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the line-noise-free kind: digits, ASCII letters (lower case) and every character beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What separates words that are only parted by ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    It is spark.checkpoint.dir; only where that is unset and Spark runs on one machine, as in
    tests, a temporary folder is taken.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from those files."""
    _shared(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession) -> str:
    """A new folder name that driver and executors share."""
    return f"{_shared(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df by way of a table in the shared folder, of which later reads take only the columns they need."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def pieces_of(df: DataFrame, least: int = 256, rows: int = 1 << 18) -> int:
    """Into how many pieces a source or shard is cut, so that a piece has about so many rows even where one holds all: a power of two."""
    total, n = df.count(), least
    while n * rows < total:
        n *= 2
    return n


def starts_of(counts: DataFrame, group: str, piece: str, n: str, start: str) -> DataFrame:
    """counts (group, piece, n) with `start`, the sum of n of the group's pieces before; there are no more rows than pieces."""
    before = Window.partitionBy(group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(group, piece, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))


def ascii_lower(col):
    """Lower-case A to Z and leave every other character alone."""
    return F.translate(col, UPPER, LOWER)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores put before it until no column of df has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the undirected links (a, b): rows (node, component), component the least node.

    Large-star and small-star rounds in turn. A round keeps at most as many links as it
    found, minima are combined before the shuffle, and each round is cut by a checkpoint.
    Nodes without a link to another node have no row.
    """
    links = checkpoint(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    state = None
    for _ in range(rounds):
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(floor, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = checkpoint(floor.select("u", F.col("m").alias("v")).unionByName(small).where("u <> v").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
