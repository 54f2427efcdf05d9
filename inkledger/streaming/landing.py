"""Readings that land in a folder, parsed as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkledger.operators import extraction, imaging
from inkledger.plans.lineage import checkpoint as written
from inkledger.sources import files, sinks
from inkledger.sources.files import stem_of


def landed_texts(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """Stream of (stem, engine, text) of the files stem.engine.txt put into the folder; files without an engine have ''."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", per_batch).load(folder)
    name = stem_of(F.col("_metadata.file_name"))
    cut = lambda k: F.regexp_extract(name, r"^(.+?)(?:\.([^.]+))?$", k)
    return files.select(cut(1).alias("stem"), cut(2).alias("engine"), F.col("value").alias("text"))


def landed_rows(spark: SparkSession, folder: str, per_batch: int = 10) -> DataFrame:
    """Stream of (stem, engine, text) of Parquet files put into the folder."""
    schema = "stem bigint, engine string, text string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def parse_landing(stream: DataFrame, store: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append the rows of every text to the store, each text exactly once; with `once` stop when all that is there is done.

    A ledger is one row of the stream, and is parsed within it, so no state is kept and
    nothing is shuffled; late files are no different from others.
    """
    rows = extraction.extract_fields(stream)
    out = rows.writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start() if once else out.start()


#: Below the folder of cleaned images, what each batch put there; readers of images pass over it.
DONE = "_batches"


def clean_landing(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = False, per_batch: int = 100) -> StreamingQuery:
    """Clean images as they land: stem_clean.png in the folder out, and (stem, path, bytes, sha256) of each below out/_batches/batch=N.

    Each image is taken in one batch. A batch that is done again writes the same files and
    the same record of them, so each counts once. Of several images of one stem in a batch
    the last path's is cleaned; one of a later batch replaces it. What can't be decoded is
    passed over. The driver holds the paths of one batch, `per_batch` at most.
    """

    def each(batch: DataFrame, number: int) -> None:
        paths = [row.path for row in batch.select("path").collect()]
        if not paths:
            return
        last = files.decoded_paths(batch.sparkSession, paths).groupBy("stem").agg(F.max_by(F.struct("height", "width", "channels", "data", "path"), "path").alias("i")).select("stem", "i.*")
        made = written(imaging.clean(last).where("cleaned.png IS NOT NULL").select("stem", "path", F.concat("stem", F.lit("_clean.png")).alias("name"), F.col("cleaned.png").alias("png")))
        sinks.write_files(made, out, "name", "png")
        made.select("stem", "path", F.octet_length("png").alias("bytes"), F.sha2("png", 256).alias("sha256")).write.mode("overwrite").parquet(f"{out}/{DONE}/batch={number}")

    schema = "path string, modificationTime timestamp, length bigint, content binary"
    landed = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", files.IMAGE_GLOB).option("maxFilesPerTrigger", per_batch).load(folder)
    stream = landed.select("path").writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start() if once else stream.start()
