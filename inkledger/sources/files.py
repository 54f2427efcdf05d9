"""Ledgers as files: folders of images, of recognised texts, of truth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkledger.functions import semantics as S


def _any_case(suffix: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


IMAGE_GLOB = "*.{" + ",".join(map(_any_case, S.IMAGE_SUFFIXES)) + "}"


def _or_empty(read, schema: str, spark: SparkSession, strict: bool) -> DataFrame:
    """What read() gives; for a missing folder no rows, or with `strict` the error."""
    try:
        return read()
    except AnalysisException as e:
        if strict or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def file_name(path: Column) -> Column:
    return F.url_decode(F.replace(F.regexp_extract(path, "([^/]+)$", 1), F.lit("+"), F.lit("%2B")))


def stem_of(name: Column) -> Column:
    """The name without its last suffix; a name that only begins with a dot keeps it."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def image_files(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(path, name, stem, content) of the images directly in the folder. Other files' content is never read."""
    read = lambda: spark.read.format("binaryFile").option("pathGlobFilter", IMAGE_GLOB).load(path).select("path", "content")
    files = _or_empty(read, "path string, content binary", spark, strict)
    name = file_name(F.col("path"))
    return files.select("path", name.alias("name"), stem_of(name).alias("stem"), "content")


def decoded_images(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(stem, height, width, channels, data) of the folder's images, bytes in the order blue, green, red.

    What can't be decoded is left out; with `strict` such a file or a missing folder is an
    error. WebP isn't among the formats that the reader of this session decodes.
    """
    kind = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    read = lambda: spark.read.format("image").option("pathGlobFilter", IMAGE_GLOB).option("dropInvalid", not strict).load(path)
    files = _or_empty(read, f"image {kind}", spark, strict).select("image.*")
    if strict:
        bad = F.raise_error(F.concat(F.lit("not an image: "), "origin"))
        files = files.withColumn("height", F.when(F.col("height") < 0, bad.cast("int")).otherwise(F.col("height")))
    return files.select(stem_of(file_name(F.col("origin"))).alias("stem"), "height", "width", F.col("nChannels").alias("channels"), "data")


def decoded_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(stem, path, height, width, channels, data) of these images; what can't be decoded is left out."""
    some = spark.read.format("image").option("dropInvalid", True).load(paths).select("image.*")
    return some.select(stem_of(file_name(F.col("origin"))).alias("stem"), F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("channels"), "data")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(stem, text) of the folder's .txt files, each file one row."""
    read = lambda: spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    files = _or_empty(read, "name string, text string", spark, False)
    return files.select(stem_of(F.col("name")).alias("stem"), "text")


def text_truth(spark: SparkSession, path: str) -> DataFrame:
    return texts(spark, path).select("stem", S.strip(F.col("text")).alias("text"))


def engine_texts(spark: SparkSession, path: str, engines: tuple[str, ...]) -> DataFrame:
    """(stem, engine, text) of files named stem.engine.txt, of stems that have a file of every engine."""
    cut = F.regexp_extract("stem", r"^(.+)\.([^.]+)$", 1), F.regexp_extract("stem", r"^(.+)\.([^.]+)$", 2)
    named = texts(spark, path).select(cut[0].alias("stem"), cut[1].alias("engine"), "text").where(F.col("engine").isin(*engines))
    whole = named.groupBy("stem").agg(F.count("*").alias("n")).where(F.col("n") == len(engines)).select("stem")
    return named.join(whole, "stem", "left_semi")


def field_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows (stem, row_pos, fields), rows (stem) of all files): a file with a header only has truth, and no rows."""
    own = lambda name: F.regexp_replace(name, r"_fields\.csv$", "")
    listing = lambda: spark.read.format("binaryFile").option("pathGlobFilter", "*_fields.csv").load(path).select("path")
    stems = _or_empty(listing, "path string", spark, False).select(own(file_name(F.col("path"))).alias("stem"))
    schema = ", ".join(f"{f} string" for f in S.FIELDS)

    def cells() -> DataFrame:
        # a file of quoted line breaks is never split, so the counter runs in the order of its rows
        found = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', pathGlobFilter="*_fields.csv", enforceSchema=False)
        return found.select(F.col("_metadata.file_name").alias("name"), F.monotonically_increasing_id().alias("at"), *S.FIELDS)

    rows = _or_empty(cells, f"name string, at bigint, {schema}", spark, False)
    place = F.row_number().over(Window.partitionBy("name").orderBy("at")) - 1
    return rows.select(own(F.col("name")).alias("stem"), place.alias("row_pos"), *[F.coalesce(f, F.lit("")).alias(f) for f in S.FIELDS]), stems


def ledger_texts(spark: SparkSession, texts_path: str, images_path: str, read: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame | None, str]:
    """((stem, text), what was chosen): the folder's texts if there are any, else what `read` makes of the images, else nothing."""
    found = texts(spark, texts_path)
    if not found.isEmpty():
        return found, f"texts of {texts_path}"
    images = image_files(spark, images_path)
    if read is None or images.isEmpty():
        return None, f"nothing to do: no texts in {texts_path} and no images to read in {images_path}"
    return read(images).select("stem", "text"), f"no texts in {texts_path}: images of {images_path} are read"
