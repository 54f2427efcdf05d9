"""python -m inkledger clean|extract|fuse|compare ...: the batches over folders."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkledger.operators import engines, extraction, imaging, reports, scoring
from inkledger.sources import files, sinks

READINGS = ("tesseract", "easyocr")


def _engine(named: str) -> engines.Engine:
    """module:function, a function that builds a reader of images' bytes."""
    module, _, function = named.partition(":")
    return getattr(importlib.import_module(module), function)


def _show(means: DataFrame) -> None:
    """The table of rates; there are as many lines as engines."""
    print(f"{'Engine':<12} {'Mean CER':>10} {'Mean WER':>10} {'N':>4}", "-" * 40, sep="\n")
    for row in reports.rate_table(means, scoring.best(means)).orderBy("place").collect():
        print(row.line)


def clean(spark: SparkSession, args: argparse.Namespace) -> None:
    """Images to stem_clean.png; what can't be decoded is passed over, a missing folder is an error."""
    spark.read.format("binaryFile").load(args.input)  # for the error
    cleaned = imaging.clean(files.decoded_images(spark, args.input))
    sinks.write_files(cleaned.select(F.concat("stem", F.lit("_clean.png")).alias("name"), F.col("cleaned.png").alias("png")), args.output, "name", "png")


def extract(spark: SparkSession, args: argparse.Namespace) -> None:
    """Texts to rows, as CSV and as JSON, a folder for each text. Without texts the images are read by --values, if that is given."""
    live = None if args.values is None else lambda images: engines.read_images(images, READINGS[1], _engine(args.values))
    found, told = files.ledger_texts(spark, args.input, args.images or args.input, live)
    print(told)
    if found is None:
        return
    rows = engines.checkpoint(extraction.extract_fields(found))
    sinks.write_csv(rows, f"{args.output}/csv")
    sinks.write_json(rows, f"{args.output}/json")


def fuse(spark: SparkSession, args: argparse.Namespace) -> None:
    """Both readings (stem.engine.txt) to fused rows, and with truth to their scores."""
    texts = files.engine_texts(spark, args.input, READINGS)
    sinks.write_csv(engines.fuse_texts(texts), f"{args.output}/fused")
    if args.truth:
        scores = engines.checkpoint(engines.score_fusion(texts, *files.field_truth(spark, args.truth)))
        sinks.write_csv(scores, f"{args.output}/scores", order="stem", by=None, fields=("stem", "engine", "cer", "wer"))
        _show(scoring.summary(scores))


def compare(spark: SparkSession, args: argparse.Namespace) -> None:
    """Both readings against whole texts of truth: rates of each ledger, and means.

    With --skeleton and --values the images of the folder are read, the cleaned ones of
    --cleaned by the first; without them texts (stem.engine.txt) are compared.
    """
    truth = files.text_truth(spark, args.truth)
    if args.skeleton and args.values:
        raw, pixels = files.image_files(spark, args.input, strict=True), files.decoded_images(spark, args.input)
        cleaned = files.image_files(spark, args.cleaned or args.output)
        detail = engines.compare_images(raw, cleaned, truth, (READINGS[0], _engine(args.skeleton)), (READINGS[1], _engine(args.values)), pixels)
    else:
        texts = files.engine_texts(spark, args.input, READINGS)
        detail = scoring.score(texts, truth, texts.select("stem").distinct(), READINGS).withColumnRenamed("stem", "name")
    _show(sinks.write_comparison(detail, args.output))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="inkledger")
    known = {f.__name__: f for f in (clean, extract, fuse, compare)}
    parser.add_argument("batch", choices=known)
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--truth")
    parser.add_argument("--images", help="where images are, if not in the input folder")
    parser.add_argument("--cleaned", help="where cleaned images are, if anywhere")
    parser.add_argument("--skeleton", help="module:function of the engine that reads cleaned images")
    parser.add_argument("--values", help="module:function of the engine that reads raw images")
    args = parser.parse_args(argv)
    known[args.batch](SparkSession.builder.appName("inkledger").getOrCreate(), args)


if __name__ == "__main__":
    main()
