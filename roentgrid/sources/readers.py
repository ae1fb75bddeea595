"""Sources: typed readers for CSV, JSON, JSONL, map documents and image headers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schemas


def read_csv_table(spark: SparkSession, path: str, schema: str, line_breaks: bool = False) -> DataFrame:
    """CSV with a header line, columns cast while reading (ids stay strings).

    With ``line_breaks``, quoted fields may hold line breaks; a file is then read by one task.
    """
    return spark.read.schema(schema).csv(path, header=True, escape='"', multiLine=line_breaks, enforceSchema=False)


def read_json_docs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON arrays of documents; many files are read in parallel."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_jsonl(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST") -> DataFrame:
    """One JSON object per line; blank lines are skipped.

    FAILFAST stops at a bad line; PERMISSIVE keeps it in ``_corrupt_record`` together
    with its ``_file`` and byte-independent row text, for a quarantine table.
    """
    reader = spark.read.option("mode", mode)
    if mode.upper() == "PERMISSIVE":
        df = reader.schema(f"{schema}, _corrupt_record string").json(path)
        return df.withColumn("_file", F.col("_metadata.file_path"))
    return reader.schema(schema).json(path)


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, offset, line) of every line that is not an object of the schema.

    ``offset`` counts the lines in front of it in its file, however that is split: lines are
    numbered within each split, and the counts of earlier splits are added.
    """
    place = {"file": "file_path", "__split": "file_block_start"}
    lines = spark.read.text(path).select(
        *[F.col(f"_metadata.{m}").alias(c) for c, m in place.items()], F.monotonically_increasing_id().alias("__id"), F.col("value").alias("line")
    )
    splits = lines.groupBy(*place).agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("file").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(*place, "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    parsed = F.from_json("line", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    bad = lines.where((F.trim("line") != "") & parsed["_corrupt_record"].isNotNull()).join(splits, list(place))
    return bad.select("file", (F.col("__before") + F.col("__id") - F.col("__first")).alias("offset"), "line")


def read_location_docs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Per-image documents holding location -> box and location -> snippet maps."""
    return spark.read.schema(schemas.LOCATION_DOCS).format(fmt).load(path)


def explode_locations(docs: DataFrame, column: str, value: str) -> DataFrame:
    """One row per map entry: every other column, location and the value."""
    keep = [c for c in docs.columns if c not in ("location2bbox", "location2report_snippet")]
    return docs.select(*keep, F.explode(column).alias("location", value))


def png_size(content) -> Column:
    """struct(width, height) from PNG bytes; null for anything else."""
    c = F.col(content) if isinstance(content, str) else content

    def number(start):
        return F.conv(F.hex(F.substring(c, start, 4)), 16, 10).cast("int")

    size = F.struct(number(17).alias("width"), number(21).alias("height"))
    return F.when(F.hex(F.substring(c, 1, 8)) == "89504E470D0A1A0A", size)


def jpeg_size(content) -> Column:
    """struct(width, height) from JPEG bytes, found by walking the segment markers."""

    def walk(data):
        if data is None or data[:2] != b"\xff\xd8":
            return None
        i = 2
        while i + 9 < len(data):
            if data[i] != 0xFF:
                return None
            marker = data[i + 1]
            if marker == 0xFF:
                i += 1
            elif marker in (0x01, *range(0xD0, 0xD9)):
                i += 2
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                return (int.from_bytes(data[i + 7 : i + 9], "big"), int.from_bytes(data[i + 5 : i + 7], "big"))
            else:
                i += 2 + int.from_bytes(data[i + 2 : i + 4], "big")
        return None

    @F.pandas_udf("width int, height int")
    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [walk(x) or (None, None) for x in batch]
            yield pd.DataFrame(found, columns=["width", "height"]).astype("Int32")

    return sizes(F.col(content) if isinstance(content, str) else content)


def image_sizes(files: DataFrame, kind: str) -> DataFrame:
    """(image_path, width, height) of files(path, content); kind is png or jpg."""
    size = png_size("content") if kind == "png" else jpeg_size("content")
    return files.select(F.col("path").alias("image_path"), size.alias("s")).select("image_path", "s.width", "s.height")


def image_size_table(spark: SparkSession, folder: str, ext: str, saved: str | None = None) -> DataFrame:
    """Sizes of all images with an extension; written once to ``saved`` and reused."""
    if saved is not None:
        try:
            return spark.read.schema(schemas.IMAGE_SIZES).parquet(saved)
        except Exception as e:  # not written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext}").load(folder)
    kind = "png" if ext.lower() == "png" else "jpg"
    sizes = image_sizes(files, kind)
    if saved is None:
        return sizes
    sizes.write.mode("overwrite").parquet(saved)
    return spark.read.schema(schemas.IMAGE_SIZES).parquet(saved)


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    """Cached generations: missing text becomes '', path lists become arrays."""
    df = read_csv_table(spark, path, "predictions string, references string, image_paths string", line_breaks=True)
    df = df.na.fill("", ["predictions", "references"])
    return df.withColumn("image_paths", F.from_json("image_paths", "array<string>"))
