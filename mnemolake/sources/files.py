"""Folders of text files as document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemolake.functions import fixed
from mnemolake.functions.text import strip

NAME = r"([^/]+)$"


def _visible(path):
    """No hidden file or folder anywhere below the root."""
    return ~F.rlike(path, F.lit(r"/\.[^/]"))


def scan_text_corpus(
    spark: SparkSession, path: str, extensions=fixed.TEXT_EXTENSIONS, recursive: bool = True, metadata: dict | None = None
) -> tuple[DataFrame, DataFrame]:
    """Documents of a folder and the files that gave none (with a reason). One row per file."""
    glob = "*.{" + ",".join(extensions) + "}"
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter=glob)
    full = F.col("_metadata.file_path")
    rows = files.select(
        strip(F.col("value")).alias("text"),
        full.alias("path"),
        F.url_decode(F.regexp_extract(full, NAME, 1)).alias("filename"),
        F.lower(F.regexp_extract(full, r"\.([^./]+)$", 1)).alias("extension"),
        *[F.lit(v).alias(k) for k, v in (metadata or {}).items()],
    ).filter(_visible(F.col("path")))
    root = "/" + path.split("://", 1)[-1].strip("/") + "/"
    rows = rows.withColumn("relative_path", F.substring_index(F.url_decode("path"), root, -1))
    empty = F.col("text") == ""
    return rows.filter(~empty), rows.filter(empty).select("path", F.lit("empty text").alias("reason"))


def scan_file_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Name, extension, size and change time of every file; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        F.regexp_extract("path", NAME, 1).alias("filename"),
        F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extension"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified_at"),
        "path",
    )


def import_summary(docs: DataFrame) -> DataFrame:
    """What an import would bring: counts, bytes, extensions and metadata keys in one row.

    Names are counted, not listed: an import may have any number of files. ``import_names`` gives them.
    """
    keys = docs.select(F.explode_outer(F.map_keys("metadata")).alias("k")).filter("k is not null").distinct()
    listed = keys.agg(F.array_join(F.array_sort(F.collect_list("k")), "|")).scalar()
    return docs.agg(
        F.count("*").alias("document_count"),
        F.count("filename").alias("filename_count"),
        F.array_join(F.array_sort(F.collect_set("extension")), "|").alias("extensions"),
        F.sum(F.octet_length("text")).alias("total_text_bytes"),
    ).withColumn("metadata_keys", listed)


def import_names(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("filename").isNotNull()).select("filename").orderBy("filename")
