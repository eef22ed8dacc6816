"""File admission, object listings and object keys, from file metadata only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.text import display_title_from_file, file_extension, file_name, safe_file_name

# Fixed values.
ALLOWED_EXTENSIONS = ("azw3", "epub", "mobi", "pdf")
MAX_UPLOAD_MB = 500
UPLOAD_PREFIX = "ebooks"
DERIVED_PREFIX = "derived"


def read_file_listing(spark: SparkSession, path_glob: str) -> DataFrame:
    """Name, size and time of files; the content column is pruned, so no bytes are read."""
    return spark.read.format("binaryFile").load(path_glob).select(
        F.col("path").alias("object_name"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("last_modified")
    )


def reject_reason(object_name: Column, size_bytes: Column) -> Column:
    """Why a file is not admitted; NULL when it is."""
    extension, name = file_extension(object_name), file_name(object_name)
    shown = F.when(extension == "", "unknown").otherwise(extension)
    allowed = ", ".join(ALLOWED_EXTENSIONS)
    return (
        F.when(
            ~extension.isin(*ALLOWED_EXTENSIONS),
            F.concat(F.lit("Unsupported file type '"), shown, F.lit(f"'. Allowed types: {allowed}.")),
        )
        .when(size_bytes <= 0, F.concat(F.lit("'"), name, F.lit("' is empty.")))
        .when(
            size_bytes > MAX_UPLOAD_MB * 1024 * 1024,
            F.concat(F.lit("'"), name, F.lit(f"' exceeds the {MAX_UPLOAD_MB} MB upload limit.")),
        )
    )


def stage_files(listing: DataFrame) -> DataFrame:
    """Every listed file with its reject reason; accepted files have none."""
    return listing.withColumn("reason", reject_reason(F.col("object_name"), F.col("size_bytes")))


def list_objects(listing: DataFrame) -> DataFrame:
    """Staged cookbooks of a bare listing, newest first."""
    name = F.col("object_name")
    return listing.select(
        F.translate(name, "/", "-").alias("cookbook_id"),
        display_title_from_file(name).alias("title"),
        file_name(name).alias("filename"),
        name.alias("object_key"),
        F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
        F.lit("staged").alias("status"),
        F.col("last_modified").alias("uploaded_at"),
    ).orderBy(F.desc("uploaded_at"), F.asc("cookbook_id"))


def object_key(cookbook_id: Column, filename: Column, uploaded_on: Column) -> Column:
    return F.concat_ws(
        "/", F.lit(UPLOAD_PREFIX), F.date_format(uploaded_on, "yyyy/MM/dd"), cookbook_id.cast("string"), safe_file_name(filename)
    )


def image_key(cookbook_id: Column, recipe_id: Column, number: Column, filename: Column) -> Column:
    numbered = F.concat_ws("-", number.cast("string"), safe_file_name(filename))
    return F.concat_ws(
        "/", F.lit(DERIVED_PREFIX), cookbook_id.cast("string"), F.lit("recipes"), recipe_id.cast("string"), F.lit("images"), numbered
    )
