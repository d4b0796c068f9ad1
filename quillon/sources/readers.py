"""Readers: rasters, JSON manifests, JSONL ledgers, masks, change lists. Bad input becomes reject rows, not failed jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Media types by extension.
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "mp4": "video/mp4", "mov": "video/quicktime", "json": "application/json"}


def read_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rasters: path, height, width, channels, bgr; rejects: path). Pixels are rows of BGR bytes, top row first."""
    raw = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    good = raw.where("height > 0 AND width > 0")
    return good.select(F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("channels"), F.col("data").alias("bgr")), raw.where("height <= 0 OR width <= 0").select(F.col("origin").alias("path"))


def image_pixels(images: DataFrame) -> DataFrame:
    """One row for each pixel: path, y, x, b, g, r (bytes 0..255); a single channel is repeated."""
    n = F.col("height") * F.col("width")
    at = images.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    byte = lambda k: F.conv(F.hex(F.substring("bgr", F.col("pos") * F.col("channels") + k + 1, F.lit(1))), 16, 10).cast("int")
    pick = lambda k: F.when(F.col("channels") >= 3, byte(k)).otherwise(byte(0))
    return at.select("path", F.floor(F.col("pos") / F.col("width")).cast("int").alias("y"), (F.col("pos") % F.col("width")).alias("x"), pick(0).alias("b"), pick(1).alias("g"), pick(2).alias("r"))


def mask_pixels(images: DataFrame, threshold: int = 127) -> DataFrame:
    """The foreground pixels (path, y, x) of grey masks: those above the threshold."""
    return image_pixels(images).where(F.col("g") > threshold).select("path", "y", "x")


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON documents, one a file, held to the schema: any mismatch fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_documents_leniently(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """As read_documents, with nulls for what does not parse."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def read_ledger(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(events, rejects: line) of a ledger with a JSON event a line; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = lines.select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e"))
    return parsed.where("e IS NOT NULL AND e._corrupt IS NULL").select("e.*").drop("_corrupt"), parsed.where("e IS NULL OR e._corrupt IS NOT NULL").select(F.col("value").alias("line"))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, bytes and sha256 of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_files(declared: DataFrame, found: DataFrame) -> DataFrame:
    """Declared files (path, bytes, sha256) that are missing or differ: path, reason."""
    both = declared.join(found.select("path", F.col("bytes").alias("_b"), F.col("sha256").alias("_s")), "path", "left")
    why = F.when(F.col("_b").isNull(), "missing").when(F.col("_b") != F.col("bytes"), "size").when(F.col("_s") != F.col("sha256"), "hash")
    return both.select("path", why.alias("reason")).where("reason IS NOT NULL")


def media_type(path: Column) -> Column:
    """MIME type by extension."""
    known = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("application/octet-stream"))


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """status and path of a tab-separated change list; a rename has its new path."""
    parts = F.split("value", "\t")
    return spark.read.text(path).where("value <> ''").select(F.substring(parts[0], 1, 1).alias("status"), F.element_at(parts, -1).alias("path"))
