"""A content-addressed store of images: data URLs become files, each content once.

A file's name is the first 16 hexadecimal digits of the sha256 of the encoded image. A writer makes a file under a name of
its own and renames it, so a reader never sees part of one, and a task that runs again finds the file there. Files go
through the file system that the folder's URL names.
"""

from __future__ import annotations

import base64
import binascii
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import image_file
from .io import exists
from .shared import written

PREFIX = "^data:image/[^;,]*;base64,"


def encoded(url: Column) -> Column:
    """The encoded image of a data URL; null for any other URL, and for one without content."""
    return F.when(url.rlike(PREFIX + "."), F.regexp_replace(url, PREFIX, ""))


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def put(files: fs.FileSystem, path: str, content: bytes) -> bool:
    """Whether the file had to be written."""
    if files.get_file_info(path).type == fs.FileType.File:
        return False
    folder, _, name = path.rpartition("/")
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        out.write(content)
    files.move(own, path)
    return True


def write_images(encoded_images: DataFrame, folder: str) -> DataFrame:
    """file, written (false where it was there already) of the distinct images of the column ``image``. An image that is
    no base64 has no file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(folder)
        files.create_dir(root)
        for b in batches:
            names, new = [], []
            for name, image in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    content = base64.b64decode(image, validate=True)
                except (binascii.Error, ValueError):
                    continue
                names.append(name)
                new.append(put(files, f"{root}/{name}", content))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(new, pa.bool_())], names=["file", "written"])

    once = encoded_images.where("image is not null").groupBy(image_file(F.col("image")).alias("file")).agg(F.any_value("image").alias("image"))
    return once.mapInArrow(run, "file string, written boolean")


def offload(rows: DataFrame, url: str, folder: str) -> DataFrame:
    """``rows`` with data URLs replaced by the URLs of their files; other URLs, and images that are no base64, stay."""
    image = encoded(F.col(f"`{url}`"))
    done = written(write_images(rows.select(image.alias("image")), folder).select(F.col("file").alias("_file")))
    base = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    out = rows.withColumn("_image", image_file(image)).join(done, F.col("_image") == F.col("_file"), "left")
    return out.withColumn(url, F.when(F.col("_file").isNotNull(), F.concat(F.lit(base.rstrip("/") + "/"), F.col("_file"))).otherwise(F.col(f"`{url}`"))).drop("_image", "_file")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """file, content of the images of a folder, which comes into being with its first image."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "file string, content binary")
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
