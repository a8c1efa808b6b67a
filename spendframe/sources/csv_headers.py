"""Headers of CSV files, found by reading the beginning of each file only."""

from __future__ import annotations

import codecs
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

CHUNK_BYTES = 1 << 16
TASK_SCHEMES = {"file", "hdfs", "s3", "s3a", "s3n", "gs", "gcs"}  # what the tasks' file library opens
MAX_HEADER_BYTES = 1 << 20


def open_file(uri: str):
    """Stream of a file that Spark names by URI; compression goes by the name's ending."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_stream("/" + uri[5:].lstrip("/"))
    for spark_scheme in ("s3a://", "s3n://"):
        uri = uri.replace(spark_scheme, "s3://", 1) if uri.startswith(spark_scheme) else uri
    system, path = fs.FileSystem.from_uri(uri.replace(" ", "%20"))
    return system.open_input_stream(path)


def first_record(stream, encoding: str = "UTF-8") -> str | None:
    """The first record that is not blank, line breaks inside quotes included; null for a file without one."""
    decoder = codecs.getincrementaldecoder(encoding)("replace")
    text, quoted, taken, at = "", False, 0, 0
    while True:
        chunk = stream.read(CHUNK_BYTES)
        taken += len(chunk)
        text += decoder.decode(chunk, final=not chunk)
        if not at:
            text = text.removeprefix("\ufeff").lstrip("\r\n")
        while at < len(text):
            if text[at] == '"':
                quoted = not quoted  # a doubled quote inside quotes turns twice
            elif text[at] in "\r\n" and not quoted:
                return text[:at]
            at += 1
        if not chunk:
            return text or None
        if taken >= MAX_HEADER_BYTES:
            raise ValueError(f"no end of the header within {MAX_HEADER_BYTES} bytes")


def file_headers(spark: SparkSession, paths, encoding: str = "UTF-8") -> DataFrame:
    """(file, header) of all files of the paths and folders; a file without any record has no row.

    The files are listed as rows, and each task opens its files and reads up to the end of
    the first record, so the cost does not depend on the files' sizes.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, headers = [], []
            for path in batch.column("path").to_pylist():
                with open_file(path) as stream:
                    header = first_record(stream, encoding)
                if header is not None:
                    files.append(path)
                    headers.append(header)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(headers, pa.string())], names=["file", "header"])

    return spark.read.format("binaryFile").load(paths).select("path").mapInArrow(run, "file string, header string")


def scanned_headers(spark: SparkSession, paths, encoding: str = "UTF-8") -> DataFrame:
    """The same from a scan of all lines, for file systems that only Spark's readers can open; a header is one line then."""
    line = F.col("value") if encoding.upper() in ("UTF-8", "UTF8") else F.decode(F.col("value").cast("binary"), encoding)
    lines = spark.read.text(paths).select(
        F.regexp_replace(line, "^\ufeff", "").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("place"))
    firsts = lines.where("at = 0 and value <> ''").groupBy("path").agg(F.min_by("value", "place").alias("header"))
    return firsts.select(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("file"), "header")


def opened_by_tasks(spark: SparkSession, paths) -> bool:
    """Whether tasks can open all of the paths themselves."""
    usual = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return all((urlsplit(path).scheme or urlsplit(usual).scheme) in TASK_SCHEMES for path in ([paths] if isinstance(paths, str) else paths))


def header_groups(spark: SparkSession, paths, encoding: str = "UTF-8") -> DataFrame:
    """(header, files): the files of all paths and folders by their header."""
    found = file_headers if opened_by_tasks(spark, paths) else scanned_headers
    return found(spark, paths, encoding).groupBy("header").agg(F.array_sort(F.collect_list("file")).alias("files"))
