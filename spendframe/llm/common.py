"""Shared helpers: table reading, kept intermediate tables, files in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remember, shared_dir

WORD = r"[^\x20\x09-\x0D]+"  # a word: anything between ASCII white space
SPACES = " \t\n\x0b\f\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """A text column, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the cluster's shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once into the shared folder and continue from its files, which outlive executors."""
    path = remember(new_folder(df.sparkSession, name))
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def groups_for(total: int | None, size: int) -> int:
    """How many groups of about ``size`` hold ``total``."""
    return max(1, -(-int(total or 0) // size))


def small_batches(batches: Iterable[pa.RecordBatch], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts have about ``size`` bytes; a longer text stays whole."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
            yield batch.take(pa.array(np.arange(at, stop)))  # a copy: some string kernels misread slices
            pa.default_memory_pool().release_unused()
            at = stop


def file_system(uri: str):
    """The pyarrow file system and path of a folder that Spark names by URI."""
    from pyarrow import fs

    for spark_scheme, scheme in (("s3a://", "s3://"), ("s3n://", "s3://")):
        uri = uri.replace(spark_scheme, scheme, 1) if uri.startswith(spark_scheme) else uri
    return fs.FileSystem.from_uri(uri)


def write_file(folder: str, name: str, data: bytes) -> None:
    """Write a whole file under its final name at once; a repeated task writes the same bytes again."""
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/_{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, f"{path}/{name}")
