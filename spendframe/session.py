"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def build_session(app: str = "spendframe", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the zone: cost dates are naive UTC, only offset-carrying text needs it."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a scratch folder only for a local session without one."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        if not context.getCheckpointDir():
            context.setCheckpointDir(configured)
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    scratch = tempfile.mkdtemp(prefix="spendframe-")
    context.setCheckpointDir(scratch)
    return scratch


_written: list[str] = []  # intermediate tables of this process that nothing has deleted yet


def remember(path: str) -> str:
    """Note a table or folder that only intermediate results need; the path."""
    _written.append(path)
    return path


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables that are written inside, at the end.

    What a job returns may still read them, so results are to be written or collected
    before the end. Outside of this, the tables stay until the shared folder is cleaned.
    """
    before = len(_written)
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for name in _written[before:]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
        del _written[before:]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from its files.

    The result survives executor loss. Unlike ``checkpoint()``, which runs the
    plan once to materialise and once more to write, this runs it once. See
    :func:`intermediate_tables` for the tables' end.
    """
    spark = df.sparkSession
    path = remember(f"{shared_dir(spark)}/table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """``cut_lineage`` and aggregates of the rows it writes, taken in the same pass."""
    seen = Observation()
    written = cut_lineage(df.observe(seen, *[value.alias(name) for name, value in metrics.items()]))
    return written, seen.get
