"""Spark session settings the operators rely on."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app_name: str = "syllabix", **conf: str) -> SparkSession:
    """Create (or reuse) a session with UTC time, ANSI casts and adaptive execution.

    Only semantic settings are fixed here. Cluster sizing (executors, shuffle
    partitions, memory) stays with the submitter; extra ``conf`` entries win.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only if the session names none.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used as
    is. The temporary folder is for local runs and tests.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current:
        return current
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="syllabix-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def pin(df: DataFrame) -> DataFrame:
    """Compute a table once into the shared checkpoint folder and continue from the files.

    For plans that read an intermediate table repeatedly. Files on shared storage
    outlive lost executors, unlike cached blocks, and give the planner true sizes.
    ``release_pinned`` or the context manager ``pinned_tables`` deletes them.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/pinned-{uuid.uuid4().hex}"
    _PINNED.append(folder)
    df.write.parquet(folder)
    pinned = df.sparkSession.read.schema(df.schema).parquet(folder)
    pinned.is_pinned, pinned.pinned_folder = True, folder
    return pinned


def is_pinned(df: DataFrame) -> bool:
    """Whether the table is what ``pin`` returned, with nothing done to it since."""
    return getattr(df, "is_pinned", False) is True


_PINNED: list[str] = []


def pinned_count() -> int:
    """Number of pinned tables, to release those made later."""
    return len(_PINNED)


def release_pinned(spark: SparkSession, after: int = 0, keep: Sequence[DataFrame] = ()) -> None:
    """Delete the files of pinned tables, but for the first ``after`` and those of ``keep``; results that still read them become invalid."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    kept = [df.pinned_folder for df in keep]
    for folder in _PINNED[after:]:
        if folder not in kept:
            path = hadoop.Path(folder)
            path.getFileSystem(settings).delete(path, True)
    _PINNED[after:] = [folder for folder in _PINNED[after:] if folder in kept]


@contextmanager
def pinned_tables(spark: SparkSession) -> Iterator[None]:
    """Tables pinned inside are deleted at the end: write or collect results before."""
    before = len(_PINNED)
    try:
        yield
    finally:
        release_pinned(spark, before)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into the session's shuffle partitions, and keep them.

    Used before rows multiply: adaptive execution would merge partitions that are
    still small here. It also breaks up the partition of a hot group.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Model solving and tail probabilities run in Python workers, which import the
    package; without an installed copy they get it as a zip file.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="syllabix-package-"), "syllabix")
    context.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package)))
    _SHIPPED.add(context.applicationId)
