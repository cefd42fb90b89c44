"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import shared_path

#: One word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SPREAD_BYTES = 3 << 20

_shipped: set[str] = set()


def store(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder: the table as it is read again, and its path."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` into the shared folder and read it again.

    Lost executors cost a task's work, not the table's: the files are outside them.
    """
    return store(df, label)[0]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table of the given folder; ``spread``: with a task for each core, however few row groups a small one has.

    A row group is read by one task. Where a whole table is hardly more than one, moving its rows costs less
    than working on their texts in one task; a table of ``SPREAD_BYTES`` a core or more is read as it lies.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if spread and size < cores * SPREAD_BYTES else df


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    folder = tempfile.mkdtemp(prefix="tidemark-")  # of the driver, which serves the file to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "tidemark_llm.zip")
    Path(path).write_bytes(held.getvalue())
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def map_arrow(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(work, schema)
