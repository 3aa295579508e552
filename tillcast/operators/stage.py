"""Staging tables: cut lineage by writing a frame to the shared checkpoint folder.

The enriched fact feeds about ten grouped passes. Writing it once as Parquet
under ``spark.checkpoint.dir`` (a folder every executor reaches) keeps each
later plan small, lets every pass read only its columns, and means a lost
executor re-reads files instead of recomputing the joins. What was shuffled on the way
is deleted as soon as the table is written. The tables of an
application are removed when its Python process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from tillcast.session import ensure_checkpoint_dir

_FOLDERS: set[str] = set()
# Spark then deletes the shuffle files of a write when it has ended, and not only when the
# driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _remove(jvm, conf, folder: str) -> None:
    """Deletes a folder wherever it lies."""
    with contextlib.suppress(Exception):  # the JVM may be gone by then
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def _file_system(spark: SparkSession) -> tuple:
    return spark._jvm, spark._jsc.hadoopConfiguration()


# Tables of intermediate steps, of each result that is being staged.
_STEPS: list[list[DataFrame]] = []


def step(df: DataFrame, name: str) -> DataFrame:
    """``df`` staged for one step of a result; deleted with :func:`stage_result` of it."""
    out = stage(df, name)
    if _STEPS:
        _STEPS[-1].append(out)
    return out


def stage_result(build, name: str, by: str | None = None) -> DataFrame:
    """``build()`` staged; the steps that were staged for it alone are deleted then."""
    _STEPS.append([])
    try:
        return stage(build(), name, by)
    finally:
        release(*_STEPS.pop())


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession):
    """What is executed within deletes its own shuffle files when it has ended."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stage(df: DataFrame, name: str, by: str | None = None, more: tuple[DataFrame, ...] = ()) -> DataFrame:
    """``df`` written and read back; with ``by``, a folder for each value of that column (see :func:`part`).
    ``more`` frames of the same columns are written after it, one at a time, so that only one's shuffle files lie on disk."""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    folder = f"{root}/tillcast-stage/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove, *_file_system(spark), folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    for f in (df, *more):
        writer = f.select(*[f"`{c}`" for c in df.columns]).write.mode("append").option("compression", "zstd")
        with shuffles_deleted(spark):
            (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns]) if by else spark.read.parquet(path)
    out._staged_path = path
    return out


def part(table: DataFrame, by: str, value: str) -> DataFrame:
    """The rows of one value of a table staged by ``by``, read from its own
    folder: the optimizer then knows its size. Other tables are filtered."""
    path = getattr(table, "_staged_path", None)
    if path:
        jvm, conf = _file_system(table.sparkSession)
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={value}")
        if folder.getFileSystem(conf).exists(folder):
            rest = [f for f in table.schema.fields if f.name != by]
            out = table.sparkSession.read.schema(type(table.schema)(rest)).parquet(f"{path}/{by}={value}")
            out._staged_path = f"{path}/{by}={value}"
            return out
    return table.where(table[by] == value).drop(by)


def release(*tables: DataFrame) -> None:
    """Deletes staged tables before the application ends, for callers that have
    written or collected all that reads them."""
    for df in tables:
        if getattr(df, "_staged_path", None):
            _remove(*_file_system(df.sparkSession), df._staged_path)
