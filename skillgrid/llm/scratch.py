"""Lineage cuts: tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_PATH = "_skillgrid_path"
#: Spark's own setting; the files of a write's shuffles otherwise stay until the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. In local mode it may be unset; then one of our own is used."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="skillgrid-")
    return _own[app]


def cut(df: DataFrame) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: what follows never runs its plan
    again, survives lost executors, and knows its size. The files live as long as that folder does, since
    lazily evaluated results still read them. What was shuffled for the table is deleted when it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skillgrid-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    return out


def drop(df: DataFrame) -> None:
    """Deletes the files of a table that cut() wrote and that nothing lazily evaluated reads any more, such as one that
    a later table was made from."""
    path = getattr(df, _PATH, None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of a narrow table that may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def join_narrow(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Joins with a table of a few numbers a row that was cut before: where its counted rows are few, wide
    rows of `left` needn't be shuffled."""
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, on, how)


def quoted(names: list[str]) -> list[str]:
    """Column names as select() takes them, whatever characters they hold."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def without_names(names: list[str], taken: tuple[str, ...]) -> list[str]:
    """The names, quoted, less those that new columns take."""
    return quoted([n for n in names if n.lower() not in taken])
