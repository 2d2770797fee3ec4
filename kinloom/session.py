"""Session helpers: reliable intermediate tables that every executor can read."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEPT: list[tuple[SparkSession, str, str]] = []  # session, name, path


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a temporary one on a local master; elsewhere an error,
    as no other machine could read it."""
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="kinloom-"))
    return spark.sparkContext.getCheckpointDir()


def tables() -> int:
    """How many tables have been written so far; for ``release``."""
    return len(_KEPT)


def release(since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete the tables written after ``since`` (of ``tables``), but for those with a name in ``keep``.

    For a job whose results have been written or no longer need them; the others go when the process ends.
    """
    mine = _KEPT[since:]
    _KEPT[since:] = [t for t in mine if t[1] in keep]
    for spark, name, path in mine:
        if name not in keep:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the JVM may be gone already; the folder is a scratch folder
        pass


atexit.register(release)


def shelve(df: DataFrame, name: str, slim: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back: lineage ends here.

    Unlike ``localCheckpoint`` the rows survive the loss of any executor. ``slim`` rows (ids and numbers) that many
    tasks make are gathered into files of the size that adaptive execution advises, instead of one file a task.
    """
    spark = df.sparkSession
    df = df.hint("rebalance") if slim else df
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _KEPT.append((spark, name, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
