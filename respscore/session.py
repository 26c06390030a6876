"""Session construction and the shared checkpoint folder.

On a cluster the session is built by the caller and ``spark.checkpoint.dir``
names a folder that every executor can reach; we only read it.  A folder of
our own is set only when the setting is absent (tests, local runs).
"""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A side is broadcast only when its measured size is below this bound;
    # otherwise the join stays a shuffle (sort-merge) join.
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.respscore.spread": "true",  # sources/fixtures.py: for tables of a few row groups
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "respscore", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with AQE and bounded broadcast on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of intermediate tables: the checkpoint folder that the session names.

    Executors of a cluster read each other's files there, so a machine-local folder is only ever made for a
    ``local`` master; on any other one a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or local_folder(sc.master)
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


def local_folder(master: str) -> str:
    """A folder of this machine, for a master that runs all tasks here."""
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir is not set: with master {master!r} it has to name a folder "
                           "that the driver and all executors share")
    return tempfile.mkdtemp(prefix="respscore-ckpt-")


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    One write pass (an unpersisted ``checkpoint()`` would compute the plan twice),
    columnar and compressed, and it survives executor loss: later stages
    restart from the table, not from the source text.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    table = spark.read.parquet(path)
    table.scratch_folder = path
    if made := getattr(_MADE, "lists", None):
        made[-1].append(table)
    return table


_MADE = threading.local()


@contextmanager
def temporary():
    """A list of the tables that ``cut_lineage`` makes in a block; those that are still in it at the end are removed.

    The block takes out (``kept``) what is read later.  Shuffle files of its finished steps go too.
    """
    made: list[DataFrame] = []
    _MADE.lists = [*getattr(_MADE, "lists", []), made]
    try:
        yield made
    finally:
        _MADE.lists = _MADE.lists[:-1]
    if made:
        discard(*made)
        release(made[0].sparkSession)


def kept(made: list[DataFrame], *tables: DataFrame) -> None:
    """Take tables out of a list of ``temporary``; a block around it gets them."""
    folders = {t.scratch_folder for t in tables}
    made[:] = [t for t in made if t.scratch_folder not in folders]
    if len(_MADE.lists) > 1:
        _MADE.lists[-2].extend(tables)


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``cut_lineage`` that nothing reads any more."""
    for table in tables:
        remove_folder(table.sparkSession, table.scratch_folder)


def discard_all(spark: SparkSession) -> None:
    """Remove every intermediate table of this session; for the end of a run."""
    remove_folder(spark, _scratch_root(spark))


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Ask the driver to collect garbage, so that Spark removes the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def subfolders(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders inside ``folder`` (none if it is not there)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []


@contextmanager
def conf_set(spark: SparkSession, key: str, value: str):
    """A session setting for the time of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _scratch_root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/respscore-io"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
