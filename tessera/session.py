"""Session defaults and the one way in which this library cuts lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings used where this library makes the session itself (tests, bench).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tessera")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a folder is made and set on a single machine
    (master ``local``); on a cluster, whose executors would each write to a disk of
    their own, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not _one_machine(master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of a cluster, for sessions that do not install it on every machine."""
    root = Path(__file__).resolve().parent
    if _one_machine(spark.sparkContext.master):
        return
    archive = Path(tempfile.mkdtemp(prefix="tessera-ship-")) / "tessera.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))


def remove(spark: SparkSession, path: str) -> None:
    """Takes a folder of the shared folder away; nothing happens if the session or the folder is gone."""
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:
        pass


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Takes a folder of the shared folder away when the driver's interpreter ends."""
    atexit.register(remove, spark, path)


def cut(df: DataFrame, name: str = "cut", by: list[str] | None = None, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    A written table survives the loss of executors, keeps row counts and sizes
    for the planner, and is not computed again by later actions. ``by`` lays the
    rows out in one folder per value. ``instead_of`` is an earlier table of a loop
    that ``df`` was the last to read: it is removed as soon as ``df`` is written.
    The others are removed when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}-{os.getpid()}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    remove_at_exit(spark, path)
    if instead_of is not None:
        remove(spark, instead_of.__dict__["_written"])
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_written"] = path
    return out


#: Tables made once for a session: (application, name) to folder.
_STORED: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, name: str, write: Callable[[str], None]) -> DataFrame:
    """The table ``name`` of this session: ``write`` is given a folder the first time, afterwards it is read again.

    ``name`` must say what the table was made from, down to the state of its source.
    It is removed when the driver's interpreter ends.
    """
    key = (spark.sparkContext.applicationId, name)
    if key not in _STORED:
        path = f"{shared_folder(spark)}/tessera/stored-{uuid.uuid4().hex}-{os.getpid()}"
        write(path)
        remove_at_exit(spark, path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])
