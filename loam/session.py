"""Session helpers: local sessions for tests, and tables that cut lineage."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and benches."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once an application, whatever their own path holds."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    home = Path(__file__).parent
    at = Path(tempfile.mkdtemp(prefix="loam-package-")) / "loam_package.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    sc.addPyFile(str(at))


#: Folders of applications on one machine that name none, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``, or else the context's checkpoint folder.

    Where neither is set a folder of this machine is used if the master is local (as in tests);
    on a cluster that is an error, for executors would write to disks of their own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and sc._jsc.sc().getCheckpointDir().isDefined() and sc.applicationId not in _own:
        named = sc._jsc.sc().getCheckpointDir().get()
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError(f"spark.checkpoint.dir is not set, and on {sc.master} no folder of one machine will do")
        if sc.applicationId not in _own:
            _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="loam-")
            sc.setCheckpointDir(_own[sc.applicationId])
        named = _own[sc.applicationId]
    return named.rstrip("/")


def written(df: DataFrame, partitions: int | None = None, instead_of: DataFrame | None = None) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it again.

    The result has no lineage, survives lost executors, and is compressed.
    The files go when the driver's process ends; those of ``instead_of``, a result of this function
    that nothing needs any more, go at once.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/loam-{os.getpid()}-{uuid.uuid4().hex}"
    (df if partitions is None else df.coalesce(partitions)).write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._loam_path = path
    old = getattr(instead_of, "_loam_path", None)
    if old in _written:
        _delete(_written.pop(old), old)
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's process ends."""
    path = f"{shared_dir(spark)}/loam-{os.getpid()}-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may already have ended
        pass


def forget() -> None:
    """Deletes the tables of :func:`written`."""
    while _written:
        path, spark = _written.popitem()
        _delete(spark, path)


atexit.register(forget)


#: Bytes of a table from which a scan in too few tasks is spread over the cores.
SPREAD = 2 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, if its files (a single row group, say) give less than half of that.

    Tables of many files or row groups, as any large one, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size >= SPREAD and 2 * df.rdd.getNumPartitions() < cores else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of a data folder."""
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
