"""Session settings and the shared places a job may write to."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

SHARED = "spark.checkpoint.dir"


def build(app: str = "codelattice", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's setting; where none is set, a new local folder if all tasks run on this machine (tests),
    else an error, as a machine's own folder would be missed by the others."""
    at = spark.conf.get(SHARED, None) or spark.sparkContext.getConf().get(SHARED)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {SHARED} to a folder that all executors of {master} share")
        at = "file://" + tempfile.mkdtemp(prefix="codelattice-")
        spark.conf.set(SHARED, at)
    return at


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, with a new short lineage; losing an executor loses nothing."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


_OWN: dict[str, object] = {}


def own_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder, which ``discard`` deletes."""
    at = f"{shared_dir(spark)}/codelattice-{spark.sparkContext.applicationId}"
    if at not in _OWN:
        _OWN[at] = spark.sparkContext._jsc.hadoopConfiguration()
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back: an intermediate that several jobs read.  It lasts until ``discard`` or
    the end of the driver."""
    spark = df.sparkSession
    at = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


@atexit.register
def discard() -> None:
    """Deletes the intermediate tables written so far; call it when the results that read them are stored.  The end of the driver does."""
    for at, conf in list(_OWN.items()):
        del _OWN[at]
        with contextlib.suppress(Exception):  # the driver may be ending without its JVM
            path = SparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(conf).delete(path, True)


def threads() -> None:
    """One thread for linear algebra: tasks already fill the cores."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(name, "1")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the session's Python workers this package, once for an application."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="codelattice-")) / "codelattice_package.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(at))
    _SHIPPED.add(application)
