"""Session construction and helpers that read the session's own settings."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tracequarry", cores: int | None = None) -> SparkSession:
    """A local session for tests and benches; on a cluster pass your own session to the operators."""
    cores = cores or os.cpu_count() or 4
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TQ_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Gives the package to the Python workers of all executors, once per application.

    Executors need not have it installed or on their path; the archive is served by the driver.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tracequarry_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tq-package-")
    archive = os.path.join(folder, "tracequarry.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(here):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(root, name)
                    z.write(path, os.path.join("tracequarry", os.path.relpath(path, here)))
    sc.addPyFile(archive)
    sc._tracequarry_shipped = True
    atexit.register(shutil.rmtree, folder, True)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only a local master may do without (tests): it gets a temporary folder. On a cluster a folder of one machine would hold
    part of every table, so a missing setting raises.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not is_local(sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tq-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def is_local(master: str) -> bool:
    """One JVM: local, local[n], local[n,m]; local-cluster has executors of its own."""
    return master == "local" or master.startswith("local[")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: the lineage ends here and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame) -> DataFrame:
    """The rows written as a table in the shared checkpoint folder and read again: as safe as ``cut`` but columnar.

    The table is removed when the application ends, or at the end of a ``released`` block.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _staged.setdefault(id(spark.sparkContext), []).append(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


_staged: dict[int, list[str]] = {}


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone by then
        pass


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Removes the tables staged within the block when it ends: for results that were written or collected in it."""
    own = _staged.setdefault(id(spark.sparkContext), [])
    before = len(own)
    try:
        yield
    finally:
        for path in own[before:]:
            _remove(spark, path)
        del own[before:]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test or production table by name."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
