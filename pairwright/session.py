"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "pairwright", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship_package(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster an unset
    folder is an error, because a machine-local path would lose data with its executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="pairwright-"))
    return context.getCheckpointDir()


#: Spark's setting by which shuffle files go when the query that made them has ended.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written copy.

    Parquet takes a fraction of the bytes of a checkpoint, whose rows are written as they lie in memory. The shuffle
    files of the write go with it, since nothing reads them again.
    """
    path = scratch_path(df.sparkSession, "cut")
    with dropped_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that end in here leave no shuffle files, which else stay until the driver collects its garbage."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def in_waves(spark: SparkSession, waves: int, key: str, made: Callable[[Callable[[DataFrame], DataFrame]], DataFrame]) -> DataFrame:
    """What ``made`` gives when its tables are cut to one part of the keys after the other; the parts are written.

    ``made`` gets the cut of a table by ``key``, of which each result row needs one value only. So what is shuffled
    at once has a bound. A single part is not written.
    """
    if waves <= 1:
        return made(lambda df: df)
    path = scratch_path(spark, "waves")
    with dropped_shuffles(spark):
        for wave in range(waves):
            part = made(lambda df, wave=wave: df.where(F.pmod(F.xxhash64(F.lit(waves), key), F.lit(waves)) == wave))
            part.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(part.schema).parquet(path)


_WRITTEN: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one written table."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the tables this program wrote below the shared folder; call it when their results are no longer read.

    Checkpoints go with ``spark.cleaner.referenceTracking.cleanCheckpoints``. Returns the number of tables.
    """
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        done += bool(path.getFileSystem(hadoop).delete(path, True))
    return done


_SHIPPED: dict[str, bool] = {}


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, once per application.

    Spark distributes the archive itself; a cluster that already installs the package (or
    got it through ``--py-files``) does not need this.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="pairwright-ship-")) / "pairwright.zip"
        with zipfile.ZipFile(archive, "w") as bundle:
            for source in sorted(root.rglob("*.py")):
                bundle.write(source, str(source.relative_to(root.parent)))
        context.addPyFile(str(archive))
        _SHIPPED[context.applicationId] = True
    return spark
