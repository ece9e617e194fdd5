"""Session set-up, and the two ways this library cuts lineage."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "basketry", master: str | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Call sites per Column operation cost more than planning small queries.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else one under the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
    if not warehouse:
        raise RuntimeError("Set spark.checkpoint.dir to a folder shared by all executors.")
    return f"{warehouse}/_shared"


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Delete everything this application has pinned or staged; call it once nothing reads it any more.

    What is left when the process ends is deleted then.
    """
    app = spark.sparkContext.applicationId
    for path in (*_PINS.pop(app, []), *([_STAGES.pop(app).root] if app in _STAGES else [])):
        remove(spark, path)


_PINS: dict[str, list[str]] = {}


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        with contextlib.suppress(Exception):  # the context may be gone already
            release(spark)


#: Compressed rows unfold to many times their bytes, so tasks of the default size make joins and aggregates of wide lines
#: spill; and a partitioned table is sorted before it is written unless its few folders are written side by side.
_HELD = "zstd"  # tables held between steps take a quarter less than with the default codec
_WIDE = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m", "spark.sql.maxConcurrentOutputFileWriters": "8"}


@contextlib.contextmanager
def wide_rows(spark: SparkSession):
    """Settings for jobs over wide rows, for the time of the block; what the session states itself holds."""
    unset = [key for key in _WIDE if spark.conf.get(key, None) is None]
    for key in unset:
        spark.conf.set(key, _WIDE[key])
    try:
        yield
    finally:
        for key in unset:
            spark.conf.unset(key)


def pin(df: DataFrame, wide: bool = False) -> DataFrame:
    """Compute ``df`` once into reliable storage and read it from there on.

    Needed wherever a later step relies on values that a recomputation may
    change, such as the row positions of a sampled range partitioning. Wide
    rows go to a columnar table, of which later steps read few columns; narrow
    ones to a checkpoint, which is quicker to set up.
    """
    spark = df.sparkSession
    if wide:
        path = f"{shared_folder(spark)}/basketry-pins/{uuid.uuid4().hex}"
        with wide_rows(spark):
            df.write.parquet(path, compression=_HELD)
        _PINS.setdefault(spark.sparkContext.applicationId, []).append(path)
        return spark.read.parquet(path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


class Stage:
    """Hand-off tables between pipeline steps: written once, read many times.

    A re-read table is column-pruned, partition-pruned and has file-size
    statistics, so Catalyst can choose broadcast joins by real size.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/basketry-{uuid.uuid4().hex}"
        self._paths: dict[tuple, str] = {}

    def table(self, key: tuple, build, partition_by: str | None = None) -> DataFrame:
        if key not in self._paths:
            path = f"{self.root}/{len(self._paths):03d}-{key[-1]}"
            with wide_rows(self.spark):
                writer = build().write.mode("overwrite")
                if partition_by:
                    writer = writer.partitionBy(partition_by)
                writer.parquet(path, compression=_HELD)
            self._paths[key] = path
        return self.spark.read.parquet(self._paths[key])


_STAGES: dict[str, Stage] = {}


def stage_of(spark: SparkSession) -> Stage:
    app = spark.sparkContext.applicationId
    if app not in _STAGES:
        _STAGES[app] = Stage(spark)
    return _STAGES[app]
