"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings that change results; safe to apply to any running session.
RESULT_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # A repeated JSON property is legal input and the last one wins.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


# Tasks that look up the names given to a reader; Spark's default makes a task of every name up to 10,000.
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTING_DEFAULT, LISTING_LEAST = "10000", 32


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings results depend on; sizing stays with the cluster.

    Only where nothing else was asked for, names are listed by few tasks: a stream lists those of each micro-batch with the settings of
    the session it was made in.
    """
    for key, value in RESULT_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    if spark.conf.get(LISTING_TASKS) == LISTING_DEFAULT:
        spark.conf.set(LISTING_TASKS, str(max(LISTING_LEAST, spark.sparkContext.defaultParallelism)))
    return spark


def local_session(cpus: str | int = "*", app: str = "fieldgauge", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Little data is still spread over all cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        # The JVM does not compile methods over 8000 bytes of code; better to split such stages.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # A long test run asks its status tracker for stages; by default records past 1,000 go, those of skipped stages first.
        .config("spark.ui.retainedStages", "100000")
        # Without a call-site lookup per expression, plans are built several times faster.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, named by the cluster in spark.checkpoint.dir.

    Only where no such folder is set (tests, one machine) is a temporary one made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        java_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = java_dir.get() if java_dir.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        folder = tempfile.mkdtemp(prefix="fieldgauge-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_scratch: dict[str, str] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, in this application's part of it, which goes when the application ends."""
    application = spark.sparkContext.applicationId
    if application not in _scratch:
        folder = f"{shared_folder(spark)}/fieldgauge-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _scratch[application] = folder
    return f"{_scratch[application]}/{label}-{uuid.uuid4().hex}"
