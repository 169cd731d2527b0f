"""Session helpers: settings the engine relies on and the shared work folder."""

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "docproof") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    parallelism = os.cpu_count() if cores == "*" else int(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Plans have thousands of expressions; noting the source line of each takes as long as the query.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parallelism))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


# What results depend on: UTC dates, and the last of two equal JSON keys wins.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.variant.allowDuplicateKeys": "true"}

# What only the time depends on. The JVM does not compile methods of more than 8,000 bytes, and the rules in one
# method are longer; sorted groups of lists need no tables that are given up after 128 groups.
TUNING = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.execution.useObjectHashAggregateExec": "false"}

# Shuffled files go when their query ends; otherwise they stay until the driver collects its garbage, which for a
# stream is after many batches.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

# States lie on the executors' disks, with this much memory for all of an executor's; by default they are all in its heap.
STATES_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings that what is started meanwhile goes by; afterwards the session is as it was."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def prepare(spark: SparkSession) -> SparkSession:
    """Give a session of our own the settings that results, or the time they take, depend on."""
    for key, value in (SETTINGS | TUNING).items():
        spark.conf.set(key, value)
    return spark


def require_settings(spark: SparkSession) -> None:
    """Raise where a caller's session would give other results; it is not changed."""
    wrong = [f"{key}={value}" for key, value in SETTINGS.items() if spark.conf.get(key, None) != value]
    if wrong:
        raise ValueError(f"set {', '.join(wrong)} in the session, or use docproof.session.prepare")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only on a single machine without any."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="docproof-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def spread(df: DataFrame, key: str, source: DataFrame | None = None) -> DataFrame:
    """Use every core on inputs that come in fewer pieces; large inputs are left as they are.

    ``source`` is the table that ``df`` was made from, where counting df's own pieces would start jobs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if (df if source is None else source).rdd.getNumPartitions() < cores else df
