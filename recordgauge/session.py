"""Session helpers shared by tests, the benchmark and local runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with the settings the package is tested under."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("recordgauge")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores: a narrow table is read in few partitions, however much work its rows make later."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of this cluster; a temporary one only in a local session that sets none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not root and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(root or tempfile.mkdtemp(prefix="recordgauge-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return root or held.get()


def scratch(spark: SparkSession, name: str = "work") -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    gone = spark._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark._jsc.sc().hadoopConfiguration()).deleteOnExit(gone)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: later plans restart at a plain table, also after lost executors.

    The files go when the application ends, or by `free`."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def free(*cuts: DataFrame) -> None:
    """Delete the files of cuts that no later plan reads."""
    for df in cuts:
        path = getattr(df, "_cut_path", None)
        if path:
            spark = df.sparkSession
            gone = spark._jvm.org.apache.hadoop.fs.Path(path)
            gone.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(gone, True)
