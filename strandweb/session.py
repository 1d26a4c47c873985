"""Session helpers: table access, reliable checkpoints, plan sizes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the queries assume (UTC, AQE)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strandweb")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table (a file or a folder of files) of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for reliable checkpoints.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests, a laptop) a temporary folder is
    made, which is safe because driver and executors then are one process.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="strandweb-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    own = context.getCheckpointDir()  # a folder of this session within the named one
    _delete_on_exit(spark, own)
    return own


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, with its lineage cut; survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared checkpoint folder and read back; the table goes when the session ends.

    For loops: unlike a checkpoint, a table doesn't inherit the size estimates of the plan that made it, which multiply with
    every join until the planner drowns in them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


class WrittenTable:
    """A table in the shared checkpoint folder that grows by parts; read as one scan. It goes when the session ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"
        self.parts: list[str] = []
        self.schema: StructType | None = None
        _delete_on_exit(spark, self.path)

    def append(self, df: DataFrame) -> DataFrame:
        """The new part, read back."""
        part = f"{self.path}/part-{len(self.parts)}"
        df.write.parquet(part)
        self.parts.append(part)
        self.schema = df.schema
        return self.spark.read.schema(self.schema).parquet(part)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.parts)


def spread(df: DataFrame, at_least: int | None = None) -> DataFrame:
    """``df`` on ``at_least`` partitions (by default one for each core) where it has fewer, for slow functions over a scan of few splits.

    The rows are the same either way; a table of many splits, a large one that is, is not shuffled.
    """
    wanted = at_least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes that ``df`` reads, without running anything."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def input_chunks(df: DataFrame) -> int:
    """Estimated number of input splits of ``df``."""
    spark = df.sparkSession
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return max(spark.sparkContext.defaultParallelism, -(-plan_bytes(df) // max(int(split), 1)))
