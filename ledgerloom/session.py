"""Session settings and the shared scratch folder that lineage cuts are written to."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: str = "8", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerloom")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a temporary one, but only if all tasks run on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: The setting by which a query's shuffle files go as soon as it ends; nothing reads those of a cut once it is written.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Cut:
    """A DataFrame written once to the shared folder and read back, so that a lost executor costs a re-read only."""

    def __init__(self, df: DataFrame, partition_by: list[str] | None = None):
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
        writer, before = df.write, spark.conf.get(SHUFFLES_GO, None)
        spark.conf.set(SHUFFLES_GO, "true")  # else they stay on disk until the driver happens to collect its garbage
        try:
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path)
        finally:
            if before is None:
                spark.conf.unset(SHUFFLES_GO)
            else:
                spark.conf.set(SHUFFLES_GO, before)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the written files once nothing reads them any more."""
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    return Cut(df).df
