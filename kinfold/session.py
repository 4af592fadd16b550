"""Session settings, and where intermediate results are kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "kinfold", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings given here or on submit win."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where a cluster names none, the job stops; in local mode, where
    driver and executors are one process, a folder in the warehouse serves."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def named_path(spark: SparkSession, name: str) -> str:
    """The path under the shared folder that a name stands for, in this session and in later ones."""
    return f"{shared_dir(spark)}/kinfold/named/{name}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/kinfold/{name}-{uuid.uuid4().hex}"


#: Removes the shuffle files of a query when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> DataFrame:
    """Write and read back. The shuffle files of the write go at its end: the table takes their place for good."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def write_table_at(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet to a path under the shared folder that holds nothing yet."""
    return _write(df, path)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and a lost executor costs nothing."""
    return _write(df, fresh_path(df.sparkSession, name))


class Tables:
    """Tables of one computation in a folder of their own, so that each can be dropped after its last reader."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, fresh_path(spark, name)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        return _write(df, f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more, neither now nor in a plan that is still to run."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder, for the small tables of iterations."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
