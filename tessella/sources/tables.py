"""Reading the project's tables and keeping intermediate results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data directory; schema from the files, columns pruned by the plan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where its files give work to less than half of them: small tables of one file.  Larger tables stay as they are read."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if 2 * df.rdd.getNumPartitions() <= want else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session; a temporary one where it is unset and the session is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir() or folder
    return folder


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder name in the shared folder; what is written there is removed when the application ends."""
    at = f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(at)
    files = path.getFileSystem(conf)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{at}/data"


def keep(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage is cut, a lost executor loses nothing.

    The folder is removed when the application ends.
    """
    spark = df.sparkSession
    at = scratch(spark, "kept")
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)
