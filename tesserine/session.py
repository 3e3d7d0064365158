"""Session defaults, table access and written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    build = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tesserine")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        build = build.config(k.replace("__", "."), v)
    spark = build.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset and the master is local (tests), a folder
    of this machine. On a cluster without the setting this is an error, as executors couldn't read each other's files."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = getattr(spark, "_tesserine_dir", None)
        if named is None:
            master = spark.conf.get("spark.master", "")
            if not re.fullmatch(r"local(?:\[.*\])?", master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="tesserine-")
            spark._tesserine_dir = named
    return named.rstrip("/")


def spread(df: DataFrame, below: int = 1 << 30) -> DataFrame:
    """A small table in fewer partitions than there are cores, as one file may be one, over all cores; nothing is run.

    Tables of more than ``below`` bytes by the planner's estimate aren't shuffled. Without access to the plan (a
    remote session) the table stays as it is; no result hangs on it.
    """
    try:
        plan = df._jdf.queryExecution()
        if plan.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return df  # it has a shuffle of its own, and counting its partitions would run it
        size, parts = int(str(plan.optimizedPlan().stats().sizeInBytes())), plan.toRdd().getNumPartitions()
        cores = df.sparkSession.sparkContext.defaultParallelism
    except Exception:
        return df
    return df.repartition(cores) if size < below and parts < cores else df


def clear_written(spark: SparkSession) -> None:
    """Delete the written tables of all queries so far; only when none of their results is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tables")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives lost executors, is computed once.

    The files stay until ``clear_written``, as later reads of a result need them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
