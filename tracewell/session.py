"""Session defaults and the helpers that keep plans safe at scale."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "tracewell", master: str = "local[8]", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    b = SparkSession.builder.master(master).appName(app)
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a session on one machine (tests) may leave it unset and gets one of its own, which goes when the process ends."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = jvm_dir.get() if jvm_dir.isDefined() else None
    if not d:
        if not re.match(r"local(\[|-cluster\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tracewell-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        d = "file://" + own
        spark.sparkContext.setCheckpointDir(d)
    return d


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there; any other trouble with the file system is an error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours once no frame reads it any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a written table in the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all shuffle partitions by its keys. Small rows that cost much work each would else be put into few tasks.

    By a hash of the keys rather than the keys: a shuffle by the same keys that comes before would else take this one's place, and
    be merged into few partitions for its few bytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


def widened(df: DataFrame) -> DataFrame:
    """A table of fewer splits than cores dealt out to all of them, before costly work on each row; a larger one as it is, unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only if df is proven to have at most max_rows rows; else leave the join to the planner.

    The check reads at most max_rows + 1 rows.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
