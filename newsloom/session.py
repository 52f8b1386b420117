"""Session settings shared by the tests, the bench and the examples."""

from __future__ import annotations

import logging
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g", **more: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; `more` overrides any setting."""
    builder = SparkSession.builder.master(master).config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, an own one if all runs in one process."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="newsloom-")
        logging.getLogger(__name__).warning("spark.checkpoint.dir is unset: a local session writes its checkpoints to %s", own)
        spark.sparkContext.setCheckpointDir(own)
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, what: str, compression: str | None = None) -> DataFrame:
    """Like materialize, by a Parquet table of the shared folder: loops keep plans short, since nothing known of the rows is carried along."""
    path = fresh_dir(df.sparkSession, what)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a table of short rows may be broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 100_000


def is_few(df: DataFrame) -> bool:
    """Whether a materialized table of short rows may be broadcast."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def guarded_broadcast(df: DataFrame) -> DataFrame:
    """A broadcast hint for a materialized table of short rows, if its count allows one."""
    return F.broadcast(df) if is_few(df) else df
