"""Session construction and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app_name: str = "lectern", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on; `conf` overrides or adds any."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # the state of a stream may outgrow the memory of an executor
        STATE_STORE: ROCKSDB,
        # checkpoint files go when nothing refers to them any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def need_named_state(spark: SparkSession) -> None:
    """Let streams started from here on keep named state, which Spark's default state store cannot.

    For sessions that `build_session` did not make. Streams that run keep their store, and so do those that are
    started again, since a checkpoint names its own; another store than the default that was chosen stays.
    """
    if spark.conf.get(STATE_STORE).endswith(".HDFSBackedStateStoreProvider"):
        spark.conf.set(STATE_STORE, ROCKSDB)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder named by `spark.checkpoint.dir`.

    Only a local session without that setting gets a folder of its own, because every
    executor of a cluster must be able to read the files after a peer is lost.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", sc.master):  # one process; local-cluster has several
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="lectern-checkpoint-")
    sc.setCheckpointDir(shared)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder; nothing in it yet."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a small result once to reliable storage and continue from the stored copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_table(df: DataFrame) -> DataFrame:
    """The same for a large table: kept as Parquet, so later scans read only their columns."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_most(df: DataFrame, rows: int) -> bool:
    """True when `df` has no more than `rows` rows; looks at no more than rows + 1 of them."""
    return df.limit(rows + 1).count() <= rows


def checked_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """`df` marked for broadcast when it has no more than `rows` rows, and as it is otherwise.

    The other side of a join is then read in place instead of being shuffled.
    """
    return F.broadcast(df) if at_most(df, rows) else df
