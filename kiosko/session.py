"""Sessions, table access and the folder for checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "kiosko", master: str | None = None, shuffle: int | None = None) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow; a running session is reused as it is."""
    build = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    build = build.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    build = build.config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.ui.enabled", "false")
    if master:
        build = build.master(master)
    if shuffle:
        build = build.config("spark.sql.shuffle.partitions", str(shuffle))
    return build.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> None:
    """Set the checkpoint folder where it is not yet set: ``spark.checkpoint.dir`` of the session. Only where that is
    unset and the master is local (tests) a folder of this machine is used; on a cluster an unset folder is an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a shared folder")
            folder = tempfile.mkdtemp(prefix="kiosko-", dir=os.environ.get("TMPDIR"))
        sc.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, lineage cut."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table into the shared checkpoint folder and read again: lineage is cut as by a
    checkpoint, but what follows reads only the columns it needs. The tables go with the folder."""
    spark = df.sparkSession
    _shared_folder(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
