"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LEXSPARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir. One is made only
    where none is set, as in local tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint df to the shared folder, so that later stages neither recompute it nor
    depend on executors that may be lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, *by: str) -> str:
    """The path of df as a Parquet table in the shared folder, in a folder per value of by."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return path


def stored(df: DataFrame, *by: str) -> DataFrame:
    """df as a written table: like cut, but what reads it reads only the columns and the values of
    by that it needs."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, *by))


def part_of(path: str, by: str, value: int) -> pa.Table | None:
    """One part of a written table, read within a task; None if it has no rows. So a task can hold
    its rows against a table of any size, part by part, without sending it through the driver."""
    local = re.sub("^file:/*", "/", f"{path}/{by}={value}")
    files, where = pa.fs.FileSystem.from_uri(local) if "://" in local else (pa.fs.LocalFileSystem(), local)
    if files.get_file_info(where).type == pa.fs.FileType.NotFound:
        return None
    return pa.dataset.dataset(where, filesystem=files, format="parquet").to_table()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df in at least as many partitions as there are cores, by the hash of the keys. A small file
    is one partition however dear its rows are to work on; input of enough partitions stays as it
    is, so nothing is shuffled at scale."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
