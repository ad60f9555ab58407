"""Tables between steps, written to the folder that all executors share: short plans, and no work lost with an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where none is set, a temporary one in local mode and an error on a cluster."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="colloquy-")
        atexit.register(shutil.rmtree, root, True)
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written and read back; the files go when the JVM ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/colloquy/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The data files of a folder, which need not exist."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return [n for n in names if not n.startswith(("_", "."))]


class Stages:
    """Steps of a plan that are written, each with its milliseconds and the rows that it gave; ``rows`` holds (stage, ms, detail)."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, dict]] = []

    def written(self, df: DataFrame, stage: str) -> DataFrame:
        seen, began = Observation(), time.monotonic()
        try:
            out = written(df.observe(seen, F.count(F.lit(1)).alias("rows")), stage)
        except Exception:
            self.rows.append((stage, round((time.monotonic() - began) * 1000), {"failed": True}))
            raise
        self.rows.append((stage, round((time.monotonic() - began) * 1000), {"rows": seen.get["rows"]}))
        return out
