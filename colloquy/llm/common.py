"""What the operators share: intermediate tables, Arrow batches, byte views and hot-key salting."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of one Arrow batch sent to a Python worker; a batch holds whole rows, so one long text may exceed the bytes.
BATCH_ROWS = 2_000
BATCH_BYTES = 16 << 20
#: ASCII white space, the separators of the words in every contract.
SPACE = r"[\x20\x09-\x0D]+"


def work_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; where none is set, a temporary folder in local mode and an error on a cluster."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="colloquy-")
        atexit.register(shutil.rmtree, root, True)
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


#: Folders of the tables written and not yet discarded, by their last names.
_written: dict[str, str] = {}


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation.

    The files go with ``discard``, or when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/colloquy/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    _written[path.rsplit("/", 1)[1]] = path
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the materialised tables that ``tables`` read, when nothing still to run reads them. Files of any other origin stay."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for name in {f.split("/")[-2] for f in df.inputFiles()} & _written.keys():
            at = context._jvm.org.apache.hadoop.fs.Path(_written.pop(name))
            files = at.getFileSystem(context._jsc.hadoopConfiguration())
            files.delete(at, True)
            files.cancelDeleteOnExit(at)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished, unreferenced plans now rather than at some later collection.

    The driver's first collection frees the plans, a later one what only they referred to.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a Python worker's memory follows the batch and not the partition."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def give_back() -> None:
    """Free memory of this process goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def giving_back(work):
    """``work`` over batches or frames; at the end the worker's free memory goes back to the system, as an idle worker would hold it through later stages."""

    def run(batches):
        yield from work(batches)
        give_back()

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one array, and the n + 1 offsets of its rows in it; null as empty."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_key(text: str = "text"):
    """Stands for a row's text beside its id, so that null or repeated ids don't mix texts."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(r, id, k): each row as one struct, so that no column name of the caller meets one of ours; ``r.*`` gives the row back."""
    return docs.select(F.struct("*").alias("r"), F.col(id_col).alias("id"), row_key(text_col).alias("k"))


def ascii_lower(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node of its component.

    Large-star and small-star steps (Kiveris et al., 2014) as joins and grouped minima,
    each round written to the shared folder. The loop ends when a round changes no edge.
    """
    spark = edges.sparkSession
    now = materialise(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
    seen = mark(now)
    while seen[0]:
        both = now.union(now.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
        if (then := mark(now)) == seen:
            break
        seen = then
    release(spark)
    # a star: each node but the root points at the root
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def let(value, body):
    """``body`` of ``value``, computed once: a lambda's argument is not inlined again and again as a column alias is."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Bytes up to which a lookup table is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 16 << 20


def row_bytes(df: DataFrame):
    """A column: about how much of memory a row takes, arrays and strings by their length."""
    out = F.lit(0).cast("long")
    for f in df.schema:
        kind = f.dataType.typeName()
        size = F.size(f.name) * 8 if kind in ("array", "map") else F.octet_length(f.name) if kind in ("string", "binary") else F.lit(8)
        out = out + F.coalesce(size.cast("long"), F.lit(0)) + 8
    return out


def table_bytes(df: DataFrame) -> int:
    return df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()[0]


def lookup(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a materialised table of group values: by broadcast where its summed bytes are few, else by shuffle with skewed keys split."""
    return left.join(F.broadcast(right) if table_bytes(right) <= BROADCAST_BYTES else right, on, how)
