"""Shared pieces: checkpoints, held-out folds, text columns, row keys."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

#: Words as the contracts for near-duplicates and rules cut them: runs without ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; one of texts is spread over the cores if its files make fewer partitions than there are cores."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(rows) if table in ("documents", "pages") else rows


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset and all runs on this machine, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spindrift-"))
    return context.getCheckpointDir()


@contextmanager
def stage_folder(spark: SparkSession, name: str):
    """A fresh shared folder to write stages to, and a function that removes what a path in it holds."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove(path: str) -> None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)

    try:
        yield folder, remove
    except BaseException:
        remove(folder)
        raise


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared checkpoint folder and read from there, with lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows up to which a written side of a join is broadcast.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has no more rows than that, which is counted; else as it is, for a shuffled join. df should be written already."""
    return F.broadcast(df) if df.count() <= rows else df


def fold(key: Column | str, parts: int) -> Column:
    """crc32 of the key as text, modulo parts; a null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def text_of(column: str) -> Column:
    """The column as text, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Columns that name a row by its content, never null: rows that agree in id and text share them.

    Positions or generated ids would differ between two scans of one table; this doesn't.
    """
    return [
        F.coalesce(F.col(id_col).cast("string"), F.lit("\0")).alias("__id"),
        F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("\0"))).alias("__text"),
    ]


def small_batches(spark: SparkSession, rows: int = 500, size: int = 32 << 20) -> None:
    """At most so many rows and bytes in an Arrow batch, as texts are long. This sets the session's limits; smaller ones stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        value = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
        if not 0 < value <= most:
            spark.conf.set(name, str(most))


#: For DuckDB, which has no crc32: a row with the table of its 256 steps, and the value (unsigned) of a text's UTF-8 bytes beside that row.
SQL_CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS tab
)"""


def sql_crc(text: str) -> str:
    octets = f"list_transform(range(strlen({text})), lambda i: ('0x' || substring(hex({text}), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c // 256, tab[1 + xor(c, b) % 256]), 4294967295), 4294967295)"


def sql_lower(text: str) -> str:
    """A-Z in lower case and nothing else."""
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
