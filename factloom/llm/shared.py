"""Shared working folder and size checks that the text operators use."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of an Arrow batch between Spark and a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
#: Bits of a sieve for each of its ids: one of so many other keys passes by chance.
SIEVE_BITS = 16


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor and the driver see: ``spark.checkpoint.dir``.

    Only where it is unset and Spark is one local process (tests) a temporary folder is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = java.get() if java.isDefined() else None
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give freed memory back to the system: a Python worker stays when its task has ended."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass


def frugal(run):
    """``run`` for ``mapInArrow``, giving memory back after each batch that it makes."""

    def whole(batches):
        for batch in run(batches):
            yield batch
            del batch
            release()
        release()

    return whole


def text_rows(docs: DataFrame, doc_id: str, text: str, whole_row: bool = False) -> tuple[DataFrame, int | None]:
    """Columns (doc_id, text), or (doc_id, row) and the text's place in the row, so that a text travels once.

    Batches to Python are bounded by bytes from here on, as rows may be long.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    own = F.col(doc_id).alias("doc_id")
    if whole_row:
        return docs.select(own, F.struct(*[docs[c] for c in docs.columns]).alias("row")), docs.columns.index(text)
    return docs.select(own, F.col(text).alias("text")), None


def text_column(batch: pa.RecordBatch, place: int | None) -> pa.Array:
    """The texts of a batch of such rows."""
    return batch.column(1) if place is None else pc.struct_field(batch.column(1), [place])


def text_bytes(df: DataFrame, col: str) -> int:
    """Total UTF-8 bytes of a column; one small aggregate over one column."""
    return df.agg(F.sum(F.octet_length(F.col(col))).alias("b")).first()["b"] or 0


def small_or_plain(df: DataFrame, row_bytes: int, bound: int = 32 << 20) -> DataFrame:
    """``df`` with a broadcast hint if it is proven to stay under ``bound`` bytes, else unchanged.

    ``df`` should be cheap to count (read from a saved table).  Without the hint Spark joins by
    shuffle and may still adapt at run time.
    """
    return F.broadcast(df) if df.count() * row_bytes <= bound else df


def sieve(ids: DataFrame):
    """``passing(rows, key, how)``: with ``left_semi`` the rows whose ``key`` may be in the one column of ``ids``, with ``left_anti`` those whose
    key surely is not.

    Each id sets one bit of a map of :data:`SIEVE_BITS` bits an id, at most 16 MB in all, which is broadcast.  With one map for both, the two kinds
    of rows are all rows, each once; only how many rows pass depends on the size, so an exact join has to follow.  Nulls are keys like others.
    """
    (col,) = ids.columns
    size = max(1, min(ids.count() * SIEVE_BITS, 1 << 27))
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    own = ids.select(bit(col).alias("h")).select(F.bitmap_bucket_number("h").alias("_bucket"), F.bitmap_bit_position("h").alias("at"))
    maps = F.broadcast(saved(own.groupBy("_bucket").agg(F.bitmap_construct_agg("at").alias("_map")), "sieve"))

    def passing(rows: DataFrame, key: str, how: str) -> DataFrame:
        at = F.bitmap_bit_position(bit(rows[key]))
        byte = F.conv(F.hex(F.substring(F.col("_map"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        on = F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1
        return rows.join(maps, (F.bitmap_bucket_number(bit(rows[key])) == F.col("_bucket")) & on, how)

    return passing


def without(rows: DataFrame, key: str, ids: DataFrame, bound: int = 32 << 20) -> DataFrame:
    """The rows whose ``key`` isn't in the one column of ``ids``, a saved table; null equals null.

    If the ids are too many to be broadcast, rows whose key is surely not among them stay where they are, and only the rest is dealt by key.
    """
    (col,) = ids.columns
    plain = ids.select(F.col(col).alias("_id"))
    side = small_or_plain(plain, 64, bound)
    anti = lambda r: r.join(side, r[key].eqNullSafe(F.col("_id")), "left_anti")
    if side is not plain:
        return anti(rows)
    passing = sieve(ids)
    return passing(rows, key, "left_anti").unionByName(anti(passing(rows, key, "left_semi")))


def numbered(df: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """``df`` with ``at``, the place from 0 of each row among those with equal ``by`` (no nulls), and ``n``, how many those are.

    Rows are dealt to tasks by ranges of all these columns, so a group of any size is spread; only each task's count of each group is
    added up in one place.  Nulls of ``order`` come first; rows that are equal in it get places in any order.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*by, *order]]
    rows = saved(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("_task", F.shiftright("_id", 33))
    parts = rows.groupBy(*by, "_task").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*by).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    starts = saved(parts.select(*by, "_task", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy(*by)).alias("n")), "starts")
    out = rows.join(small_or_plain(starts, 256), [*by, "_task"])
    return out.withColumn("at", F.col("_id") - F.col("_first") + F.col("_before")).drop("_id", "_task", "_first", "_before")
