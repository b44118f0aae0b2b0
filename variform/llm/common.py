"""Helpers shared by the training-data operators: shared-folder tables, checked broadcasts, hash filters."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when rows x row bytes stays under this; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary folder serves a
    session on one machine (tests, bench); on a cluster it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(spark, "_variform_shared", None)
        if root is None:
            root = "file://" + tempfile.mkdtemp(prefix="variform-")
            spark._variform_shared = root
    return root.rstrip("/")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh table path in the shared folder, removed when the driver exits."""
    path = f"{shared_root(spark)}/variform-{uuid.uuid4().hex}/{name}"
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    fs.deleteOnExit(p.getParent())
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p.getParent(), True)


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def checked_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast when the measured size is below the bound; otherwise leave the join to shuffle."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of at most so many rows: documents are long, and batches wait in memory on both sides. Spark reads the
    setting when a plan runs, which is after an operator has returned, so it stays for the session; smaller ones are kept."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fresh(name: str, taken: list[str]) -> str:
    """A column name that is not taken."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


#: A key of at least 1/HOT_SHARE of the rows, and of HOT_LEAST rows, is dealt over several tasks; there are at most HOT_SHARE.
HOT_SHARE, HOT_LEAST = 512, 64


def hot_keys(counts: DataFrame, keys: list[str], n: int, count: str = "c") -> dict[int, int]:
    """Of the keys of counts (a written table) that too many of n rows have: their hash, and over how many parts such a key's
    rows are dealt. At most HOT_SHARE entries at any size, so the driver may hold them."""
    limit = max(HOT_LEAST, n // HOT_SHARE)
    found = counts.where(F.col(count) >= limit).select(F.xxhash64(*keys).alias("h"), F.ceil(F.col(count) / limit).cast("int").alias("parts"))
    return {r.h: r.parts for r in found.collect()}


def is_hot(hot: dict[int, int], *keys: str) -> Column:
    return F.xxhash64(*keys).isin(*hot) if hot else F.lit(False)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], hot: dict[int, int], spread: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on keys. The rows of a hot key are dealt by a hash of the columns ``spread`` over as many parts
    as hot says, and right's rows of it are repeated for each. (A key of a hot one's hash is treated alike on both sides.)"""
    if not hot:
        return left.join(right, keys, how)
    listed = F.create_map(*[F.lit(x) for item in hot.items() for x in item])
    parts = F.when(is_hot(hot, *keys), F.element_at(listed, F.xxhash64(*keys))).otherwise(1)
    dealt = left.withColumn("_part", F.pmod(F.xxhash64(*spread), parts).cast("int"))
    copies = right.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(copies, [*keys, "_part"], how).drop("_part")


class BitFilter:
    """A one-hash membership bitmap held as rows (slot, 4 KiB bitmap); no false negatives.

    ``bits`` grows with the number of keys (eight bits a key), and the table is broadcast only up to
    BROADCAST_BYTES; a larger one is joined by its slot column, so nothing unbounded is shipped.
    """

    SLOT_BITS = 32768

    def __init__(self, keys: DataFrame, key: str, n_keys: int):
        want = max(self.SLOT_BITS, 8 * max(1, n_keys))
        self.bits = 1 << (want - 1).bit_length()
        pos = F.expr(f"pmod({key}, {self.bits}L)")
        self.slots = keys.select(pos.alias("p")).groupBy((F.col("p") / self.SLOT_BITS).cast("long").alias("_slot")).agg(
            F.expr(f"bitmap_construct_agg(CAST(p % {self.SLOT_BITS} AS BIGINT))").alias("_bitmap")
        )

    def keep(self, df: DataFrame, key: Column) -> DataFrame:
        """Rows of df whose key may be a member."""
        cols = df.columns
        slots = checked_broadcast(self.slots, self.bits // self.SLOT_BITS, self.SLOT_BITS // 8)
        probed = df.withColumn("_p", F.pmod(key, F.lit(self.bits))).withColumn("_slot", (F.col("_p") / self.SLOT_BITS).cast("long"))
        bit = F.expr(
            f"(CAST(conv(hex(substring(_bitmap, CAST((_p % {self.SLOT_BITS}) DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)"
            " >> CAST(_p % 8 AS INT)) & 1"
        )
        return probed.join(slots, "_slot").where(bit == 1).select(*cols)
