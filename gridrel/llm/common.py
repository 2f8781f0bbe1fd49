"""Shared helpers: shared-storage stashes, row identity, small column expressions."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space as the contracts name it: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\f\r"
#: A key that holds more than one in so many rows is a hot one: there are fewer than HOT of them.  Keys of fewer rows than LEAST_HOT never are.
HOT, LEAST_HOT = 4_096, 1_000
_stashes: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a private one only on a local master, where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="gridrel-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder under shared_dir, removed when the driver exits."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _stashes.append((spark, path))
    return path


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write df to shared storage and read it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def free(*done: DataFrame) -> None:
    """Removes tables of stash() that nothing reads any more, since what was made of them is written itself."""
    for df in done:
        path = getattr(df, "_stashed", None)
        if path:
            remove(df.sparkSession, path)
            _stashes.remove((df.sparkSession, path))


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _stashes:
        try:
            remove(spark, path)
        except Exception:  # the session has ended
            return


def spread_join(rows: DataFrame, table: DataFrame, on: str | list[str], size: str, how: str = "left") -> DataFrame:
    """rows with the other columns of table, which has one row a key; no task meets a HOT-th of rows for one key.

    size: the column of table with the number of rows (or about that) that hold the key.  Fewer
    than HOT keys can hold more than one in HOT rows: their rows of table go to all tasks, and
    the rows that they meet are dealt out by number in the shuffle that joins all others.  Null
    keys meet nothing.  how: left or inner.  A name that both sides have is taken from rows.
    """
    keys = [on] if isinstance(on, str) else on
    rest = [c for c in table.columns if c not in keys and c not in rows.columns]
    total, top = table.agg(F.sum(size), F.max(size)).first()
    least = max((total or 0) // HOT, LEAST_HOT)
    if (top or 0) <= least:
        return rows.join(table.select(*keys, *rest), keys, how).select(*rows.columns, *rest)
    hot = table.where(F.col(size) > least).select(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)], F.struct(F.lit(1).alias("__one"), *rest).alias("__of_h"))
    cold = table.where(F.col(size) <= least).select(*[F.col(k).alias(f"__c{i}") for i, k in enumerate(keys)], F.pmod(F.xxhash64(*keys), F.lit(1)).alias("__nought"), F.struct(F.lit(1).alias("__one"), *rest).alias("__of_c"))
    same = lambda name: [F.col(k) == F.col(f"__{name}{i}") for i, k in enumerate(keys)]
    met = rows.join(F.broadcast(hot), same("h"), "left")  # fewer than HOT rows
    met = met.withColumn("__salt", F.when(F.col("__of_h").isNull(), F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id() + 1))
    # pmod(x, 1) is no constant to the planner, so that the salt stays a key of the join
    got = met.join(cold, [*same("c"), F.col("__salt") == F.col("__nought")], "left").withColumn("__of", F.coalesce("__of_h", "__of_c"))
    got = got.where(F.col("__of").isNotNull()) if how == "inner" else got
    return got.select(*rows.columns, *[F.col(f"__of.{c}").alias(c) for c in rest])


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], tag: str) -> DataFrame:
    """df, written, with place (from 0 in the order) and, for each of sums, its sum over all rows before.

    Rows are dealt out by ranges of the order; a task sums inside a range, and the ranges' totals
    are summed over one row a range.
    """
    width = shuffle_width(df.sparkSession)
    ranged = stash(df.select("*", *[c.alias(f"__x_{k}") for k, c in sums.items()]).repartitionByRange(width, *order).withColumn("__part", F.spark_partition_id()), tag)
    totals = ranged.groupBy("__part").agg(F.count("*").alias("__n"), *[F.sum(f"__x_{k}").alias(f"__t_{k}") for k in sums])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    offsets = totals.select("__part", F.coalesce(F.sum("__n").over(earlier), zero).alias("__o"), *[F.coalesce(F.sum(f"__t_{k}").over(earlier), zero).alias(f"__o_{k}") for k in sums])
    inside = Window.partitionBy("__part").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", (F.row_number().over(inside) - 1).alias("__l"), *[F.coalesce(F.sum(f"__x_{k}").over(before), zero).alias(f"__l_{k}") for k in sums])
    got = local.join(F.broadcast(offsets), "__part")  # one row a range
    return got.select(*df.columns, (F.col("__o") + F.col("__l")).cast("long").alias("place"), *[(F.col(f"__o_{k}") + F.col(f"__l_{k}")).alias(k) for k in sums])


def text_key() -> Column:
    """With doc_id, the identity of a row: rows alike in both are copies of one row."""
    return F.xxhash64(F.col("text"))


def hash_bucket(mod: int, *cols: str | Column, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(mod))


def crc_mod(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(0)) % mod


def blocks_for(n: int, size: int) -> int:
    return max(1, math.ceil(n / size))


def shuffle_width(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)
