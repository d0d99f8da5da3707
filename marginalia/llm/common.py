"""Shared pieces of the training-data operators: the scratch folder, written intermediates, checked joins."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words: space and the ASCII controls TAB to CR.
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast only if it has at most so many rows and bytes (of its values as JSON).
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Copies of the small side when it is too large to broadcast; the large side picks one by hash. What is still uneven
#: then, adaptive execution splits: both sides are dealt out for the join alone.
SALTS = 16
#: Bits of the filter that tells rows without a match (see with_small).
SIEVE_BITS = 1 << 26


def col(name: str) -> Column:
    """A top-level column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def row(df: DataFrame, name: str = "__row") -> Column:
    """All columns of df as one struct, so that columns made beside it cannot clash; ``{name}.*`` gives them back."""
    return F.struct(*[col(c).alias(c) for c in df.columns]).alias(name)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which every executor shares. Where the setting is absent, a session on
    one machine gets a temporary folder as its checkpoint directory; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="marginalia-"))
        base = context._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/marginalia/{uuid.uuid4().hex}-{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once into the shared scratch folder and return it as read from there, which cuts the lineage:
    a lost executor costs the tasks it was running and nothing that was written before."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


@contextmanager
def arrow_batches(spark: SparkSession, size: int):
    """While it lasts, batches of at most about ``size`` bytes go to Python, whatever the length of texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def discard(*written_before: DataFrame) -> None:
    """Remove what written() wrote, once nothing reads it any more."""
    for df in written_before:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fits_broadcast(small: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df's rows and bytes, which are counted, allow it to be broadcast."""
    x = small.select(F.octet_length(F.to_json(F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(small.columns)]))).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).first()
    return x["n"] <= rows and (x["b"] or 0) <= size


def sieved(big: DataFrame, keys: list[Column], small: DataFrame, on: list[Column]) -> DataFrame:
    """big with ``__maybe``: whether small may have the key; where it is false, small has not. By one bit for each of
    SIEVE_BITS hash values, in bitmaps of 4 KB that are broadcast, 8 MB however large small is."""
    h = F.pmod(F.xxhash64(*on), F.lit(SIEVE_BITS))
    bits = written(small.groupBy(F.floor(h / 32768).alias("__b")).agg(F.bitmap_construct_agg(h % 32768).alias("__bits")), "sieve")
    at = F.pmod(F.xxhash64(*keys), F.lit(SIEVE_BITS))
    out = big.withColumn("__at", at).join(F.broadcast(bits), F.floor(F.col("__at") / 32768) == F.col("__b"), "left")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), ((F.col("__at") % 32768) / 8 + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.call_function("shiftright", byte, (F.col("__at") % 8).cast("int")) % 2 == 1, F.lit(False))
    return out.withColumn("__maybe", maybe).drop("__at", "__b", "__bits")


def with_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", salts: int = SALTS, sieve: bool = False) -> DataFrame:
    """Join a large table with one that has unique keys (null keys match null keys). how: inner, left or left_anti.

    The small side's rows and bytes are counted; within bounds it is broadcast, beyond that every row of it is copied
    ``salts`` times and the large side's rows spread over the copies, so a hot key lands in so many partitions; 1 is
    for keys that only equal rows share. ``sieve`` is for a large side of wide rows of which few have a match: then
    only those that may have one are shuffled."""
    keys = [(f"__on{i}", k) for i, k in enumerate(on)]
    rest = [c for c in small.columns if c not in on]
    right = small.select(*[F.col(k).alias(n) for n, k in keys], *rest)
    names = [n for n, _ in keys]
    if fits_broadcast(small):
        cond = [big[k].eqNullSafe(right[n]) for n, k in keys]
        return big.join(F.broadcast(right), cond, how).drop(*names)
    others = None
    if sieve:
        split = sieved(big, [F.col(k) for k in on], small, [F.col(k) for k in on])
        others, big = split.where(~F.col("__maybe")).drop("__maybe"), split.where("__maybe").drop("__maybe")
    if salts == 1:
        out = big.join(right, reduce(Column.__and__, [big[k].eqNullSafe(right[n]) for n, k in keys]), how).drop(*names)
    else:
        right = right.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
        left = big.withColumn("__s", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
        cond = [left["__s"] == right["__salt"], *[left[k].eqNullSafe(right[n]) for n, k in keys]]
        out = left.join(right, cond, how).drop("__s", "__salt", *names)
    if others is None or how == "inner":
        return out
    if how == "left":
        others = others.select("*", *[F.lit(None).cast(small.schema[c].dataType).alias(c) for c in rest])
    return out.unionByName(others)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
