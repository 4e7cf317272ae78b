"""A global order by hash, with running sums over it, without a global sort.

Rows are ordered by a 60-bit digest of their key, whose leading bits are the bucket.  Sums
per bucket, then offsets over the short table of buckets, then running sums inside a bucket
give every row its place.  The order is that of the digests, so neither the number of
buckets nor of partitions changes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIGEST_BITS = 60
BUCKET_ROWS = 250_000


def digest(text: Column) -> Column:
    """The first 60 bits of the md5 of ``text``, as a non-negative long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def key_text(*cols: str) -> Column:
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols])


def bucket_bits(rows: int) -> int:
    return max(0, (max(1, -(-rows // BUCKET_ROWS)) - 1).bit_length())


def running_start(df: DataFrame, amount: str, order: list[str], rows: int, by: list[str] = ()) -> DataFrame:
    """Adds ``start``: the sum of ``amount`` over all rows before this one, by ``by``.

    ``df`` must have ``h`` (see ``digest``) and should be stored, as it is read twice.
    Offsets are one row per group and bucket of about ``BUCKET_ROWS`` rows.
    """
    df = df.withColumn("bucket", F.shiftright("h", DIGEST_BITS - bucket_bits(rows)))
    keys = [*by, "bucket"]
    sums = df.groupBy(*keys).agg(F.sum(amount).alias("bucket_sum"))
    before = W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.coalesce(F.sum("bucket_sum").over(before), F.lit(0)).alias("offset"),
    )
    inside = W.partitionBy(*keys).orderBy("h", *order).rowsBetween(W.unboundedPreceding, -1)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return (
        df.withColumn("start", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(offsets, same)
        .withColumn("start", F.col("start") + F.col("offset"))
        .drop("bucket", "offset", *[f"_{k}" for k in keys])
    )


def copies(df: DataFrame, n: str, name: str, piece: int = 65_536) -> DataFrame:
    """``n`` rows for each row, numbered from 0 in ``name``; no array exceeds ``piece`` items."""
    last = F.col(n) - 1
    return (
        df.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.floor(last / piece).cast("long"))))
        .withColumn(name, F.explode(F.sequence(
            F.col("_piece") * piece, F.least(last, F.col("_piece") * piece + piece - 1))))
        .drop("_piece")
    )
