"""Shards by a Feistel permutation over global row numbers.

Rows are numbered 0..N-1 in the order of a digest of (id, checksum, size).  A Feistel network
permutes 0..a*b-1, the smallest near-square domain that holds N: a round adds a keyed digest
of one half to the other, modulo a or b.  Cycle walking repeats the network while the image is
N or above; fewer than a numbers are, so one more step is needed about once in sqrt(N) rows
(``WALK`` steps always suffice for N up to 4,096; beyond that the chance that a row needs more
is under 1e-100, and such a row raises an error).  Row, position, shard and slot can be
computed from each other without any table: shard = position mod shards, slot = position div
shards, so shards differ by one row at most and slots have no gap.  The law is ``rows``.

A null text has no bytes: size 16 and checksum 0.  A null id is ordered as the text ``null``.
Rows equal in id, checksum and size are counted before the shuffle and numbered one after the
other; they are interchangeable.  An empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.ordering import copies, digest, key_text, running_start
from crosspanel.session import stage

ROUNDS = 6
WALK = 64
ROW_BYTES = 16


def _network(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the Feistel network over 0..a*b-1."""

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        half = F.when(even, s["r"]).otherwise(s["l"])
        key = digest(F.concat_ws(":", F.lit(str(seed)), i.cast("string"), half.cast("string")))
        return F.struct(
            F.when(even, (s["l"] + key) % a).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise((s["r"] + key) % b).alias("r"),
        )

    halves = F.struct((x % a).alias("l"), F.floor(x / a).cast("long").alias("r"))
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, halves, step, lambda s: s["r"] * a + s["l"])


def permuted(row: Column, total: int, seed: int = 1) -> Column:
    """The position of ``row`` in a shuffle of 0..total-1."""
    a = math.isqrt(max(0, total - 1)) + 1
    b = max(1, -(-total // a))

    def walk(x: Column) -> Column:
        more = F.aggregate(
            F.sequence(F.lit(1), F.lit(WALK)), x,
            lambda s, _: F.when(s < total, s).otherwise(_network(s, a, b, seed)),
        )
        return F.when(x < total, x).otherwise(more)

    return walk(_network(row, a, b, seed))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 16), text_crc32."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )


def shard(
    docs: DataFrame, shards: int = 40, seed: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, row, position, shard, slot.  Texts are never shuffled."""
    key = ["doc_id", "text_crc32", "size"]
    rows = stage(
        sized(docs, id_col, text_col)
        .groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("h", digest(key_text(*key)))
    )
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    numbered = copies(running_start(rows, "n", key, total[1]), "n", "copy")
    placed = numbered.withColumn("row", F.col("start") + F.col("copy")).withColumn(
        "position", permuted(F.col("row"), total[0], seed)
    )
    position = F.when(F.col("position") < total[0], F.col("position")).otherwise(
        F.raise_error(F.lit("cycle walk did not end")).cast("long")
    )
    return placed.select(
        "doc_id", "size", "text_crc32", "row", position.alias("position")
    ).withColumns({
        "shard": (F.col("position") % shards).cast("int"),
        "slot": F.floor(F.col("position") / shards).cast("long"),
    })
