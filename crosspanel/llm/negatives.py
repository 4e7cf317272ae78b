"""Hard negatives by a secondary-sort shuffle.

Every row is scored against the anchors, the rows whose id is divisible by ``ANCHOR_EVERY``.
A scored pair is packed into the key (anchor, descending score, positive before negative, id),
whose byte order is the order wanted.  ``repartitionAndSortWithinPartitions`` deals the keys by
anchor and sorts them on the way, and one streaming pass over a sorted partition opens a window
at each positive and gives a negative to every window that it falls into.  No anchor's pairs
are held together: the iterator keeps the open windows only.

Before the shuffle each task keeps what can still matter of its own rows.  The first job keeps
the best rows of the anchor's label and yields the positives.  The second one knows them and
keeps, of each window, the best rows of other labels.  Both are exact: a row that is not among
the first of its own task is not among the first of all.  So an anchor receives a few rows from
each task, however many rows share a label or a vector.

Anchors are taken in blocks of at most ``BLOCK_BYTES``.  A block is broadcast, matched against
all rows, stored and released.

Each component x counts as floor(256 * x); scores are exact integers below 2**60 (larger ones
raise an error).  Rows with a null id, label or vector, or a null or non-finite component, take
no part.  Of vectors of unequal length the missing components are 0; an empty vector scores 0.
Rows stand for themselves: a repeated row is found as often as it is there, and a repeated
anchor is served each time.  Rows of the anchor's own id are never its partners.  Equal scores
are ordered by id.  An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.session import stage, stage_dir

ANCHOR_EVERY = 100
POSITIVES = 5
NEGATIVES = 5
BLOCK_BYTES = 32 << 20
ROWS_AT_ONCE = 4096
ANCHORS_AT_ONCE = 512
LEAST = -(1 << 62)

# anchor, descending score, kind (0 positive, 1 negative), id: their bytes sort in this order.
KEY = np.dtype([("anchor", ">u4"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
UNPACK = struct.Struct(">IQBQ").unpack
SIGN = 1 << 63
RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long,"
    " positive_score long, negative_score long"
)


def pack(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> list[bytes]:
    out = np.empty(len(anchor), KEY)
    out["anchor"], out["kind"] = anchor, kind
    out["score"] = ~(score.astype(np.int64).view(np.uint64) ^ np.uint64(SIGN))
    out["id"] = ids.astype(np.int64).view(np.uint64) ^ np.uint64(SIGN)
    return np.frombuffer(out.tobytes(), f"V{KEY.itemsize}").tolist()


def unpack(key: bytes) -> tuple[int, int, int, int]:
    """anchor, score, kind, id"""
    anchor, score, kind, row_id = UNPACK(key)
    return anchor, SIGN - 1 - score, kind, row_id - SIGN


def usable(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """vec_id, label, vector (array of double) of the rows that take part."""
    broken = F.exists(
        F.col(vector_col),
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")),
    )
    return rows.select(
        F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
        F.when(~broken, F.col(vector_col).cast("array<double>")).alias("vector"),
    ).dropna()


def matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """floor(256 * x), one row per vector, cut or filled with 0 to ``width``."""
    offsets = np.asarray(vectors.offsets)
    sizes = np.diff(offsets)
    values = np.floor(256 * np.asarray(vectors.values)[offsets[0] : offsets[-1]])
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    at = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row[at < width], at[at < width]] = values[at < width]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of ``a`` with all rows of ``b``."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if bound < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if not bound < 2.0**60:
        raise ValueError("inner products need more than 60 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


class Block:
    """Some anchors, numbered from 0, and the scores of their positives once these are known."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.positives: np.ndarray | None = None  # scores, LEAST where there are fewer

    def windows(self, some: slice, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        """For each list that is kept, which pairs of anchor and row belong to it."""
        same = self.labels[some, None] == labels[None, :]
        other = self.ids[some, None] != ids[None, :]
        if self.positives is None:
            yield same & other
            return
        for top in self.positives[some].T:
            # 80 * top <= 100 * score <= 100 * top
            within = (scores <= top[:, None]) & (scores >= -((-4 * top) // 5)[:, None])
            yield within & ~same & other & (top > LEAST)[:, None]


def best_of_task(shared, lists: int, keep: int, kind: int):
    """A ``mapInArrow`` function: the keys of the ``keep`` first rows of each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        n, seen = len(block.ids), 0
        shape = (lists, n, keep)
        score, row_id, serial = np.full(shape, LEAST), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                ids = np.asarray(part.column(0))
                order = np.argsort(ids, kind="stable")  # so that the first of equal scores has the least id
                ids, labels = ids[order], np.asarray(part.column(1))[order]
                rows = matrix(part.column(2), block.vectors.shape[1])[order]
                serials = seen + np.arange(len(ids))
                seen += len(ids)
                for first in range(0, n, ANCHORS_AT_ONCE):
                    some = slice(first, min(n, first + ANCHORS_AT_ONCE))
                    scores = products(block.vectors[some], rows)
                    for k, belongs in enumerate(block.windows(some, scores, ids, labels)):
                        worst = score[k, some, -1:]
                        belongs &= scores >= worst
                        todo = np.flatnonzero(belongs.any(1))
                        if not len(todo):
                            continue
                        left = np.where(belongs[todo], scores[todo], LEAST)
                        line = np.arange(len(todo))
                        picks = []
                        for _ in range(keep):
                            col = left.argmax(1)
                            picks.append((left[line, col], ids[col], serials[col]))
                            left[line, col] = LEAST
                        to = first + todo
                        merged = [
                            np.concatenate([held[k, to], np.stack(new, 1)], 1)
                            for held, new in zip((score, row_id, serial), zip(*picks))
                        ]
                        rank = np.lexsort((merged[2], merged[1], -merged[0]), axis=-1)[:, :keep]
                        for held, new in zip((score, row_id, serial), merged):
                            held[k, to] = np.take_along_axis(new, rank, 1)
        # A row that several windows of an anchor hold goes out once.
        k, a, j = np.nonzero(score > LEAST)
        _, once = np.unique(a * np.int64(seen + 1) + serial[k, a, j], return_index=True)
        k, a, j = k[once], a[once], j[once]
        keys = pack(a, score[k, a, j], kind, row_id[k, a, j])
        for at in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys[at : at + 50_000], pa.binary())})

    return run


def first_positives(keys) -> Iterator[tuple[int, int, int]]:
    """anchor, score, id of the first positives of each anchor of a sorted partition."""
    current, n = None, 0
    for key, _ in keys:
        anchor, score, _, row_id = unpack(key)
        if anchor != current:
            current, n = anchor, 0
        if n < POSITIVES:
            n += 1
            yield anchor, score, row_id


def served_windows(keys) -> Iterator[tuple[int, int, int, int, int, int]]:
    """anchor, positive id, rank, negative id and both scores, from a sorted partition."""
    current, windows = None, []
    for key, _ in keys:
        anchor, score, kind, row_id = unpack(key)
        if anchor != current:
            current, windows = anchor, []
        if kind == 0:
            windows.append([row_id, score, 0])
            continue
        # Scores fall from here on: a window that is full, or too high by now, is done.
        windows = [w for w in windows if w[2] < NEGATIVES and 100 * score >= 80 * w[1]]
        for w in windows:
            w[2] += 1
            yield anchor, w[0], w[2], row_id, w[1], score


def anchor_of(key: bytes) -> int:
    return zlib.crc32(key[:4])


def _sorted_keys(pairs: DataFrame):
    partitions = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.rdd.map(lambda r: (bytes(r[0]), None)).repartitionAndSortWithinPartitions(
        partitions, anchor_of
    )


def hard_negatives(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | None = None,
    every: int = ANCHOR_EVERY,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    found = usable(rows, id_col, vector_col, F.col("label") if label is None else label)
    anchors = stage(found.filter(F.col("vec_id") % every == 0))
    n, width = anchors.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not n:
        return spark.createDataFrame([], RESULT)
    blocks = -(-n * max(1, width) * 8 // block_bytes)
    path, wrote = f"{stage_dir(spark)}/staged-{uuid.uuid4().hex}", False
    for b in range(blocks):
        part = anchors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        part = part.sort_by("vec_id").combine_chunks()
        if not part.num_rows:
            continue
        vectors = part.column("vector").combine_chunks()
        block = Block(np.asarray(part.column("vec_id")), np.asarray(part.column("label")),
                      matrix(vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors, width))
        shared = sc.broadcast(block)
        pairs = found.mapInArrow(best_of_task(shared, 1, POSITIVES, 0), "key binary")
        top = _sorted_keys(pairs).mapPartitions(first_positives).collect()
        shared.unpersist()
        if not top:
            continue
        anchor, score, row_id = np.array(top, np.int64).T
        order = np.lexsort((row_id, -score, anchor))
        nth = np.arange(len(order)) - np.searchsorted(anchor[order], anchor[order])
        block.positives = np.full((len(block.ids), POSITIVES), LEAST)
        block.positives[anchor[order], nth] = score[order]
        shared = sc.broadcast(block)
        pairs = found.mapInArrow(best_of_task(shared, POSITIVES, NEGATIVES, 1), "key binary")
        known = sc.parallelize([(k, None) for k in pack(anchor, score, 0, row_id)])
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ids = sc.broadcast(block.ids)
        served = (
            pairs.rdd.map(lambda r: (bytes(r[0]), None)).union(known)
            .repartitionAndSortWithinPartitions(partitions, anchor_of)
            .mapPartitions(served_windows)
            .map(lambda r, ids=ids: (int(ids.value[r[0]]), *r[1:]))
        )
        spark.createDataFrame(served, RESULT, verifySchema=False).write.mode("append").parquet(path)
        shared.unpersist()
        wrote = True
    return spark.read.schema(RESULT).parquet(path) if wrote else spark.createDataFrame([], RESULT)
