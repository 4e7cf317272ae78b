"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Shingles are runs of ``SHINGLE`` folded words, weighted (1 + ln tf) * idf.  The idf is
1 + min(1, ln(N / df) / ln(1 / RARE)): it saturates for shingles in a share of up to ``RARE``
of the documents, so only the others need their df known.  Those are at most (mean distinct
shingles per document) / ``RARE``, whatever the corpus.  They are found in two passes: a
shingle above the share in all documents is above it in some unit of them, so units propose
candidates, whose df is then counted over all documents.  That holds for units of any size;
small partitions are read together, as units of few documents would propose too much.

Each text draws ``BANDS * ROWS`` consistent weighted samples; two texts draw the same with the
chance of their weighted Jaccard similarity.  Texts that agree on all samples of a band meet
in its bucket.  Within a bucket every text is compared with its most central one, whose
buckets hold most texts: usually the original of a group of near copies.  After that,
wherever a bucket still holds several classes, its texts outside the largest class are
compared with all others there: as pairs in buckets of up to ``SMALL_BUCKET`` texts, in larger
ones by blocks of ``BLOCK_TEXTS``, where a matrix product bounds all similarities of two
blocks from above, the few pairs that reach the threshold are compared, and at most one link
for each text leaves the task.  So every candidate pair that could join two classes is
verified by exact weighted Jaccard similarity of ``SIMILARITY`` or more, no pairs of a large
group are written out, and a bucket of one class costs its size, not its square.  Classes are
the connected components.

Copies (equal texts) are one text throughout and get one class.  Texts of fewer words than a
shingle have all their words as their only shingle; texts without words (null and empty count
as equal) are in the class of their copies only.  Rows with a null id come before all others
in a class.  Extra columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crosspanel.llm.graph import components, extended
from crosspanel.llm.text import WordHashes, folded_words
from crosspanel.session import stage

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 3
RARE = 0.01
UNIT_DOCS = 2000
CANDIDATES_AT_ONCE = 1_000_000
BLOCK = 1 << 16
SMALL_BUCKET = 64
BLOCK_TEXTS = 512
COLUMNS_AT_ONCE = 4096
NULL_ID = -(2**63)

_A = np.uint64(0xBF58476D1CE4E5B9)
_B = np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, hashes: WordHashes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a text, and how often each occurs."""
    words = folded_words(text)
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = hashes.of(words)
    size = min(size, len(h))
    n = len(h) - size + 1
    out = h[:n].copy()
    for j in range(1, size):
        out *= _A
        out += h[j : j + n]
    return np.unique(_mix(out), return_counts=True)


def _units(batches: Iterator[pa.RecordBatch]):
    """Lists of the distinct shingles of ``UNIT_DOCS`` texts, the last of up to twice as many."""
    hashes, held = WordHashes(), []
    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.append(shingles(text, hashes)[0])
            if len(held) >= 2 * UNIT_DOCS:
                yield held[:UNIT_DOCS]
                held = held[UNIT_DOCS:]
    if held:
        yield held


def _propose(batches):
    for unit in _units(batches):
        values, df = np.unique(np.concatenate(unit), return_counts=True)
        often = values[df > RARE * len(unit)]
        yield pa.RecordBatch.from_pydict({"shingle": pa.array(often.view(np.int64))})


def _count(shared):
    def run(batches):
        wanted = np.frombuffer(shared.value, np.uint64)
        counts = np.zeros(len(wanted), np.int64)
        for unit in _units(batches):
            found = np.concatenate(unit)
            at = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
            counts += np.bincount(at[wanted[at] == found], minlength=len(wanted))
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({
            "shingle": pa.array(wanted[hit].view(np.int64)), "df": pa.array(counts[hit])})

    return run


def frequent_shingles(docs: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes, and idf, of all shingles in over ``RARE`` of the documents."""
    spark = docs.sparkSession
    texts = docs.select("text").coalesce(max(1, n_docs // UNIT_DOCS))
    proposed = stage(texts.mapInArrow(_propose, "shingle long").distinct())
    blocks = -(-proposed.count() // CANDIDATES_AT_ONCE)
    found = []
    for b in range(blocks):
        block = proposed.filter(F.pmod(F.xxhash64("shingle"), F.lit(blocks)) == b).toArrow()
        wanted = np.sort(block["shingle"].to_numpy().view(np.uint64))
        if not len(wanted):
            continue
        shared = spark.sparkContext.broadcast(wanted.tobytes())
        found.append(
            texts.mapInArrow(_count(shared), "shingle long, df long")
            .groupBy("shingle").agg(F.sum("df").alias("df"))
            .filter(F.col("df") > RARE * n_docs).toArrow()
        )
    values = np.concatenate([t["shingle"].to_numpy().view(np.uint64) for t in found] or [np.zeros(0, np.uint64)])
    df = np.concatenate([t["df"].to_numpy() for t in found] or [np.zeros(0)])
    order = np.argsort(values)
    idf = 1 + np.minimum(1, np.log(n_docs / np.maximum(df, 1)) / np.log(1 / RARE))
    return values[order], idf[order].astype(np.float32)


class Weights:
    """TF-IDF weights of a text's shingles."""

    def __init__(self, values: np.ndarray, idf: np.ndarray):
        self.values, self.idf, self.hashes = values, idf, WordHashes()

    def of(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        found, tf = shingles(text, self.hashes)
        w = (1 + np.log(tf)).astype(np.float32) * np.float32(2)
        if len(self.values) and len(found):
            at = np.minimum(np.searchsorted(self.values, found), len(self.values) - 1)
            known = self.values[at] == found
            w[known] *= self.idf[at[known]] / 2
        return found, w


_SCALE = np.float32(2.0**-24)


def samples(values: np.ndarray, weights: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """``n`` consistent weighted samples (32-bit ids of shingle and level) of each document.

    For each shingle and sample: r and c from Gamma(2, 1), beta uniform, level
    t = floor(ln w / r + beta), ln a = ln c - r (t - beta + 1); the least a is drawn.
    """
    logw = np.log(weights)
    out = np.empty((len(offsets), n), np.uint32)
    low = _mix(values + _A)
    for k in range(n):
        z1 = _mix(values ^ np.uint64((k * 2 + 1) * 0x9E3779B97F4A7C15 % 2**64))
        z2 = _mix(z1 + _B)
        half = np.float32(0.5)
        top1 = ((z1 >> np.uint64(40)).astype(np.float32) + half) * _SCALE
        mid1 = (((z1 >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.float32) + half) * _SCALE
        top2 = ((z2 >> np.uint64(40)).astype(np.float32) + half) * _SCALE
        mid2 = (((z2 >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.float32) + half) * _SCALE
        beta = ((z2 & np.uint64(0xFFFF)).astype(np.float32) + half) * np.float32(2.0**-16)
        r = -np.log(top1 * mid1)
        t = np.floor(logw / r + beta)
        lna = np.log(-np.log(top2 * mid2)) - r * (t - beta + np.float32(1))
        bits = lna.view(np.uint32)
        # Order-preserving bits of a float; equal values fall back on the id.
        bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(0x80000000)).astype(np.uint64)
        ident = (low + t.astype(np.int64).view(np.uint64) * _B) & np.uint64(0xFFFFFFFF)
        out[:, k] = np.minimum.reduceat((bits << np.uint64(32)) | ident, offsets).astype(np.uint32)
    return out


def _bands(drawn: np.ndarray) -> np.ndarray:
    ids = drawn.reshape(len(drawn), BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * _B
    for j in range(ROWS):
        key = _mix(key * _A + ids[:, :, j])
    return key.view(np.int64)


def _sketch(shared):
    def run(batches):
        weights = Weights(*(np.frombuffer(b, t) for b, t in zip(shared.value, (np.uint64, np.float32))))
        for batch in batches:
            rows, held, size = [None] * batch.num_rows, [], 0

            def draw(held):
                offsets = np.cumsum([0] + [len(v) for _, v, _ in held[:-1]])
                drawn = samples(np.concatenate([v for _, v, _ in held]),
                                np.concatenate([w for _, _, w in held]), offsets, BANDS * ROWS)
                for (i, _, _), keys in zip(held, _bands(drawn)):
                    rows[i] = keys

            for i, text in enumerate(batch.column(batch.schema.get_field_index("text")).to_pylist()):
                v, w = weights.of(text)
                if len(v):
                    held.append((i, v, w))
                    size += len(v)
                if size >= BLOCK:
                    draw(held)
                    held, size = [], 0
            if held:
                draw(held)
            bands = pa.array([[] if r is None else r for r in rows], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("tid"), bands],
                                             names=["key", "tid", "bands"])

    return run


def _vectors(shared):
    def run(batches):
        weights = Weights(*(np.frombuffer(b, t) for b, t in zip(shared.value, (np.uint64, np.float32))))
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                v, w = weights.of(text)
                short, inverse = np.unique((v >> np.uint64(32)).astype(np.uint32), return_inverse=True)
                total = np.bincount(inverse, w, len(short)).astype(np.float32)
                packed = pa.compress(total.tobytes(), codec="zstd", asbytes=True) if len(v) else b""
                out.append(len(short).to_bytes(8, "little") + short.tobytes() + packed)
            yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array(out, pa.binary())], names=["tid", "vector"])

    return run


def _opened(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    values = np.frombuffer(blob, np.uint32, n, 8)
    raw = pa.decompress(blob[8 + 4 * n :], 4 * n, codec="zstd", asbytes=True) if n else b""
    return values, np.frombuffer(raw, np.float32).astype(np.float64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    either = float(a[1].sum() + b[1].sum()) - both
    return both / either if either else 0.0


def _similar(least: float):
    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            keep = [
                weighted_jaccard(_opened(x), _opened(y)) >= least - 1e-9
                for x, y in zip(rows["vector_a"], rows["vector_b"])
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def identified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False
) -> DataFrame:
    """key (the id; nulls first), tid (md5 of the text), and text (bytes) or the ``whole`` row."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("key"),
        F.unhex(F.md5(text)).alias("tid"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole") if whole else text.alias("text"),
    )


def _ordered(pairs: DataFrame, a, b) -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b")


def vectors_of(nodes: DataFrame, docs: DataFrame, reps: DataFrame, shared) -> DataFrame:
    """tid, vector of each distinct tid of ``nodes``, stored."""
    wanted = nodes.distinct().join(reps, "tid").select("key", "tid")
    return stage(
        docs.join(wanted, ["key", "tid"]).select("tid", "text")
        .mapInArrow(_vectors(shared), "tid binary, vector binary")
        .dropDuplicates(["tid"])
    )


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, shared, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b: tids) of at least the similarity, stored."""
    vectors = vectors_of(pairs.select(F.explode(F.array("a", "b")).alias("tid")), docs, reps, shared)

    def side(name: str) -> DataFrame:
        return vectors.select(F.col("tid").alias(name), F.col("vector").alias(f"vector_{name}"))

    return stage(
        pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "vector_a", "vector_b")
        .mapInArrow(_similar(similarity), "a binary, b binary")
    )


def _bounds(xs: list, ys: list) -> np.ndarray:
    """Upper bounds of the shared weight of each x and y: sum of sqrt(a b) >= sum of min(a, b)."""
    docs = xs + ys
    row = np.repeat(np.arange(len(docs)), [len(v) for v, _ in docs])
    _, column, seen = np.unique(np.concatenate([v for v, _ in docs]), return_inverse=True, return_counts=True)
    root = np.sqrt(np.concatenate([w for _, w in docs])).astype(np.float32)
    shared = np.flatnonzero(seen > 1)
    place = np.full(len(seen), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    total = np.zeros((len(xs), len(ys)), np.float32)
    for at in range(0, len(shared), COLUMNS_AT_ONCE):
        here = (column >= at) & (column < at + COLUMNS_AT_ONCE)
        dense = np.zeros((len(docs), COLUMNS_AT_ONCE), np.float32)
        dense[row[here], column[here] - at] = root[here]
        total += dense[: len(xs)] @ dense[len(xs) :].T
    return total


def _block_links(least: float):
    """Links that join classes between the outer texts (side 0) and the others of two blocks."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        side = [[i for i, x in enumerate(rows["outer"]) if x == o] for o in (True, False)]
        found: tuple[list, list] = ([], [])
        if side[0] and side[1]:
            docs = [[_opened(rows["vector"][i]) for i in members] for members in side]
            sums = [np.array([w.sum() for _, w in d]) for d in docs]
            need = least / (1 + least) * (sums[0][:, None] + sums[1][None, :])
            close = _bounds(*docs) >= need * (1 - 1e-4)
            bands = [np.array([rows["bands"][i] for i in members]) for members in side]
            this = int(np.flatnonzero(bands[0][0] == rows["band"][0])[0])
            for k in range(this):  # a pair is compared in the first band that it shares
                close &= bands[0][:, k][:, None] != bands[1][:, k][None, :]
            merged: dict[bytes, bytes] = {}

            def find(x: bytes) -> bytes:
                while x in merged:
                    x = merged[x]
                return x

            for i, j in zip(*np.nonzero(close)):
                x, y = side[0][i], side[1][j]
                rx, ry = find(rows["root"][x]), find(rows["root"][y])
                if rx != ry and weighted_jaccard(docs[0][i], docs[1][j]) >= least - 1e-9:
                    merged[rx] = ry
                    found[0].append(rows["tid"][x])
                    found[1].append(rows["tid"][y])
        return pa.table({"a": pa.array(found[0], pa.binary()), "b": pa.array(found[1], pa.binary())})

    return run


def links_of_large(inside: DataFrame, sketch: DataFrame, docs, reps, shared, least: float) -> DataFrame:
    """Links between classes in large mixed buckets: each text outside the main class with all.

    ``inside`` has band, tid, root, main (root of the main class), n and outside (texts of the
    bucket, and those outside its main class).
    """
    def part(n: str, by: str):
        return F.pmod(F.xxhash64("tid"), _blocks(n)).cast("int").alias(by)

    def _blocks(n: str):
        return F.ceil(F.col(n) / BLOCK_TEXTS)

    def other(n: str, name: str):
        return F.explode(F.sequence(F.lit(0), (_blocks(n) - 1).cast("int"))).alias(name)

    outer = inside.filter("root <> main").select(
        "band", "tid", "root", part("outside", "i"), other("n", "j"), F.lit(True).alias("outer"))
    inner = inside.select(
        "band", "tid", "root", other("outside", "i"), part("n", "j"), F.lit(False).alias("outer"))
    rows = outer.unionByName(inner)
    bands = sketch.join(rows.select("tid").distinct(), "tid").groupBy("tid").agg(F.min("bands").alias("bands"))
    vectors = vectors_of(rows.select("tid"), docs, reps, shared).join(bands, "tid")
    return stage(
        rows.join(vectors, "tid").groupBy("band", "i", "j")
        .applyInArrow(_block_links(least), "a binary, b binary")
    )


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """key, tid, class_key and class_tid (the least key, tid of its class) of every row."""
    docs = identified(docs, id_col, text_col)
    values, idf = frequent_shingles(docs, max(1, docs.count()))
    shared = docs.sparkSession.sparkContext.broadcast((values.tobytes(), idf.tobytes()))
    sketch = stage(
        docs.mapInArrow(_sketch(shared), "key long, tid binary, bands array<long>")
    )
    reps = stage(sketch.groupBy("tid").agg(F.min("key").alias("key")))
    members = sketch.select("tid", F.explode("bands").alias("band"))
    shared_bands = stage(
        members.groupBy("band").agg(F.min("tid").alias("least"), F.max("tid").alias("greatest"))
        .filter("least < greatest").select("band")
    )
    # Texts of buckets that hold several, each once.
    members = stage(members.join(shared_bands, "band").distinct())
    sizes = stage(members.groupBy("band").agg(F.count(F.lit(1)).alias("n")))
    central = stage(members.join(sizes, "band").groupBy("tid").agg(F.sum("n").alias("score")))
    centers = stage(
        members.join(central, "tid").groupBy("band")
        .agg(F.max_by("tid", F.struct("score", "tid")).alias("center"))
    )
    star = members.join(centers, "band")
    pairs = stage(_ordered(star, F.col("tid"), F.col("center")).distinct())
    links = verified(pairs, docs, reps, shared, similarity)
    roots = stage(components(links))

    mixed = _mixed_buckets(members, sizes, roots)
    more = []
    rest = stage(_pairs_of_small(mixed).join(pairs, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more.append(verified(rest, docs, reps, shared, similarity))
    large = mixed.filter(F.col("n") > SMALL_BUCKET)
    if not large.isEmpty():
        more.append(links_of_large(large, sketch, docs, reps, shared, similarity))
    for links in more:
        roots = extended(roots, links)

    rows = sketch.select("key", "tid").join(
        roots.select(F.col("node").alias("tid"), "root"), "tid", "left"
    ).withColumn("root", F.coalesce("root", "tid"))
    first = rows.groupBy("root").agg(F.min(F.struct("key", "tid")).alias("first"))
    return rows.join(first, "root").select(
        "key", "tid", F.col("first.key").alias("class_key"), F.col("first.tid").alias("class_tid")
    )


def _mixed_buckets(members: DataFrame, sizes: DataFrame, roots: DataFrame) -> DataFrame:
    """band, tid, root, main (the largest class), n, outside, of buckets of several classes."""
    of = stage(
        members.join(roots.select(F.col("node").alias("tid"), "root"), "tid", "left")
        .withColumn("root", F.coalesce("root", "tid"))
    )
    counts = of.groupBy("band", "root").agg(F.count(F.lit(1)).alias("k"))
    mixed = (
        counts.groupBy("band")
        .agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("k", "root")).alias("most"))
        .filter("classes > 1").select("band", F.col("most.root").alias("main"), F.col("most.k").alias("k"))
        .join(sizes, "band").select("band", "main", "n", (F.col("n") - F.col("k")).alias("outside"))
    )
    return stage(of.join(mixed, "band"))


def _pairs_of_small(mixed: DataFrame) -> DataFrame:
    """Pairs (a, b) of one small bucket in different classes: outside the largest, with all."""
    small = mixed.filter(F.col("n") <= SMALL_BUCKET)
    outside = small.filter("root <> main").select("band", F.col("tid").alias("x"), F.col("root").alias("rx"))
    pairs = outside.join(small.select("band", "tid", "root"), "band").filter("rx <> root")
    return _ordered(pairs, F.col("x"), F.col("tid")).distinct()


def classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the least id of its class), is_first (its text stands for the class)."""
    found = near_duplicates(docs, similarity, id_col, text_col)

    def shown(c: str):
        return F.when(F.col(c) != NULL_ID, F.col(c))

    return found.select(
        shown("key").alias("doc_id"), shown("class_key").alias("class_id"),
        ((F.col("key") == F.col("class_key")) & (F.col("tid") == F.col("class_tid"))).alias("is_first"),
    )


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each class: that of least id.  Of equal rows one stays."""
    found = near_duplicates(docs, similarity, id_col, text_col)
    keep = found.select(F.col("class_key").alias("key"), F.col("class_tid").alias("tid")).distinct()
    rows = identified(docs, id_col, text_col, whole=True)
    each = W.partitionBy("key", "tid").orderBy(F.lit(0))
    kept = rows.join(keep, ["key", "tid"]).withColumn("nth", F.row_number().over(each))
    return kept.filter("nth = 1").select("whole.*")
