"""Removal of repeated word windows by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one document.  Its minimiser is the least hash
among its runs of ``SEED`` words, so equal windows have equal minimisers.  Consecutive windows
that share a minimiser travel as one packed string (a super-k-mer) to the minimiser's bucket;
there a sort brings equal windows together, their words are compared, and all but the earliest
(by document, then start) are reported.  A word covered by a reported window is removed.

Scale.  Each unit of ``UNIT_WORDS`` words first drops its own later copies of a window, so a
passage in a third of all documents reaches its bucket once per unit, not once per document.
Buckets hold about ``BUCKET_WINDOWS`` windows, as many as the input needs.  Minimisers that
take more than ``HOT_SHARE`` of the windows of a sample are split: their windows travel alone,
to the bucket of their whole word sequence.  They meet in two levels: the units are dealt into
as many groups as there are units in a group, each group keeps the earliest of each window, and
these meet in the bucket.  So a window that every unit has reaches no task more often than the
root of the number of units.  The sample steers the split only, never a result.

Rows equal in id and text are one document, and each gets its result.  Rows equal in id alone
are told apart by the md5 of their texts and ordered by it.  A null id comes before all others.  Null and empty
texts have no words; documents of fewer words than a window keep all.  An empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.text import map_rows, raw_words
from crosspanel.session import stage

WINDOW = 20
SEED = 3
UNIT_WORDS = 500_000
BUCKET_WINDOWS = 400_000
HOT_SHARE = 1e-3
NULL_ID = -(2**63)

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(31)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _MIX
    return (x ^ (x >> _SHIFT)) * _ODD


def _runs_hash(values: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` values."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    values = _mixed(values)
    out = values[:n].copy()
    for j in range(1, length):
        out *= _ODD
        out += values[j : j + n]
    return _mixed(out)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, values
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def first_of_equal(ids: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each start, the index (in ``starts``) of the first window of equal ids.

    Windows are sorted by hash; neighbours of equal hash are compared id by id, and if a hash
    covers different windows all are compared by their ids instead.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    key = _runs_hash(ids.astype(np.uint64), length)[starts]
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(starts), bool)
    same[1:] = key[order][1:] == key[order][:-1]
    at = np.flatnonzero(same)
    offsets = np.arange(length)
    for piece in np.array_split(at, max(1, len(at) // 100_000 + 1)):
        a, b = starts[order[piece]][:, None] + offsets, starts[order[piece - 1]][:, None] + offsets
        if (ids[a] != ids[b]).any():
            rows = ids[starts[:, None] + offsets]
            _, index, inverse = np.unique(rows, axis=0, return_index=True, return_inverse=True)
            return index[inverse.ravel()]
    leader = np.maximum.accumulate(np.where(same, 0, np.arange(len(starts))))
    first = np.empty(len(starts), np.int64)
    first[order] = order[leader]
    return first


class Owners:
    """Documents by place: id and digest of the text, whose order is the order of documents."""

    def __init__(self, key: np.ndarray, digest: np.ndarray):
        self.key, self.digest = key, digest  # int64 [n], uint64 [n, 2]

    @classmethod
    def of(cls, documents: list[tuple[int, bytes]]) -> Owners:
        digest = np.frombuffer(b"".join(d for _, d in documents), ">u8").astype(np.uint64)
        return cls(np.array([k for k, _ in documents], np.int64), digest.reshape(-1, 2))

    def __getitem__(self, at) -> Owners:
        return Owners(self.key[at], self.digest[at])

    def columns(self) -> list[pa.Array]:
        raw = self.digest.astype(">u8").tobytes()
        return [pa.array(self.key), pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())]

    def order(self, *before: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sort keys for ``lexsort``: by document, then by ``before``."""
        return (*before, self.digest[:, 1], self.digest[:, 0], self.key)

    def same_as(self, other: Owners) -> np.ndarray:
        return (self.key == other.key) & (self.digest == other.digest).all(1)


class Unit:
    """Documents of one task, in (id, digest) order, as one run of words."""

    def __init__(self, docs: dict[tuple[int, bytes], list[bytes]], window: int, seed: int):
        names = sorted(docs)
        self.owners = Owners.of(names)
        lists = [docs[k] for k in names]
        self.words = list(chain.from_iterable(lists))
        sizes = np.array([len(x) for x in lists], np.int64)
        ends = np.cumsum(sizes)
        self.doc = np.repeat(np.arange(len(lists)), sizes)
        self.begin = ends - sizes
        at = np.arange(len(self.words))
        self.valid = at + window <= ends[self.doc] if len(at) else np.zeros(0, bool)
        number: dict[bytes, int] = defaultdict(count().__next__)
        self.ids = np.fromiter(map(number.__getitem__, self.words), np.int64, len(self.words))
        import xxhash

        table = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
        self.hashes = table[self.ids] if len(number) else np.zeros(0, np.uint64)
        self.minimiser = np.zeros(len(self.words), np.uint64)
        if len(self.words) >= window:
            least = _sliding_min(_runs_hash(self.hashes, seed), window - seed + 1)
            self.minimiser[: len(least)] = least


def _units(batches: Iterator[pa.RecordBatch], window: int, seed: int) -> Iterator[Unit]:
    docs: dict[tuple[int, bytes], list[bytes]] = {}
    held = 0
    for batch in batches:
        for key, digest, text in zip(*(c.to_pylist() for c in batch.columns)):
            words = docs[key, digest] = raw_words(text)
            held += len(words)
            if held >= UNIT_WORDS:
                yield Unit(docs, window, seed)
                docs, held = {}, 0
    if docs:
        yield Unit(docs, window, seed)


def _sampled_minimisers(window: int, seed: int):
    def run(batches):
        for unit in _units(batches, window, seed):
            values, times = np.unique(unit.minimiser[unit.valid], return_counts=True)
            yield pa.RecordBatch.from_pydict({
                "minimiser": pa.array(values.view(np.int64)), "windows": pa.array(times, pa.int64())})

    return run


PACKED = pa.schema([
    ("bucket", pa.int64()), ("key", pa.int64()), ("digest", pa.binary()), ("start", pa.int64()),
    ("windows", pa.int64()), ("packed", pa.binary()),
])
PACKED_DDL = "bucket long, key long, digest binary, start long, windows long, packed binary"
FOUND = ["key", "digest", "start", "windows"]


def _pack(owners: Owners, starts: np.ndarray, words: list[list[bytes]]) -> bytes:
    head = np.array([len(starts)], np.int64).tobytes()
    sizes = np.array([len(w) for w in words], np.int32).tobytes()
    body = b" ".join(chain.from_iterable(words))
    raw = head + owners.key.tobytes() + owners.digest.tobytes() + starts.astype(np.int32).tobytes() + sizes + body
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def _unpack(blob: bytes):
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    keys = np.frombuffer(raw, np.int64, n, 8)
    digests = np.frombuffer(raw, np.uint64, 2 * n, 8 + 8 * n).reshape(n, 2)
    starts = np.frombuffer(raw, np.int32, n, 8 + 24 * n)
    sizes = np.frombuffer(raw, np.int32, n, 8 + 28 * n)
    return keys, digests, starts, sizes, raw[8 + 32 * n :].split(b" ")


def _packed_rows(buckets: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets, pa.int64()), *[pa.nulls(len(blobs), f.type) for f in list(PACKED)[1:5]],
         pa.array(blobs, pa.binary())], schema=PACKED)


def _found_rows(buckets: np.ndarray, owners: Owners, starts: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets), *owners.columns(), pa.array(starts.astype(np.int64)),
         pa.array(windows.astype(np.int64)), pa.nulls(len(starts), pa.binary())], schema=PACKED)


def _intervals(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First members and lengths of the runs of consecutive numbers in sorted ``at``."""
    edge = np.flatnonzero(np.diff(at, prepend=at[:1] - 2) != 1)
    return at[edge], np.diff(edge, append=len(at))


def _to_buckets(window: int, seed: int, buckets: int, groups: int, hot: np.ndarray):
    """Super-k-mers of each unit by bucket, and the windows repeated inside the unit.

    Windows of a hot minimiser go to the buckets from ``buckets`` on: one for each bucket and
    group of units.
    """

    def run(batches):
        for u in _units(batches, window, seed):
            starts = np.flatnonzero(u.valid)
            first = first_of_equal(u.ids, starts, window)
            repeated = first != np.arange(len(starts))
            if repeated.any():
                begin, n = _intervals(starts[repeated])
                doc = u.doc[begin]
                spread = _mixed(u.owners.key[doc].view(np.uint64)) % np.uint64(buckets)
                yield _found_rows(spread.astype(np.int64), u.owners[doc], begin - u.begin[doc], n)
            starts = starts[~repeated]
            if not len(starts):
                continue
            value = u.minimiser[starts]
            alone = np.isin(value, hot)
            if alone.any():
                value[alone] = _runs_hash(u.hashes, window)[starts[alone]]
            cut = np.ones(len(starts), bool)
            cut[1:] = (np.diff(starts) != 1) | (value[1:] != value[:-1]) | alone[1:]
            head = np.flatnonzero(cut)
            length = np.diff(head, append=len(starts))
            begin = starts[head]
            doc = u.doc[begin]
            bucket = (_mixed(value[head]) % np.uint64(buckets)).astype(np.int64)
            group = int(u.owners.digest[0, 0] % np.uint64(groups))
            bucket = np.where(alone[head], buckets + bucket * groups + group, bucket)
            local = begin - u.begin[doc]
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            rows, blobs = [], []
            for some in np.split(order, edges[1:]):
                words = [u.words[begin[i] : begin[i] + length[i] + window - 1] for i in some]
                blobs.append(_pack(u.owners[doc[some]], local[some], words))
                rows.append(int(bucket[some[0]]))
                if len(rows) >= 256:
                    yield _packed_rows(rows, blobs)
                    rows, blobs = [], []
            if rows:
                yield _packed_rows(rows, blobs)

    return run


def _repeats_of_bucket(window: int, buckets: int, groups: int):
    """The windows of one bucket that start earlier elsewhere; passes on what units found.

    Of a bucket of one group of units, also the earliest of each window, for the bucket where
    the groups meet.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        known = table.filter(table["packed"].is_null())
        blobs = [b for b in table["packed"].to_pylist() if b is not None]
        if not blobs:
            return known
        parts = [_unpack(b) for b in blobs]
        keys, digests, begin, sizes = (np.concatenate([p[i] for p in parts]) for i in range(4))
        owners = Owners(keys, digests)
        number: dict[bytes, int] = defaultdict(count().__next__)
        ids = np.concatenate([np.fromiter(map(number.__getitem__, p[4]), np.int64, len(p[4])) for p in parts])
        ends = np.cumsum(sizes.astype(np.int64))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.flatnonzero(np.arange(len(ids)) + window <= ends[owner])
        first = first_of_equal(ids, starts, window)
        owner = owner[starts]
        place = starts - (ends - sizes)[owner] + begin[owner]
        member = np.arange(len(starts))
        if bucket < buckets:  # only windows that are there more than once matter
            member = np.flatnonzero(np.isin(first, first[first != member]))
        # Sorted by window, then document and start: the first of each window stays, and so
        # does another reading of the same place.
        order = np.lexsort((*owners[owner[member]].order(place[member]), first[member]))
        member = member[order]
        if not len(member):
            return known
        lead = np.diff(first[member], prepend=-1) != 0
        leader = member[np.maximum.accumulate(np.where(lead, np.arange(len(member)), 0))]
        same = owners[owner[member]].same_as(owners[owner[leader]]) & (place[member] == place[leader])
        out = [known]
        if bucket >= buckets:
            earliest = member[lead]
            vocabulary = list(number)
            words = [[vocabulary[i] for i in ids[s : s + window].tolist()] for s in starts[earliest].tolist()]
            blob = _pack(owners[owner[earliest]], place[earliest], words)
            out.append(pa.Table.from_batches([_packed_rows([(bucket - buckets) // groups], [blob])]))
        late = member[~same]
        if len(late):
            order = np.lexsort(owners[owner[late]].order(place[late]))
            who, place = owners[owner[late[order]]], place[late[order]]
            edge = np.ones(len(place), bool)
            edge[1:] = ~who[1:].same_as(who[:-1]) | (np.diff(place) > 1)
            at = np.flatnonzero(edge)
            span = np.append(place[at[1:] - 1], place[-1:]) - place[at] + 1
            out.append(pa.Table.from_batches([_found_rows(np.full(len(at), bucket), who[at], place[at], span)]))
        return pa.concat_tables([t.cast(PACKED) for t in out])

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, seed: int = SEED, sample_rows: int = 2000) -> DataFrame:
    """key, digest, start, windows: runs of windows that start earlier elsewhere (or in an equal
    run twice).  ``docs`` has key, digest and text (bytes)."""
    n_docs = docs.count()
    share = min(1.0, sample_rows / max(1, n_docs))
    sampled = (
        docs.sample(share, 11).mapInArrow(_sampled_minimisers(window, seed), "minimiser long, windows long")
        .groupBy("minimiser").agg(F.sum("windows").alias("windows"))
    )
    total = sampled.agg(F.sum("windows")).first()[0] or 0
    often = sampled.filter(F.col("windows") > max(1.0, HOT_SHARE * total)).select("minimiser").collect()
    hot = np.array([r.minimiser for r in often], np.int64).view(np.uint64)
    buckets = max(1, round(total / share / BUCKET_WINDOWS))
    groups = math.isqrt(int(total / share / UNIT_WORDS)) + 1
    # What the buckets return is short: runs of repeated windows, and the hot windows of a group.
    found = stage(
        docs.mapInArrow(_to_buckets(window, seed, buckets, groups, hot), PACKED_DDL)
        .groupBy("bucket").applyInArrow(_repeats_of_bucket(window, buckets, groups), PACKED_DDL)
    )
    met = (
        found.filter(F.col("packed").isNotNull())
        .groupBy("bucket").applyInArrow(_repeats_of_bucket(window, buckets, groups), PACKED_DDL)
    )
    return found.filter(F.col("packed").isNull()).select(FOUND).union(met.select(FOUND))


def _kept(window: int):
    def apply(rows: dict) -> dict:
        n_words, removed, kept = [], [], []
        for text, spans in zip(rows["text"], rows["spans"]):
            words = raw_words(text)
            stay = bytearray(b"\1") * len(words)
            for span in spans or ():
                a, n = span["start"], span["windows"] + window - 1
                stay[a : a + n] = bytes(n)
            n_words.append(len(words))
            removed.append(len(words) - sum(stay))
            kept.append(b" ".join(compress(words, stay)))
        return {"doc_id": rows["doc_id"], "n_words": n_words, "n_removed": removed, "kept": kept,
                "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}

    return apply


def dedup_substrings(
    docs: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = True,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, ``with_text``, the kept words (kept)."""
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("key"),
        F.unhex(F.md5(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))).alias("digest"),
        F.col(text_col).cast("binary").alias("text"),
    )
    spans = (
        repeated_windows(keyed.select("key", "digest", "text"), window)
        .groupBy("key", "digest").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    )
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    if with_text:
        fields, ddl = [*fields, ("kept", pa.binary())], ddl + ", kept binary"
    out = keyed.join(spans, ["key", "digest"], "left").select("doc_id", "text", "spans").mapInArrow(
        map_rows(partial(_kept, window), ["doc_id", "text", "spans"], pa.schema(fields)), ddl)
    return out.withColumn("kept", F.col("kept").cast("string")) if with_text else out
