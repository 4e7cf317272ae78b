"""Phrase collocations by dynamic itemset counting.

The texts are split once and stored as runs of numbered words with their vocabulary, dealt into
``SHARDS`` shards that are scanned in turn, round and round.  Phrases of all lengths are counted in the same scans.  Words are counted from the first scan on; a
longer phrase joins in as soon as the counters of both its subphrases (without its last and
without its first word) have reached the threshold, while these may still be counting, and
stays until it has been counted in every shard once.  The scans end when no phrase is left
that has not completed its cycle.

Which phrases have reached the threshold is broadcast as a bit table of bounded size (at most
``FILTER_BITS``).  Bits are only ever added, and a scan also gets the table of one cycle before:
a phrase is counted while both subphrases are in the first table and not both in the second.
So every phrase is counted in exactly as many successive scans as there are shards, and the
table's rare false positives cost work but change no count.  Tasks count within runs of
``WORDS_AT_ONCE`` words, Spark sums by phrase with map-side combination, and only phrases that
are within their cycle, or have completed it with the threshold reached, are kept from scan to
scan, as a stored table.

Words and phrases are per language (null: ``und``).  A-Z are lower-cased; pieces end at
``.,;:!?`` and line ends, words at spaces and tabs.  Null and empty texts have no words, rows
without an id and repeated rows count like others, an empty table gives an empty result, and
extra columns are not read.  Long texts are counted whole.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crosspanel.llm.text import WordHashes
from crosspanel.session import release, stage, stage_dir

SHARDS = 2
LONGEST = 4
FILTER_BITS = 1 << 27
BITS_PER_PHRASE = 128
RUN_WORDS = 1 << 16
WORDS_AT_ONCE = 1 << 20

# Fixed value: lower-cases A-Z, writes every separator of pieces as "." and tabs as spaces.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c
    for c in range(256)
)
COUNTS = "lang string, k int, phrase binary, n long"
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens_of(text: bytes) -> list[bytes]:
    """Words, with b"." between pieces."""
    return text.translate(FOLD).replace(b".", b" . ").split()


def extend(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hash of what precedes its last word and that of the word."""
    out = (hashes ^ words) * M1
    out ^= out >> np.uint64(31)
    out *= M2
    return out ^ (out >> np.uint64(29))


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash in a table of ``bits`` bits (a power of two)."""
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def has(table: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    found = np.full(len(hashes), table is not None)
    if table is not None:
        for at in places(hashes, 64 * len(table)):
            found &= (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def lang_seed(lang: str, hashes: WordHashes) -> np.uint64:
    return np.uint64(hashes[b"lang:" + lang.encode()])


def exact_codes(ids: np.ndarray, at: np.ndarray, k: int, n_words: int) -> np.ndarray:
    """Equal numbers for equal phrases of ``k`` words at the places ``at``."""
    code, most = ids[at], n_words
    for j in range(1, k):
        if most * n_words >= 1 << 62:
            values, code = np.unique(code, return_inverse=True)
            most = len(values)
        code, most = code * n_words + ids[at + j], most * n_words
    return code


def count_run(lang: str, ids: np.ndarray, words: list[bytes], reached, before, words_too: bool, longest: int,
              hashes: WordHashes) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """k, phrases and their counts in a run of words; k = 0 has the number of words.

    ``ids`` are places in ``words``, 0 between pieces.  ``reached`` and ``before`` are the bit
    tables of now and of one cycle ago.
    """
    if words_too:
        counts = np.bincount(ids, minlength=len(words))
        yield 0, [b""], np.array([len(ids) - counts[0]])
        yield 1, words[1:], counts[1:]
    if reached is None:
        return
    h = hashes.of(words)
    hashed = extend(np.full(len(h), lang_seed(lang, hashes)), h)
    now, then = has(reached, hashed), has(before, hashed)
    now[0] = False
    # Places at which a phrase of k - 1 words starts that has reached the threshold, the hash of
    # that phrase, and whether it had reached it a cycle ago.
    at = np.flatnonzero(now[ids])
    hashed, then = hashed[ids[at]], then[ids[at]]
    for k in range(2, longest + 1):
        # Of two such phrases one word apart, the first is the prefix and the second the suffix.
        both = np.flatnonzero(np.diff(at) == 1)
        counted = then[both] & then[both + 1]  # the phrase was active a cycle ago
        fresh = both[~counted]
        if len(fresh):
            _, first, counts = np.unique(
                exact_codes(ids, at[fresh], k, len(words)), return_index=True, return_counts=True)
            some = ids[at[fresh[first]][:, None] + np.arange(k)].tolist()
            yield k, [b" ".join([words[i] for i in phrase]) for phrase in some], counts
        if k < longest:
            hashed = extend(hashed[both], h[ids[at[both] + k - 1]])
            there = has(reached, hashed)
            at, hashed = at[both[there]], hashed[there]
            then = counted[there] & has(before, hashed)


class Held:
    """Words of several texts of a language as places in a growing vocabulary, 0 between pieces."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.number[b"."]  # 0
        self.ids: list[np.ndarray] = []

    def add(self, words: list[bytes], ids: np.ndarray | None = None) -> int:
        """Append ``words``, or, with ``ids``, the words at those places of ``words``."""
        at = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
        self.ids.append(at if ids is None else at[ids])
        return len(self.ids[-1])


def split_texts(shards: int):
    """A ``mapInArrow`` function: texts as runs of up to about ``RUN_WORDS`` words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Held] = {}

        def written() -> Iterator[pa.RecordBatch]:
            for lang, h in held.items():
                ids = np.concatenate(h.ids).tobytes()
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang]), "words": pa.array([b" ".join(h.number)], pa.binary()),
                    "ids": pa.array([ids], pa.binary()), "shard": pa.array([crc32(ids) % shards], pa.int32())})
            held.clear()

        n = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = held.setdefault(lang, Held())
                n += h.add(tokens_of(text)) + h.add([b"."])
                if n >= RUN_WORDS:
                    yield from written()
                    n = 0
        yield from written()

    return run


def scan(tables, words_too: bool, longest: int):
    """A ``mapInArrow`` function over lang, words and ids: the counts of up to ``WORDS_AT_ONCE``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached, before = tables.value
        hashes = WordHashes()
        held: dict[str, Held] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, h in held.items():
                for k, phrases, n in count_run(
                    lang, np.concatenate(h.ids).astype(np.int64), list(h.number), reached, before, words_too, longest, hashes
                ):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(phrases), pa.string()), pa.array([k] * len(phrases), pa.int32()),
                        pa.array(phrases, pa.binary()), pa.array(n, pa.int64()),
                    ], names=["lang", "k", "phrase", "n"])
            held.clear()

        n = 0
        for batch in batches:
            for i in range(batch.num_rows):
                lang, words, ids = (batch.column(c)[i].as_py() for c in range(3))
                n += held.setdefault(lang, Held()).add(words.split(b" "), np.frombuffer(ids, np.int32))
                if n >= WORDS_AT_ONCE:
                    yield from counted()
                    n = 0
        yield from counted()

    return run


def _bits(bits: int):
    """A ``mapInArrow`` function: the words of the bit table that a phrase sets bits in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            h = np.empty(batch.num_rows, np.uint64)
            for i, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                out = np.array([lang_seed(lang, hashes)], np.uint64)
                for word in phrase.split(b" "):
                    out = extend(out, np.array([hashes[word]], np.uint64))
                h[i] = out[0]
            for at in places(h, bits):
                yield pa.RecordBatch.from_pydict({
                    "word": (at >> np.uint64(6)).astype(np.int64),
                    "bits": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    return run


def with_phrases(table: np.ndarray, phrases: DataFrame) -> np.ndarray:
    """``table`` with the bits of lang, phrase; at most as many rows as it has reach the driver."""
    rows = (
        phrases.select("lang", "phrase").mapInArrow(_bits(64 * len(table)), "word long, bits long")
        .groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    )
    out = table.copy()
    out[rows.column("word").to_numpy()] |= rows.column("bits").to_numpy().view(np.uint64)
    return out


def frequent_phrases(
    docs: DataFrame,
    threshold: int = 30,
    text_col: str = "text",
    lang_col: str = "lang",
    shards: int = SHARDS,
    longest: int = LONGEST,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """lang, k, phrase (binary), f for all phrases of 1 to ``longest`` words with f >= threshold.

    k = 0 has the number of words of a language, whatever it is.
    """
    spark = docs.sparkSession
    path = f"{stage_dir(spark)}/staged-{uuid.uuid4().hex}"
    schema = "lang string, words binary, ids binary, shard int"
    docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"),
    ).mapInArrow(split_texts(shards), schema).write.partitionBy("shard").parquet(path)
    texts = spark.read.schema(schema).parquet(path)
    # The bit tables of the last cycle, the newest at the end; none before a phrase has reached.
    tables: list[np.ndarray | None] = [None] * (shards + 1)
    state, step = None, 0
    while True:
        shared = spark.sparkContext.broadcast((tables[-1], tables[0]))
        rows = (
            texts.filter(F.col("shard") == step % shards).select("lang", "words", "ids")
            .mapInArrow(scan(shared, step < shards, longest), COUNTS)
            .select("*", F.lit(step).alias("born"), F.lit(False).alias("reached"))
        )
        if state is not None:
            rows = rows.union(state.filter(~F.col("done")).drop("done"))
        rows = rows.groupBy("lang", "k", "phrase").agg(
            F.sum("n").alias("n"), F.min("born").alias("born"), F.max("reached").alias("old"))
        reached = F.col("n") >= threshold
        # A phrase that first occurred in this cycle may still miss shards.
        complete = F.when(F.col("k") < 2, step >= shards - 1).otherwise(F.col("born") <= step - shards + 1)
        rows = rows.filter(~complete | reached | (F.col("k") == 0)).select(
            "lang", "k", "phrase", "n", "born", reached.alias("reached"), complete.alias("done"),
            (reached & ~F.col("old") & (F.col("k") > 0) & (F.col("k") < longest)).alias("new"))
        if state is not None:
            rows = rows.union(state.filter("done").withColumn("new", F.lit(False)))
        previous, stored = state, stage(rows)
        shared.unpersist()
        state, step = stored.drop("new"), step + 1
        if previous is not None:
            release(before)
        before = stored
        n = stored.filter("new").count()
        table = tables[-1]
        if n:
            if table is None:
                bits = 1 << 12
                while bits < min(filter_bits, BITS_PER_PHRASE * n):
                    bits *= 2
                table = np.zeros(min(bits, filter_bits) // 64, np.uint64)
            table = with_phrases(table, stored.filter("new"))
        tables = [*tables[1:], table]
        same = tables[0] is table or (tables[0] is not None and np.array_equal(tables[0], table))
        if step >= shards and same:
            break
    # Nothing has reached the threshold within the last cycle, so every phrase has completed its own.
    return state.filter("reached or k = 0").select("lang", "k", "phrase", F.col("n").alias("f"))


def collocations(
    docs: DataFrame,
    threshold: int = 30,
    top: int = 2000,
    absorb_percent: int = 80,
    text_col: str = "text",
    lang_col: str = "lang",
    shards: int = SHARDS,
    longest: int = LONGEST,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language.

    a is the phrase's count, l and r those of its parts at its lowest-scoring cut, n the words of
    the language, score floor(2000000 * a / (l + r)).  A phrase that lies in a longer one with at
    least ``absorb_percent`` of its count is left out.
    """
    counted = frequent_phrases(docs, threshold, text_col, lang_col, shards, longest, filter_bits)
    counted = stage(counted.withColumn("phrase", F.col("phrase").cast("string")))
    long_ones = counted.filter("k >= 2").withColumn("words", F.split("phrase", " "))

    def part(first, size):
        return F.array_join(F.slice("words", first, size), " ")

    # Parts of a phrase are counted at least as often as it is, so they are all in the table.
    totals = counted.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("f").alias("_f"))
    cuts = long_ones.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(
        F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    for side, text in (("l", part(F.lit(1), F.col("cut"))), ("r", part(F.col("cut") + 1, F.size("words")))):
        cuts = cuts.withColumn("side", text).join(
            totals, (F.col("lang") == F.col("_lang")) & (F.col("side") == F.col("_phrase"))
        ).withColumnRenamed("_f", side).drop("_lang", "_phrase", "side")
    score = F.expr("(2000000 * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + r)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    def parts_of(size):
        starts = F.sequence(F.lit(1), F.col("k") - size + 1)
        return F.when(F.col("k") > size, F.transform(starts, lambda i: part(i, F.lit(size)))).otherwise(
            F.array().cast("array<string>"))

    inner_parts = F.flatten(F.array(*[parts_of(size) for size in range(2, longest)]))
    inner = (
        long_ones.filter("k >= 3")
        .select("lang", F.col("f").alias("longer"), F.explode(inner_parts).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    )
    absorbed = inner.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), "longer")
    kept = best.join(
        absorbed,
        (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase"))
        & (F.expr("100 * cast(longer as decimal(20, 0))") >= F.expr(f"{absorb_percent} * cast(a as decimal(20, 0))")),
        "left_anti",
    )
    order = W.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    words = counted.filter("k = 0").select(F.col("lang").alias("_lang"), F.col("f").alias("n"))
    # One row per language.
    return ranked.join(words, F.col("lang") == F.col("_lang")).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a",
        F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n",
        F.col("best.score").cast("long").alias("score"))
