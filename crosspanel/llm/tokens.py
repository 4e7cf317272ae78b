"""Token counts from pre-token counts.

No piece of the vocabulary continues over a white-space mark that follows another character,
nor over a newline, so no merge crosses these boundaries (``assert_splittable`` proves it for
a given model) and a text's count is the sum over its pre-tokens: a run of spaces with the
word after it, or a newline with what follows it up to the next boundary.

1. Every task lists its distinct pre-tokens; over all tasks each distinct one is encoded once.
2. The most widespread pre-tokens are broadcast, at most ``hot`` keys of at most ``HOT_BYTES``
   bytes (a longer one is known by its digest, so a rule of dashes or a footer's URL is among
   them too); each document sums over its frequencies of these in its task.
3. A document's other pre-tokens, with their frequencies, are joined to the stored counts.
No ids are kept anywhere, and no key holds more than its share: what is common is summed
before the join, and what is joined is rare.

A null or empty text has no token.  Very long texts are counted whole.  Repeated rows are counted each on its own; a null id
stays null.  Extra columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.text import hot_from, map_rows, with_bytes
from crosspanel.session import stage

MARK = "▁"  # what the library writes for a space
HOT = 200_000
HOT_BYTES = 32
DISTINCT_AT_ONCE = 1 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(model_file: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_file)


def assert_splittable(sp) -> None:
    """Raises if a piece could span a boundary between pre-tokens."""
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        inner = MARK in piece.lstrip(MARK) or "\n" in piece
        if inner and not (sp.is_byte(i) or sp.is_control(i)):
            raise ValueError(f"piece {piece!r} spans two pre-tokens")
    if [sp.id_to_piece(i) for i in sp.encode(" a  b")] != [MARK, MARK + "a", MARK, MARK + "b"]:
        raise ValueError("the model drops or folds white space")


def pretokens(text: bytes | None) -> list[bytes]:
    """The text, with the space that the library puts in front, cut before each newline and
    before each run of spaces that follows something else."""
    if not text:
        return []
    text = b" " + text.replace(MARK.encode(), b" ")
    out = []
    for i, line in enumerate(text.split(b"\n")):
        head = b"\n" if i else b""
        run = 0
        words = line.split(b" ")
        if head or words[0]:
            out.append(head + words[0])
        for word in words[1:]:
            run += 1
            if word:
                out.append(b" " * run + word)
                run = 0
        if run:
            out.append(b" " * run)
    return out


def join_key(pretoken: bytes) -> bytes:
    """What a pre-token is looked up by: itself, or a digest of one over ``HOT_BYTES``.  No
    pre-token starts with the byte 0xFF."""
    return pretoken if len(pretoken) <= HOT_BYTES else b"\xff" + md5(pretoken).digest()


def count_pieces(sp, pretoken: bytes) -> int:
    """Pieces of one pre-token.  The library puts a space in front of what it encodes."""
    if pretoken[:1] == b"\n":
        return len(sp.encode(pretoken.decode("utf-8", "replace"))) - 1
    rest = pretoken[1:].decode("utf-8", "replace")
    return len(sp.encode(rest)) if rest else 1


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs_with: Counter = Counter()

    def flush():
        batch = pa.RecordBatch.from_pydict({
            "pretoken": pa.array(list(docs_with), pa.binary()),
            "docs": pa.array(list(docs_with.values()), pa.int64()),
        })
        docs_with.clear()
        return batch

    for batch in batches:
        for text in batch.column(0).to_pylist():
            docs_with.update(set(pretokens(text)))
            if len(docs_with) >= DISTINCT_AT_ONCE:
                yield flush()
    yield flush()


def _encode(model_file: str):
    sp = load(model_file)

    def apply(rows: dict) -> dict:
        return rows | {"pieces": [count_pieces(sp, p) for p in rows["pretoken"]]}

    return apply


def _sum_hot(shared):
    def make():
        hot = shared.value

        def apply(rows: dict) -> dict:
            out: dict = {c: [] for c in ("n_bytes", "hot_tokens", "cold", "times")}
            for text in rows["text"]:
                total, cold, times = 0, [], []
                for p, k in Counter(pretokens(text)).items():
                    key = join_key(p)
                    n = hot.get(key)
                    if n is None:
                        cold.append(key)
                        times.append(k)
                    else:
                        total += n * k
                for c, v in (("n_bytes", len(text or b"")), ("hot_tokens", total), ("cold", cold), ("times", times)):
                    out[c].append(v)
            return rows | out

        return apply

    return make


def count_tokens(
    docs: DataFrame,
    model_file: str | None = None,
    limit: int = 4096,
    hot: int = HOT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit.  Every executor must find ``model_file``."""
    model_file = model_file or default_model()
    assert_splittable(load(model_file))
    spark = docs.sparkSession
    docs = with_bytes(docs, id_col, text_col)
    schema = [("pretoken", pa.binary()), ("docs", pa.int64()), ("pieces", pa.int64())]
    vocabulary = stage(
        docs.select("text").mapInArrow(_distinct, "pretoken binary, docs long")
        .groupBy("pretoken").agg(F.sum("docs").alias("docs"))
        .mapInArrow(map_rows(partial(_encode, model_file), ["pretoken", "docs"], pa.schema(schema)),
                    "pretoken binary, docs long, pieces long")
    )
    # At most ``hot`` keys of HOT_BYTES each, pre-tokens of any length among them.
    key = F.when(F.octet_length("pretoken") <= HOT_BYTES, F.col("pretoken")).otherwise(
        F.concat(F.unhex(F.lit("FF")), F.unhex(F.md5("pretoken"))))
    keys = vocabulary.select(key.alias("key"), "pieces", F.floor(F.log2("docs") * 16).alias("spread"))
    least = hot_from(keys, hot)
    widest = keys.filter(F.col("spread") >= least).select("key", "pieces").toArrow()
    shared = spark.sparkContext.broadcast(
        dict(zip(widest["key"].to_pylist(), widest["pieces"].to_pylist()))
    )
    row = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("hot_tokens", pa.int64()),
                     ("cold", pa.list_(pa.binary())), ("times", pa.list_(pa.int64()))])
    # Stored, so that the row number that ties a document to its sum is fixed.
    rows = stage(
        docs.mapInArrow(map_rows(_sum_hot(shared), ["doc_id", "text"], row),
                        "doc_id long, n_bytes long, hot_tokens long, cold array<binary>, times array<long>")
        .withColumn("row", F.monotonically_increasing_id())
    )
    rare = (
        rows.select("row", F.inline(F.arrays_zip("cold", "times")))
        .join(keys.filter(F.col("spread") < least).select(F.col("key").alias("cold"), "pieces"), "cold")
        .groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("rare_tokens"))
    )
    n_tokens = F.col("hot_tokens") + F.coalesce("rare_tokens", F.lit(0))
    return rows.select("row", "doc_id", "n_bytes", "hot_tokens").join(rare, "row", "left").select(
        "doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit")
    )
