"""Splitting of UTF-8 texts shared by the operators.

Texts reach Python as bytes.  ``bytes.split()`` cuts at exactly the six ASCII white-space
characters, and every byte of a non-ASCII character is 0x80 or above, so both word patterns
used here can be applied to bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: lower-cases A-Z, keeps 0-9, a-z and all non-ASCII bytes, blanks the rest.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def folded_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; none of a null."""
    return text.translate(FOLD).split() if text else []


def raw_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, unchanged; none of a null."""
    return text.split() if text else []


def with_bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, as bytes: other columns, clashing names included, stay behind."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")
    )


def map_rows(
    make: Callable[[], Callable[[dict], dict]], names: list[str], schema: pa.Schema
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function: ``make()`` once per task, its result once per batch of lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            out = apply({n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names})
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[f.name], type=f.type) for f in schema], schema=schema
            )

    return run


class WordHashes(dict):
    """64-bit hashes of words; forgets all of them when it holds too many."""

    MOST = 1 << 20

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def hot_from(counted: DataFrame, hot: int) -> int:
    """The least ``spread`` (a logarithm of how often a key occurs) that ``hot`` keys at most reach."""
    by_spread = dict(counted.groupBy("spread").count().collect())
    least, held = max(by_spread, default=0) + 1, 0
    for spread in sorted(by_spread, reverse=True):
        held += by_spread[spread]
        if held > hot:
            break
        least = spread
    return least
