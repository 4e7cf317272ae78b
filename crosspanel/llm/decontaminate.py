"""Benchmark decontamination by Wu-Manber search over words.

The texts are strings over an alphabet of words.  Patterns are windows of ``WINDOW`` words
of the benchmark items (an item of fewer words is one pattern).  For each pattern length m a
shift table over blocks of two words tells how far a window may move without missing a
pattern; where the shift is zero, the bucket of that block holds the patterns that end in it,
and direct comparison confirms an occurrence.  Most positions are never looked at.

The search is a narrow pass over the documents.  The patterns are broadcast in blocks of
``block_patterns`` (window, item) pairs at most on average, by hash; a benchmark of several
blocks is searched block by block, each pass staged, so no broadcast grows with the benchmark.

Null, empty and wordless texts have no words and no hit; an item without words has no
pattern.  Equal items and windows shared by items all count.  Repeated documents are judged
each on its own.  Empty tables give an empty result or no hits.
"""

from __future__ import annotations

import uuid
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.text import folded_words, map_rows, with_bytes
from crosspanel.session import stage

WINDOW = 10
BLOCK_PATTERNS = 200_000


class WuManber:
    """Search for word sequences of one length."""

    def __init__(self, length: int, patterns: list[tuple[tuple[bytes, ...], list[str]]]):
        self.length = length
        self.block = min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[str]]] = {}
        for words, items in patterns:
            for end in range(self.block, length + 1):
                key = words[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.buckets.setdefault(words[-self.block :], {})[words] = items

    def search(self, words: list[bytes], hit: bytearray, found: set) -> None:
        n, m, far, shift = len(words), self.length, self.far, self.shift.get
        i = m
        while i <= n:
            key = (words[i - 2], words[i - 1]) if self.block == 2 else (words[i - 1],)
            step = shift(key, far)
            if step:
                i += step
                continue
            items = self.buckets[key].get(tuple(words[i - m : i]))
            if items is not None:
                hit[i - m : i] = b"\1" * m
                found.update(items)
            i += 1


def _windows(size: int):
    def apply(rows: dict) -> dict:
        seqs, items = [], []
        for item, text in zip(rows["doc_id"], rows["text"]):
            words = folded_words(text)
            for i in range(max(1, len(words) - size + 1) if words else 0):
                seqs.append(b" ".join(words[i : i + size]))
                items.append(None if item is None else str(item))
        return {"seq": seqs, "item": items}

    return apply


def patterns(benchmark: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct (window, item) pairs.  An item without an id is searched for as item ``null``."""
    schema = pa.schema([("seq", pa.binary()), ("item", pa.string())])
    return (
        with_bytes(benchmark, id_col, text_col)
        .mapInArrow(map_rows(partial(_windows, size), ["doc_id", "text"], schema),
                    "seq binary, item string")
        .withColumn("item", F.coalesce("item", F.lit("null")))
        .distinct()
    )


# The automata of the block this worker process has last built.
_built: dict[str, list[WuManber]] = {}


def _automata(key: str, rows) -> list[WuManber]:
    if key not in _built:
        _built.clear()
        by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
        for seq, item in rows:
            words = tuple(seq.split(b" "))
            by_length.setdefault(len(words), {}).setdefault(words, []).append(item)
        _built[key] = [WuManber(m, list(p.items())) for m, p in sorted(by_length.items())]
    return _built[key]


def _search(key: str, shared):
    def make():
        automata = _automata(key, shared.value)

        def apply(rows: dict) -> dict:
            hits, items = [], []
            for text, old_hit, old_items in zip(rows["text"], rows["hit"], rows["items"]):
                words = folded_words(text)
                hit = bytearray(old_hit) if old_hit else bytearray(len(words))
                found = set(old_items or ())
                for a in automata:
                    a.search(words, hit, found)
                hits.append(bytes(hit) if found else None)
                items.append(sorted(found))
            return {"doc_id": rows["doc_id"], "text": rows["text"], "hit": hits, "items": items}

        return apply

    return make


def _result(rows: dict) -> dict:
    n_words = [len(folded_words(t)) for t in rows["text"]]
    n_hit = [sum(h) if h else 0 for h in rows["hit"]]
    return {
        "doc_id": rows["doc_id"], "n_words": n_words, "n_hit": n_hit, "items": rows["items"],
        "contaminated": [n > 0 for n in n_hit],
    }


def _searches(benchmark: DataFrame, window: int, item_col: str, item_text_col: str, block_patterns: int):
    """One maker per block of patterns: called, it broadcasts the block and gives the search."""
    pairs = stage(patterns(benchmark, window, item_col, item_text_col))
    n_blocks = max(1, -(-pairs.count() // block_patterns))
    block = F.pmod(F.xxhash64("seq", "item"), F.lit(n_blocks))

    def maker(b: int):
        rows = [(bytes(r.seq), r.item) for r in pairs.filter(block == b).collect()]
        return _search(uuid.uuid4().hex, benchmark.sparkSession.sparkContext.broadcast(rows))

    return [partial(maker, b) for b in range(n_blocks)]


def clean_rows(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_patterns: int = BLOCK_PATTERNS,
) -> DataFrame:
    """The rows of ``docs`` without any hit, all columns as they are."""
    searches = _searches(benchmark, window, item_col, item_text_col, block_patterns)
    for i, search in enumerate(searches):
        docs = docs.mapInArrow(_clean(search(), text_col), docs.schema)
        if i + 1 < len(searches):
            docs = stage(docs)
    return docs


def _clean(search, text_col: str):
    def run(batches):
        apply = search()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
            none = [None] * len(texts)
            hits = apply({"doc_id": none, "text": texts, "hit": none, "items": none})["hit"]
            yield batch.filter(pa.array([h is None for h in hits], pa.bool_()))

    return run


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_patterns: int = BLOCK_PATTERNS,
) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence), items (sorted as strings), contaminated."""
    searches = _searches(benchmark, window, item_col, item_text_col, block_patterns)
    fields = [("doc_id", pa.int64()), ("text", pa.binary()), ("hit", pa.binary()),
              ("items", pa.list_(pa.string()))]
    ddl = "doc_id long, text binary, hit binary, items array<string>"
    names = [n for n, _ in fields]
    state = with_bytes(docs, id_col, text_col).withColumns(
        {"hit": F.lit(None).cast("binary"), "items": F.lit(None).cast("array<string>")}
    )
    final = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
                       ("items", pa.list_(pa.string())), ("contaminated", pa.bool_())])
    final_ddl = "doc_id long, n_words long, n_hit long, items array<string>, contaminated boolean"
    *early, search = searches
    for earlier in early:
        state = stage(state.mapInArrow(map_rows(earlier(), names, pa.schema(fields)), ddl))
    final_search = search()

    def last():
        apply = final_search()
        return lambda rows: _result(apply(rows))

    return state.mapInArrow(map_rows(last, names, final), final_ddl)


def items_digest(items) -> F.Column:
    """sha256 of sorted item ids, comma-joined."""
    return F.sha2(F.array_join(items, ","), 256)


