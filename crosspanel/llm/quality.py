"""Quality rules as a short-circuit cascade.

Every rule is cheap or dear and rejects often or seldom.  ``estimate`` times each rule alone
on a sample and counts what it rejects; the cascade then runs the rules by rejections per
second, and a document meets no rule after the first that rejects it.  The order changes the
time, never the verdict: a document is kept if no rule rejects it.

Null and empty texts have no words and fail the base rule.  Repeated rows are judged each on
its own; extra columns of the input are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.text import map_rows, raw_words, with_bytes

WINDOW = 5
# Characters counted as symbols, and bytes that are not the start of a
# character of a word (the six white-space characters, UTF-8 continuation bytes).
SYMBOLS = b"#*$%&|<>"
NO_WORD_CHAR = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))


class Features:
    """Statistics of one text, each computed when first asked for."""

    def __init__(self, text: bytes | None):
        self.text = text or b""

    @cached_property
    def words(self) -> list[bytes]:
        return raw_words(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(None, NO_WORD_CHAR))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_lettered(self) -> int:
        return sum(map(_has_letter, self.words))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words - WINDOW + 1
        if n < 2:
            return 0
        ids = np.fromiter(map(hash, self.words), np.int64, self.n_words).view(np.uint64)
        key = ids[:n].copy()
        for j in range(1, WINDOW):
            key *= np.uint64(0x9E3779B97F4A7C15)
            key += ids[j : j + n]
        ordered = np.sort(key)
        twice = ordered[1:] == ordered[:-1]
        if not twice.any():
            return 0
        # Only windows that share a hash can be equal; their words decide.
        at = np.flatnonzero(np.isin(key, ordered[1:][twice]))
        windows = [tuple(self.words[i : i + WINDOW]) for i in at]
        counts = Counter(windows)
        covered = np.zeros(self.n_words + 1, np.int64)
        starts = at[[counts[w] > 1 for w in windows]]
        covered[starts] += 1
        np.subtract.at(covered, starts + WINDOW, 1)
        return int(np.count_nonzero(np.cumsum(covered)))


_LETTERS = bytes(c for c in range(256) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128)


def _has_letter(word: bytes) -> bool:
    return len(word.translate(None, _LETTERS)) < len(word)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]


def _few_words(f: Features) -> bool:
    return f.n_words < 10


def _repeats(f: Features) -> bool:
    return 100 * f.n_repeat_words > 20 * f.n_words


def _word_length(f: Features) -> bool:
    return not 2 * f.n_words <= f.word_chars <= 40 * f.n_words


def _symbols(f: Features) -> bool:
    return 10 * f.n_symbols > f.n_words


def _dup_lines(f: Features) -> bool:
    return 10 * f.n_dup_lines > 3 * len(f.lines)


def _letters(f: Features) -> bool:
    return 10 * f.n_lettered < 6 * f.n_words


BASE = (Rule("few_words", _few_words), Rule("repeated_windows", _repeats))
RULES = BASE + (
    Rule("word_length", _word_length),
    Rule("symbols", _symbols),
    Rule("duplicate_lines", _dup_lines),
    Rule("letters", _letters),
)


def base_failed(f: Features) -> bool:
    return any(rule.rejects(f) for rule in BASE)


def _time_rules(rules: tuple[Rule, ...]):
    def apply(rows: dict) -> dict:
        out = {"rule": [], "n": [], "rejected": [], "nanos": []}
        for i, rule in enumerate(rules):
            start = time.process_time_ns()
            rejected = sum(rule.rejects(Features(t)) for t in rows["text"])
            for k, v in (("rule", i), ("n", len(rows["text"])), ("rejected", rejected),
                         ("nanos", time.process_time_ns() - start)):
                out[k].append(v)
        return out

    return apply


def estimate(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, seed: int = 7
) -> list[Rule]:
    """The rules by rejections per second of a sample of about ``sample_rows`` texts.

    The sample only sets the order.  One row per rule reaches the driver.
    """
    fraction = min(1.0, sample_rows / max(1, docs.count()))
    schema = pa.schema([(c, pa.int64()) for c in ("rule", "n", "rejected", "nanos")])
    timed = (
        docs.select("text").sample(fraction, seed)
        .mapInArrow(map_rows(partial(_time_rules, rules), ["text"], schema),
                    "rule long, n long, rejected long, nanos long")
        .groupBy("rule")
        .agg(F.sum("rejected").alias("rejected"), F.sum("nanos").alias("nanos"))
        .collect()
    )
    gain = {r.rule: r.rejected / max(1, r.nanos) for r in timed}
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -gain.get(i, 0.0))]


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judge(order: list[Rule], stats: tuple[str, ...]):
    def apply(rows: dict) -> dict:
        out: dict = {c: [] for c in ("failed_rule", "rules_run", "kept", *stats)}
        if stats:
            out["base_failed"] = []
        for text in rows["text"]:
            f, failed, run = Features(text), None, 0
            for rule in order:
                run += 1
                if rule.rejects(f):
                    failed = rule.name
                    break
            out["failed_rule"].append(failed)
            out["rules_run"].append(run)
            out["kept"].append(failed is None)
            for s in stats:
                out[s].append(getattr(f, s))
            if stats:
                out["base_failed"].append(base_failed(f))
        return out | {"doc_id": rows["doc_id"]}

    return apply


def cascade(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = 2000,
    with_stats: bool = False,
) -> DataFrame:
    """doc_id, failed_rule (the first in the cascade's order; null if kept), rules_run, kept.

    ``with_stats`` adds the statistics of every text and the verdict of the base rules; they
    are computed after the cascade for whatever it has not needed.  A narrow pass: no shuffle.
    """
    docs = with_bytes(docs, id_col, text_col)
    order = estimate(docs, rules, sample_rows)
    stats = STATS if with_stats else ()
    fields = [("doc_id", pa.int64()), ("failed_rule", pa.string()), ("rules_run", pa.int64()),
              ("kept", pa.bool_())] + [(s, pa.int64()) for s in stats]
    ddl = "doc_id long, failed_rule string, rules_run long, kept boolean"
    ddl += "".join(f", {s} long" for s in stats)
    if stats:
        fields.append(("base_failed", pa.bool_()))
        ddl += ", base_failed boolean"
    return docs.mapInArrow(
        map_rows(partial(_judge, order, stats), ["doc_id", "text"], pa.schema(fields)), ddl
    )
