"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), over the distinct words of
a text, hashed.  The pair terms learn interactions that additive weights miss.  x_i is a term's
evidence on the labelled sample (root of its likelihood ratio, scaled to 0.1..1), so common
words do not drown a rare telling one in a long text; terms seen in fewer than ``MIN_DOCS``
sampled texts are left out.

The model is fitted in one task on a documented bound of labelled texts (``max_train``, chosen
by a hash of the id, one text per id) and broadcast: ``2**BITS * (FACTORS + 2)`` floats at most.
Scoring is a narrow pass over whole texts.

Null and empty texts have no terms and score sigmoid(b).  Labels that are null are not used;
of several labels of an id the toxic one counts.  Without any usable label the score is 0.
Repeated rows are scored each on its own; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.text import folded_words, map_rows, with_bytes

BITS = 18
FACTORS = 8
MIN_DOCS = 3
MAX_TRAIN = 40_000
EPOCHS = 8
BATCH = 256


class Terms(dict):
    """Hashed term of each word; forgets all when it holds too many."""

    MOST = 1 << 20

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.MOST:
            self.clear()
        t = self[word] = xxhash.xxh32_intdigest(word) & ((1 << BITS) - 1)
        return t

    def of(self, text: bytes | None) -> np.ndarray:
        words = set(folded_words(text))
        return np.unique(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))


class Machine:
    """Weights by hashed term; ``x`` is 0 for terms left out."""

    def __init__(self, bias: float, x: np.ndarray, w: np.ndarray, v: np.ndarray):
        self.bias, self.x, self.w, self.v = bias, x, w, v

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        margin = np.full(len(docs), self.bias)
        for i, terms in enumerate(docs):
            terms = terms[self.x[terms] > 0]
            if len(terms):
                x = self.x[terms]
                vx = self.v[terms] * x[:, None]
                total = vx.sum(0, dtype=np.float64)
                pairs = (total @ total - np.square(vx).sum(dtype=np.float64)) / 2
                margin[i] += float(self.w[terms] @ x) + pairs
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))

    def to_bytes(self) -> bytes:
        head = np.array([self.bias], np.float64).tobytes()
        return head + self.x.tobytes() + self.w.tobytes() + self.v.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> Machine:
        n = 1 << BITS
        a = np.frombuffer(blob, np.float32, offset=8)
        return cls(float(np.frombuffer(blob, np.float64, 1)[0]), a[:n], a[n : 2 * n],
                   a[2 * n :].reshape(n, FACTORS))


def evidence(n_pos: np.ndarray, n_neg: np.ndarray, pos: int, neg: int) -> np.ndarray:
    """Input value of each term: root of its likelihood ratio against the base rate."""
    n = n_pos + n_neg
    base = pos / (pos + neg)

    def part(k, e):
        return np.where(k > 0, k * np.log(np.maximum(k, 1) / np.maximum(e, 1e-9)), 0.0)

    g2 = 2 * (part(n_pos, n * base) + part(n_neg, n * (1 - base)))
    x = 0.1 + 0.9 * np.clip(np.sqrt(np.maximum(g2, 0)) / 6, 0, 1) ** 2
    return np.where(n >= MIN_DOCS, x, 0).astype(np.float32)


def fit(docs: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> Machine:
    """AdaGrad on the logistic loss with a decay on weights and factors."""
    n = 1 << BITS
    pos, neg = int(labels.sum()), int(len(labels) - labels.sum())
    if not pos or not neg:
        zero = np.zeros(n, np.float32)
        return Machine(-30.0 if not pos else 30.0, zero, zero, np.zeros((n, FACTORS), np.float32))
    counts = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
    for terms, y in zip(docs, labels):
        counts[int(y)][terms] += 1
    x = evidence(counts[1], counts[0], pos, neg)
    rng = np.random.default_rng(seed)
    w = np.zeros(n, np.float32)
    v = rng.normal(0, 0.02, (n, FACTORS)).astype(np.float32)
    gw, gv = np.full(n, 1e-2, np.float32), np.full((n, FACTORS), 1e-2, np.float32)
    bias = float(np.log(pos / neg))
    docs = [t[x[t] > 0] for t in docs]
    for epoch in range(EPOCHS):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            sizes = np.array([len(docs[i]) for i in chosen])
            terms = np.concatenate([docs[i] for i in chosen])
            if not len(terms):
                continue
            row = np.repeat(np.arange(len(chosen)), sizes)
            xs = x[terms]
            vx = v[terms] * xs[:, None]
            total = np.stack([np.bincount(row, vx[:, f], len(chosen)) for f in range(FACTORS)], 1)
            square = np.bincount(row, np.square(vx).sum(1), len(chosen))
            margin = bias + np.bincount(row, w[terms] * xs, len(chosen))
            margin += (np.square(total).sum(1) - square) / 2
            err = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[chosen]
            bias -= 0.05 * float(err.mean())
            e = (err[row] * xs).astype(np.float32)
            uniq, inv = np.unique(terms, return_inverse=True)
            dw = np.bincount(inv, e, len(uniq)) + 0.02 * w[uniq]
            dv = e[:, None] * (total[row] - vx)
            dv = np.stack([np.bincount(inv, dv[:, f], len(uniq)) for f in range(FACTORS)], 1)
            dv += 0.02 * v[uniq]
            gw[uniq] += np.square(dw)
            gv[uniq] += np.square(dv)
            w[uniq] -= (0.3 * dw / np.sqrt(gw[uniq])).astype(np.float32)
            v[uniq] -= (0.05 * dv / np.sqrt(gv[uniq])).astype(np.float32)
    return Machine(bias, x, w, v)


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms, docs, labels = Terms(), [], []
    for batch in batches:
        rows = batch.to_pydict()
        # Sorted by id: the model does not depend on the order in which rows arrive.
        docs += [(i, terms.of(t)) for i, t in zip(rows["doc_id"], rows["text"])]
        labels += list(zip(rows["doc_id"], rows["toxic"]))
    docs.sort(key=lambda d: d[0])
    labels.sort()
    if docs:
        blob = fit([d for _, d in docs], np.array([y for _, y in labels], np.float64)).to_bytes()
        yield pa.RecordBatch.from_pydict({"model": pa.array([blob], pa.binary())})


def is_held_out(doc_id) -> F.Column:
    """crc32 of the id as text, mod 5, is 0: such labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_train: int = MAX_TRAIN,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> bytes | None:
    """Fit on about ``max_train`` labelled texts; None without any."""
    usable = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("toxic"))
        .dropna()
        .filter(~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    share = min(1.0, max_train / max(1, usable.count()))
    slots = 1 << 20
    sample = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(slots)) < int(share * slots))
    # The sample is bounded by max_train, which is what makes this broadcast safe.
    texts = (
        with_bytes(docs, id_col, text_col)
        .join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min(F.coalesce("text", F.lit(b""))).alias("text"))
    )
    found = texts.repartition(1).mapInArrow(_fit_task, "model binary").collect()
    return bytes(found[0].model) if found else None


def _score(shared):
    def make():
        machine = Machine.from_bytes(shared.value) if shared.value else None
        terms = Terms()

        def apply(rows: dict) -> dict:
            if machine is None:
                scores = [0.0] * len(rows["text"])
            else:
                scores = machine.score([terms.of(t) for t in rows["text"]]).tolist()
            return {**rows, "score": scores}

        return apply

    return make


def score(docs: DataFrame, model: bytes | None, text_col: str = "text") -> DataFrame:
    """``docs`` reduced to doc_id and text (bytes), with the score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    return with_bytes(docs, "doc_id", text_col).mapInArrow(
        map_rows(_score(shared), ["doc_id", "text"], schema), "doc_id long, score double"
    )


def accepted_rows(
    docs: DataFrame, model: bytes | None, limit: float = 0.5, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that score under ``limit``, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        apply = _score(shared)()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
            scores = apply({"text": texts.to_pylist()})["score"]
            yield batch.filter(pa.array([s < limit for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
