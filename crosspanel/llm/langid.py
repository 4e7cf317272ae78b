"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in chunks of ``CHUNK`` bytes.  One recurrent layer runs over a chunk forwards and
one backwards, from a zero state; both states together label every byte with a distribution over
the learned languages.  A document's probabilities are the mean of those of all its bytes, and
its language is the most probable one (ties: the first by name).

The weights are fitted in numpy by backpropagation through time with Adam, in one task, on a
documented bound of labelled texts: ``max_per_lang`` per language, chosen by a hash of id and
text, and of each text at most ``WINDOWS`` chunks, spread over it.  They are broadcast; a model
takes under 30 kB for ten languages.  Prediction is a narrow pass over whole texts, in slabs of
``SLAB`` chunks, so a very long text needs no more memory than many short ones.

Rows without a language are not learned from.  Texts that are null or have no letter are ``und``
with score 0, and so are all without any learned language.  Repeated rows are predicted each on
its own; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crosspanel.llm.text import with_bytes

HIDDEN = 8
CHUNK = 64
SLAB = 1024
MAX_PER_LANG = 500
WINDOWS = 4
EPOCHS = 8
BATCH = 64
RATE = 0.02
UNKNOWN = "und"
ASCII_LETTER = re.compile(rb"[A-Za-z]").search


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return bool(ASCII_LETTER(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights of both directions (first axis) and of the labelling layer.

    ``entry`` [2, 256, 3H] is what a byte adds to the gates, ``turn`` [2, H, 3H] what the state
    adds; gates are reset, update, candidate.  ``out`` [2H, L] and ``bias`` [L] label a position.
    """

    NAMES = ("entry", "turn", "out", "bias")

    def __init__(self, langs: list[str], entry, turn, out, bias):
        self.langs, self.entry, self.turn, self.out, self.bias = langs, entry, turn, out, bias

    @classmethod
    def fresh(cls, langs: list[str], hidden: int, rng: np.random.Generator) -> Network:
        def some(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)

        return cls(langs, some(2, 256, 3 * hidden, scale=0.3), some(2, hidden, 3 * hidden, scale=hidden**-0.5),
                   some(2 * hidden, len(langs), scale=hidden**-0.5), np.zeros(len(langs), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def states(self, chunks: np.ndarray, mask: np.ndarray | None = None):
        """States of both directions at each position and the gates that led to them.

        ``chunks`` [2, B, T] has the bytes in each direction's order.  Where ``mask`` [2, B, T]
        is 0 the state is held at zero, so a filled-up chunk starts at its first real byte.
        """
        _, rows, steps = chunks.shape
        hidden = self.turn.shape[1]
        h = np.zeros((2, rows, hidden), self.entry.dtype)
        states, gates = [h], []
        for t in range(steps):
            seen = np.stack([self.entry[d][chunks[d, :, t]] for d in (0, 1)])
            moved = h @ self.turn
            rz = sigmoid(seen[..., : 2 * hidden] + moved[..., : 2 * hidden])
            r, z = rz[..., :hidden], rz[..., hidden:]
            held = moved[..., 2 * hidden :]
            n = np.tanh(seen[..., 2 * hidden :] + r * held)
            h = n + z * (h - n)
            if mask is not None:
                h = h * mask[:, :, t, None]
            states.append(h)
            gates.append((r, z, n, held))
        return states, gates

    def loss_and_gradient(self, chunks: np.ndarray, labels: np.ndarray):
        """Mean cross-entropy over all positions of full chunks, and its gradient by weight."""
        both = np.stack([chunks, chunks[:, ::-1]])
        states, gates = self.states(both)
        rows, steps = chunks.shape
        hidden = self.turn.shape[1]
        forward = np.stack([s[0] for s in states[1:]], 1)
        backward = np.stack([s[1] for s in states[:0:-1]], 1)
        joined = np.concatenate([forward, backward], -1)
        logits = joined @ self.out + self.bias
        logits -= logits.max(-1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(-1, keepdims=True)
        loss = -np.log(np.maximum(p[np.arange(rows), :, labels], 1e-12)).mean()
        p[np.arange(rows), :, labels] -= 1
        p /= rows * steps
        d_out = np.einsum("btk,btl->kl", joined, p)
        d_joined = p @ self.out.T
        d_state = np.stack([d_joined[..., :hidden], d_joined[:, ::-1, hidden:]])
        d_turn = np.zeros_like(self.turn)
        d_seen = np.empty((steps, *self.entry.shape[:1], rows, 3 * hidden), self.entry.dtype)
        carried = np.zeros_like(states[0])
        for t in range(steps - 1, -1, -1):
            r, z, n, held = gates[t]
            before = states[t]
            d = carried + d_state[:, :, t]
            d_n = d * (1 - z) * (1 - n * n)
            d_z = d * (before - n) * z * (1 - z)
            d_r = d_n * held * r * (1 - r)
            d_seen[t] = np.concatenate([d_r, d_z, d_n], -1)
            d_moved = np.concatenate([d_r, d_z, d_n * r], -1)
            d_turn += before.transpose(0, 2, 1) @ d_moved
            carried = d * z + d_moved @ self.turn.transpose(0, 2, 1)
        d_entry = np.zeros_like(self.entry)
        for way in (0, 1):
            seen = both[way].T.ravel()
            order = np.argsort(seen, kind="stable")
            values, starts = np.unique(seen[order], return_index=True)
            d_entry[way, values] = np.add.reduceat(d_seen[:, way].reshape(-1, 3 * hidden)[order], starts)
        return loss, [d_entry, d_turn, d_out, p.sum((0, 1))]

    def label_sums(self, chunks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sum of the label probabilities over the bytes of each chunk [B, L].

        ``sizes`` are the chunks' lengths; what follows is filling.  Rows are the last axis here, so that each gate is one contiguous block.
        """
        rows, steps = chunks.shape
        hidden, n_langs = self.turn.shape[1], len(self.langs)
        whole = bool((sizes == steps).all())
        # Gates as 1 / (1 + exp(-a)) and 1 - 2 / (1 + exp(2 a)): the factors go into the weights.
        factor = np.repeat(np.array([-1, -1, 2], np.float32), hidden)[:, None]
        turn = np.ascontiguousarray(self.turn.transpose(0, 2, 1) * factor)
        entry = np.ascontiguousarray(self.entry.transpose(0, 2, 1) * factor)
        states = np.empty((2, steps, hidden, rows), np.float32)
        by_step = np.ascontiguousarray(chunks.T)
        gates, moved = np.empty((3 * hidden, rows), np.float32), np.empty((3 * hidden, rows), np.float32)
        for way in (0, 1):
            h = np.zeros((hidden, rows), np.float32)
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                np.take(entry[way], by_step[t], axis=1, out=gates, mode="clip")
                np.matmul(turn[way], h, out=moved)
                rz = gates[: 2 * hidden]
                rz += moved[: 2 * hidden]
                np.exp(rz, out=rz)
                rz += 1
                np.reciprocal(rz, out=rz)
                n, held = gates[2 * hidden :], moved[2 * hidden :]
                held *= gates[:hidden]
                n += held
                np.exp(n, out=n)
                n += 1
                np.divide(-2, n, out=n)
                n += 1
                out = states[way, t]
                np.subtract(h, n, out=out)
                out *= gates[hidden : 2 * hidden]
                out += n
                if not whole:
                    out *= (t < sizes).astype(np.float32)
                h = out
        logits = np.matmul(self.out[:hidden].T, states[0])
        logits += np.matmul(self.out[hidden:].T, states[1])
        logits += self.bias[:, None]
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        if not whole:
            logits *= (np.arange(steps)[:, None] < sizes)[:, None, :]
        return logits.sum(0, dtype=np.float64).T.reshape(rows, n_langs)


def fit(langs: list[str], chunks: np.ndarray, labels: np.ndarray, hidden: int = HIDDEN, seed: int = 7) -> Network:
    """Adam on full chunks with a falling rate; ``labels`` are places in ``langs``."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(langs, hidden, rng)
    first = [np.zeros_like(w) for w in net.weights()]
    second = [np.zeros_like(w) for w in net.weights()]
    steps = EPOCHS * -(-len(chunks) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(chunks))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            _, gradient = net.loss_and_gradient(chunks[some], labels[some])
            norm = np.sqrt(sum(float(np.square(g).sum()) for g in gradient))
            step += 1
            rate = RATE * (1 - (step - 1) / steps)
            for w, g, m, v in zip(net.weights(), gradient, first, second):
                g = g / max(1.0, norm)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def windows_of(text: bytes, most: int = WINDOWS) -> list[bytes]:
    """At most ``most`` chunks spread over the text; a shorter text is repeated to fill one."""
    if len(text) < CHUNK:
        return [(text * CHUNK)[:CHUNK]] if text else []
    n = min(most, len(text) // CHUNK)
    return [text[at : at + CHUNK] for at in np.linspace(0, len(text) - CHUNK, n).astype(int).tolist()]


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    samples = []
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if has_letter(text):
                samples += [(lang, w) for w in windows_of(text)]
    samples.sort()  # the model does not depend on the order in which rows arrive
    if samples:
        langs = sorted({lang for lang, _ in samples})
        place = {lang: i for i, lang in enumerate(langs)}
        chunks = np.frombuffer(b"".join(w for _, w in samples), np.uint8).reshape(len(samples), CHUNK)
        net = fit(langs, chunks, np.array([place[lang] for lang, _ in samples]))
        shapes = [w.tobytes() for w in net.weights()]
        yield pa.RecordBatch.from_pydict({
            "langs": pa.array([langs], pa.list_(pa.string())), "weights": pa.array([shapes], pa.list_(pa.binary()))})


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3, is 1: such rows are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(
    docs: DataFrame,
    max_per_lang: int = MAX_PER_LANG,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Network | None:
    """Fit on ``max_per_lang`` texts of each language; None without any."""
    usable = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
    ).filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull()
        & ~F.coalesce(is_held_out(F.col("doc_id")), F.lit(False))
    ).withColumn("h", F.xxhash64("doc_id", "text"))
    # Ids first: texts are read for the chosen rows only, and none passes a sort.
    order = W.partitionBy("lang").orderBy("h")
    limits = (
        usable.select("lang", "h").withColumn("nth", F.row_number().over(order))
        .filter(F.col("nth") <= max_per_lang).groupBy("lang").agg(F.max("h").alias("limit"))
    )
    sample = usable.join(F.broadcast(limits), "lang").filter("h <= limit").select("lang", "text").distinct()
    found = sample.repartition(1).mapInArrow(_fit_task, "langs array<string>, weights array<binary>").collect()
    if not found:
        return None
    langs = list(found[0].langs)
    sizes = ((2, 256, 3 * HIDDEN), (2, HIDDEN, 3 * HIDDEN), (2 * HIDDEN, len(langs)), (len(langs),))
    return Network(langs, *[
        np.frombuffer(bytes(w), np.float32).reshape(s) for w, s in zip(found[0].weights, sizes)])


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean label probabilities of each text, all of which have a byte [N, L]."""
    sums = np.zeros((len(texts), len(net.langs)))

    def add(chunks: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> None:
        for at in range(0, len(chunks), SLAB):
            some = slice(at, at + SLAB)
            np.add.at(sums, owner[some], net.label_sums(chunks[some], sizes[some]))

    rest, owner_of_rest, full, owner_of_full = [], [], [], []
    for i, text in enumerate(texts):
        n = len(text) // CHUNK
        if n:
            full.append(np.frombuffer(text, np.uint8, n * CHUNK).reshape(n, CHUNK))
            owner_of_full.append(np.full(n, i))
        if len(text) > n * CHUNK:
            rest.append(text[n * CHUNK :])
            owner_of_rest.append(i)
    if full:
        chunks = np.concatenate(full)
        add(chunks, np.full(len(chunks), CHUNK), np.concatenate(owner_of_full))
    # Shorter ends by length, so that a slab is no longer than its longest.
    order = sorted(range(len(rest)), key=lambda j: len(rest[j]))
    for at in range(0, len(order), SLAB):
        some = order[at : at + SLAB]
        longest = len(rest[some[-1]])
        chunks = np.frombuffer(b"".join(rest[j].ljust(longest, b"\0") for j in some), np.uint8)
        add(chunks.reshape(len(some), longest), np.array([len(rest[j]) for j in some]),
            np.array([owner_of_rest[j] for j in some]))
    return sums / np.array([len(t) for t in texts])[:, None]


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        np.seterr(over="ignore")  # exp(a) of a saturated gate: 1 / inf is the 0 wanted
        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if network is not None and has_letter(t)]
            if known:
                means = pooled(network, [texts[i] for i in known])
                for i, best, p in zip(known, means.argmax(1).tolist(), means.max(1).tolist()):
                    langs[i], scores[i] = network.langs[best], min(1.0, max(0.0, p))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())
            ], names=["doc_id", "lang_pred", "score"])

    return with_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")
