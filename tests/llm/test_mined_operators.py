"""Hard negatives, collocations and language identification."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosspanel.llm import langid, negatives, phrases


def bag(rows):
    return Counter(tuple(r) for r in rows)


VECTORS = "vec_id long, embedding array<float>, label int"


def _served(rows, every=10):
    """The definition, pair by pair."""
    valid = [
        (i, [int(np.floor(256 * float(np.float32(x)))) for x in v], y) for i, v, y in rows
        if i is not None and y is not None and v is not None
        and all(x is not None and np.isfinite(x) for x in v)
    ]
    width = max([len(v) for i, v, _ in valid if i % every == 0], default=0)
    out = []
    for i, v, y in valid:
        if i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v[:width], w)), j, z) for j, w, z in valid if j != i]
        same = sorted((-s, j) for s, j, z in scored if z == y)[:5]
        other = sorted((-s, j) for s, j, z in scored if z != y)
        for s, j in same:
            fits = [(n, k) for n, k in other if 80 * -s <= 100 * -n <= 100 * -s][:5]
            out += [(i, j, r, k, -s, -n) for r, (n, k) in enumerate(fits, 1)]
    return Counter(out)


def _vectors(seed, n):
    rng = random.Random(seed)
    centres = [[rng.uniform(-0.5, 1) for _ in range(4)] for _ in range(3)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in centres[rng.randrange(3)]], rng.randrange(4)) for i in range(n)]
    rows += [(1000 + i, [0.5, 0.5, 0.25, 0.0], i % 2) for i in range(60)]  # one vector, many ties
    rows += [rows[20], rows[20], rows[33]]  # a repeated anchor and a repeated row
    rows += [(20, [0.1, 0.2, 0.3, 0.4], 1), (None, [1.0] * 4, 1), (5000, None, 1), (5010, [1.0] * 4, None)]
    rows += [(5020, [1.0, None, 0.0, 0.0], 1), (5030, [float("nan")] * 4, 1), (5040, [float("inf"), 0.0, 0.0, 0.0], 1)]
    rows += [(5050, [], 2), (5060, [0.5, 0.5], 0), (-50, [0.3, 0.9, 0.2, -0.4], 3)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_equal_the_definition(spark, monkeypatch, seed):
    rows = _vectors(seed, 150)
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("clash")).withColumn("anchor_id", F.lit(1))
    want = _served(rows)
    assert len(want) > 100
    got = negatives.hard_negatives(df.repartition(5), every=10)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert bag(got.collect()) == want
    assert bag(negatives.hard_negatives(df.coalesce(1), every=10, block_bytes=200).collect()) == want  # many blocks


def test_negatives_in_small_pieces(spark, monkeypatch):
    # Workers are forked from a fresh import: the pieces are tried on the task function itself.
    rows = [r for r in _vectors(3, 80) if r[0] is not None and r[1] and len(r[1]) == 4 and r[2] is not None
            and all(x is not None and np.isfinite(x) for x in r[1])]
    table = negatives.usable(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding", F.col("label"))
    batch = table.toArrow().combine_chunks().to_batches()[0]

    class Shared:
        value = negatives.Block(np.array([20, 50]), np.array([1, 2]), np.ones((2, 4)) * 50)

    whole = [k.as_py() for b in negatives.best_of_task(Shared, 1, 5, 0)(iter([batch])) for k in b.column(0)]
    monkeypatch.setattr(negatives, "ROWS_AT_ONCE", 7)
    monkeypatch.setattr(negatives, "ANCHORS_AT_ONCE", 1)
    parts = [batch.slice(0, 3), batch.slice(3, 0), batch.slice(3)]
    cut = [k.as_py() for b in negatives.best_of_task(Shared, 1, 5, 0)(iter(parts)) for k in b.column(0)]
    assert sorted(whole) == sorted(cut) and len(whole) == 10


def test_keys_sort_as_wanted():
    rng = random.Random(1)
    items = [(rng.randrange(3), rng.choice([-9, -1, 0, 1, 7, 2**59]), rng.randrange(2), rng.choice([-5, 0, 3, 2**40]))
             for _ in range(200)]
    keys = [negatives.pack(np.array([a]), np.array([s]), k, np.array([i]))[0] for a, s, k, i in items]
    assert [negatives.unpack(k) for k in sorted(keys)] == sorted(items, key=lambda x: (x[0], -x[1], x[2], x[3]))


def test_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(empty).count() == 0
    alone = spark.createDataFrame([(100, [1.0], 1), (7, [1.0], 2)], VECTORS)
    assert negatives.hard_negatives(alone).count() == 0  # an anchor without positives
    huge = spark.createDataFrame([(100, [1e30], 1), (7, [1e30], 1)], VECTORS)
    with pytest.raises(Exception, match="60 bits"):
        negatives.hard_negatives(huge).collect()


def test_wide_products_are_exact():
    a = np.array([[2.0**27, 3.0]])
    assert negatives.products(a, a).tolist() == [[2**54 + 9]]


def _collocations(rows, threshold, top):
    f, words = {}, Counter()
    for lang, text in rows:
        lang, counts = lang or "und", f.setdefault(lang or "und", Counter())
        line = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for sep in ",;:!?\n\x0b\x0c\r":
            line = line.replace(sep, ".")
        for piece in line.split("."):
            ws = [w for w in piece.replace("\t", " ").split(" ") if w]
            words[lang] += len(ws)
            counts.update(tuple(ws[i:i + k]) for k in range(1, 5) for i in range(len(ws) - k + 1))
    out = set()
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= threshold}
        gone = set()
        for p, a in cands.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * a >= 80 * cands[p[i:i + k]]:
                        gone.add(p[i:i + k])
        best = []
        for p, a in cands.items():
            if p not in gone:
                s, j = min((2000000 * a // (counts[p[:j]] + counts[p[j:]]), j) for j in range(1, len(p)))
                best.append((-s, -a, " ".join(p).encode(), counts[p[:j]], counts[p[j:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, words[lang], -s))
    return out


def _talk(seed, n):
    rng = random.Random(seed)
    base = ["red", "Red", "fox", "É", "ant", "bee", "x y", "ran", "of", "the"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 40)):
            words += rng.choice([["new", "york", "city", "hall"], ["new", "york"], ["hot", "dog"], [rng.choice(base)]])
        text = "".join(w + rng.choice([" ", " ", " ", "\t", " \t ", ". ", ",", "\n", "\r\x0b", "?!"]) for w in words)
        rows.append((i, text, rng.choice(["en", "en", "fr", None, "und"])))
    return rows + [(None, None, None), (1, None, "en"), (2, "", "fr"), (3, "...", "en"), (4, rows[0][1], "en"),
                   (4, rows[0][1], "en"), (5, "new york city hall " * 3000, "de"), (6, "lone", "xx")]


@pytest.mark.parametrize("shards,bits", [(3, 1 << 20), (4, 64), (1, 128), (2, 1 << 12)])
def test_collocations_equal_a_plain_count(spark, shards, bits):
    rows = _talk(shards, 300)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clash = df.withColumns({c: F.lit("clash") for c in ("phrase", "k", "n", "shard", "reached", "words", "rank")})
    got = phrases.collocations(clash.repartition(5), threshold=12, top=30, shards=shards, filter_bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == _collocations([(y, t) for _, t, y in rows], 12, 30)


def test_late_phrases_complete_their_cycle(spark):
    """A phrase whose parts reach the threshold only in the last shard is still counted in the first."""
    rows = [(i, "a b c d", "en") for i in range(12)] + [(20 + i, f"w{i}", "en") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.phrase.decode(): r.f for r in phrases.frequent_phrases(df, threshold=12, shards=4).collect() if r.k}
    assert got == {" ".join("abcd"[i:j]): 12 for i in range(4) for j in range(i + 1, 5)}


def test_a_run_of_words_is_counted_in_full():
    tokens = phrases.tokens_of(b"a b a b. a b\tA, b a\nb a b")
    words = [b".", b"a", b"b"]
    ids = np.array([words.index(t) for t in tokens])
    every = np.full(1, -1, np.int64).view(np.uint64)
    want = Counter()
    for piece in (["a", "b", "a", "b"], ["a", "b", "a"], ["b", "a"], ["b", "a", "b"]):
        want[(0, b"")] += len(piece)
        want.update((k, " ".join(piece[i:i + k]).encode()) for k in range(1, 5) for i in range(len(piece) - k + 1))
    for now, then, least in ((every, None, 2), (None, None, 9), (every, every, 9)):
        got = {(k, p): n for k, ps, ns in phrases.count_run("en", ids, words, now, then, True, 4, phrases.WordHashes())
               for p, n in zip(ps, ns.tolist())}
        assert got == {p: n for p, n in want.items() if p[0] < 2 or p[0] >= least}


def test_codes_of_long_phrases_are_exact():
    ids = np.random.default_rng(1).integers(0, 3, 500)
    at = np.arange(490)
    for n_words in (3, 1 << 20, 1 << 40):  # from 2**62 on the codes are numbered anew
        code = phrases.exact_codes(ids, at, 4, n_words)
        assert len({(c, tuple(ids[p:p + 4])) for c, p in zip(code.tolist(), at)}) == len(set(code.tolist())) == 81


def test_collocations_of_nothing(spark, empty, awkward):
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(awkward.filter("text is null or text = ''")).count() == 0
    assert phrases.collocations(awkward).filter("a < 30").count() == 0


def _slow_probabilities(net, text):
    """Byte by byte, one chunk after the other."""
    hidden = net.turn.shape[1]
    total = np.zeros(len(net.langs))
    for at in range(0, len(text), langid.CHUNK):
        chunk = text[at : at + langid.CHUNK]
        states = np.zeros((2, len(chunk), hidden))
        for way in (0, 1):
            h = np.zeros(hidden)
            for p in range(len(chunk)) if way == 0 else range(len(chunk) - 1, -1, -1):
                seen, moved = net.entry[way][chunk[p]].astype(float), h @ net.turn[way].astype(float)
                r, z = 1 / (1 + np.exp(-(seen + moved)[: 2 * hidden].reshape(2, hidden)))
                n = np.tanh(seen[2 * hidden :] + r * moved[2 * hidden :])
                h = n + z * (h - n)
                states[way, p] = h
        for p in range(len(chunk)):
            e = np.exp(np.concatenate(states[:, p]) @ net.out + net.bias)
            total += e / e.sum()
    return total / len(text)


def test_network_equals_its_definition_and_its_gradient():
    rng = np.random.default_rng(1)
    net = langid.Network.fresh(["a", "b", "c"], 3, rng)
    net.bias += np.array([0.1, -0.2, 0.3], np.float32)
    texts = [bytes(rng.integers(0, 256, n, np.uint8)) for n in (1, 5, 63, 64, 65, 200, 128)]
    got = langid.pooled(net, texts)
    for row, text in zip(got, texts):
        assert np.allclose(row, _slow_probabilities(net, text), atol=1e-5)
    net = langid.Network(net.langs, *[w.astype(float) for w in net.weights()])
    chunks, labels = rng.integers(0, 6, (4, 7)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, gradient = net.loss_and_gradient(chunks, labels)
    for w, g in zip(net.weights(), gradient):
        places = np.argwhere(np.abs(g) > 0)
        for place in map(tuple, places[rng.permutation(len(places))[:12]]):
            kept = w[place]
            w[place] = kept + 1e-5
            up = net.loss_and_gradient(chunks, labels)[0]
            w[place] = kept - 1e-5
            down = net.loss_and_gradient(chunks, labels)[0]
            w[place] = kept
            assert abs((up - down) / 2e-5 - g[place]) < 1e-6


def test_language_is_learned_and_edges_are_taken(spark, clashing, awkward, empty):
    rng = random.Random(5)
    parts = {"en": ["the", "and", "sh", "th", "wh"], "de": ["sch", "ung", "ö", "ch", "ein"], "fr": ["eau", "é", "oi", "ç", "le"]}
    rows = []
    for i in range(900):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(rng.randint(2, 40))), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    net = langid.train(df, max_per_lang=100)
    again = langid.train(df.repartition(7), max_per_lang=100)
    assert all((a == b).all() for a, b in zip(net.weights(), again.weights()))
    got = {r.doc_id: r for r in langid.predict(df, net).collect()}
    held = [(got[i], lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 200 and sum(r.lang_pred == lang for r, lang in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    edge = langid.predict(clashing, net).collect()
    assert len(edge) == awkward.count() and {r.lang_pred for r in edge} <= {"de", "en", "fr", "und"}
    assert {r.doc_id for r in edge if r.lang_pred == "und"} == {5, 6, 7, None}
    odd = spark.createDataFrame([(1, "123 -- !"), (2, "日本"), (3, "é"), (4, "7²")], "doc_id long, text string")
    assert {r.doc_id for r in langid.predict(odd, net).collect() if r.lang_pred == "und"} == {1, 4}
    assert langid.predict(empty, net).count() == 0 and langid.train(empty) is None
    assert {(r.lang_pred, r.score) for r in langid.predict(awkward, None).collect()} == {("und", 0.0)}


def test_held_out_rows_are_not_learned_from(spark):
    rows = [(i, "aaa bbb " * 10, "x" if zlib.crc32(str(i).encode()) % 3 == 1 else "y") for i in range(60)]
    net = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert net.langs == ["y"]
