"""Operators that judge each document by itself, and their edge cases."""

import random
import zlib
from collections import Counter

import pytest

from crosspanel.llm import chat, decontaminate, quality, tokens, toxicity, urls
from crosspanel.llm.text import folded_words, raw_words, with_bytes


def bag(rows):
    return Counter(tuple(r) for r in rows)


def test_quality_edges_and_order(spark, awkward, awkward_rows, clashing, empty):
    got = quality.cascade(awkward, with_stats=True).collect()
    assert len(got) == len(awkward_rows)
    by_id = {r.doc_id: r for r in got}
    assert (by_id[5].n_words, by_id[6].n_words, by_id[7].n_words) == (0, 0, 0) and by_id[5].base_failed
    assert by_id[10].n_dup_lines == 39 and by_id[10].n_repeat_words == 40 and not by_id[10].kept
    assert bag(quality.cascade(clashing, with_stats=True).drop("rules_run", "failed_rule").collect()) == bag(
        quality.cascade(awkward, with_stats=True).drop("rules_run", "failed_rule").collect())
    assert quality.cascade(empty).count() == 0
    # A verdict does not depend on the order of the rules.
    for text in (r[1] for r in awkward_rows):
        f = quality.Features((text or "").encode())
        kept = not any(rule.rejects(f) for rule in quality.RULES)
        for order in (quality.RULES, quality.RULES[::-1]):
            out = quality._judge(list(order), ())({"doc_id": [1], "text": [(text or "").encode()]})
            assert out["kept"] == [kept]


def test_cascade_runs_rules_by_rejections_per_cost(spark):
    docs = spark.createDataFrame([(i, "a " * 4) for i in range(200)], "doc_id long, text string")
    order = quality.estimate(with_bytes(docs, "doc_id", "text"))
    assert order[0].name in ("few_words", "word_length") and len(order) == len(quality.RULES)
    assert all(r.rules_run == 1 for r in quality.cascade(docs).collect())


def test_repeat_words_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 30))]
        windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        twice = {w for w, n in Counter(windows).items() if n > 1}
        hit = {i + j for i, w in enumerate(windows) if w in twice for j in range(5)}
        assert quality.Features(" ".join(words).encode()).n_repeat_words == len(hit)


def _naive_hits(words, patterns):
    hit, items = set(), set()
    for seq, item in patterns:
        for i in range(len(words) - len(seq) + 1):
            if tuple(words[i:i + len(seq)]) == seq:
                hit |= set(range(i, i + len(seq)))
                items.add(item)
    return len(hit), sorted(items)


@pytest.mark.parametrize("block", [3, 100_000])
def test_wu_manber_against_naive_search(spark, block):
    rng = random.Random(block)
    say = lambda n: " ".join(rng.choice(["a", "b", "É", "c3"]) for _ in range(n))
    items = [(i, say(rng.randint(0, 8))) for i in range(6)] + [(7, None), (8, "!?"), (None, "b b b")]
    docs = [(i, say(rng.randint(0, 60)).upper().replace("É", "É")) for i in range(25)] + [(99, None), (98, "")]
    got = decontaminate.decontaminate(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"), window=4, block_patterns=block,
    ).collect()
    patterns = []
    for item, text in items:
        words = folded_words(text.encode() if text else None)
        size = min(4, len(words))
        patterns += [(tuple(words[i:i + size]), "null" if item is None else str(item))
                     for i in range(len(words) - size + 1 if size else 0)]
    want = {i: _naive_hits(folded_words((t or "").encode()), patterns) for i, t in docs}
    assert {r.doc_id: (r.n_hit, r["items"]) for r in got} == want


def test_decontamination_edges(spark, awkward, clashing, empty):
    bench = spark.createDataFrame([(1, "one"), (1, "one"), (2, "changed"), (3, "")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.decontaminate(awkward, bench)
    assert {r.doc_id for r in got.filter("contaminated").collect()} == {3, 8}
    same = [c for c in got.columns if c != "items"]
    assert bag(decontaminate.decontaminate(clashing, bench).select(same).collect()) == bag(got.select(same).collect())
    clean = decontaminate.clean_rows(clashing, bench)
    assert clean.count() == awkward.count() - 3 and clean.columns == clashing.columns
    assert decontaminate.clean_rows(clashing, bench, block_patterns=1).count() == clean.count()
    assert decontaminate.decontaminate(awkward, none).filter("contaminated").count() == 0
    assert decontaminate.decontaminate(empty, bench).count() == 0


def test_toxicity_learns_pairs_and_takes_edges(spark, awkward, clashing, empty):
    rng = random.Random(2)
    filler = [f"w{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(3000):
        words, toxic = rng.choices(filler, k=25), 0
        kind = rng.randint(0, 4)
        if kind == 0:
            words.append("grim")  # harmless alone
        elif kind == 1:
            words.append("tribe")  # harmless alone
        elif kind == 2:
            words += ["grim", "tribe"]
            toxic = 1
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    docs_df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    labels_df = spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs_df, labels_df)
    assert toxicity.train(docs_df.repartition(5), labels_df) == model
    got = {r.doc_id: r.score for r in toxicity.score(docs_df, model).collect()}
    held = [(got[i], y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((s >= 0.5) == (y == 1) for s, y in held) / len(held)
    assert len(held) > 400 and right > 0.95
    edge = toxicity.score(clashing, model).collect()
    assert len(edge) == awkward.count() and all(0 <= r.score <= 1 for r in edge)
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.train(empty, labels_df) is None and toxicity.train(docs_df, labels_df.limit(0)) is None
    assert {r.score for r in toxicity.score(awkward, None).collect()} == {0.0}
    kept = toxicity.accepted_rows(clashing, model)
    assert kept.columns == clashing.columns and kept.count() == awkward.count()


def test_token_counts_equal_the_library(spark, awkward, awkward_rows, clashing, empty):
    sp = tokens.load(tokens.default_model())
    rng = random.Random(3)
    extra = [(1000 + i, "".join(rng.choice("ab \n▁\t\réß日{;<>/s.1 ") for _ in range(rng.randint(0, 30)))) for i in range(300)]
    docs = awkward.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    want = bag((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in [r[:2] for r in awkward_rows] + extra)
    for hot in (0, 20, 200_000):
        got = tokens.count_tokens(docs, hot=hot).select("doc_id", "n_bytes", "n_tokens").collect()
        assert bag(got) == want
    assert tokens.count_tokens(clashing).filter("over_limit").count() == 1
    assert tokens.count_tokens(empty).count() == 0


def test_a_long_pretoken_of_every_text_is_no_join_key(spark):
    sp = tokens.load(tokens.default_model())
    rule = "-" * 60
    texts = [f"{rule} word{i} {rule}\n{'=' * (40 + i % 3)} {'x' * 33}{i}" for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (0, 4, 200_000):
        got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, hot=hot).collect()}
        assert got == {i: len(sp.encode(t)) for i, t in enumerate(texts)}
    shared = type("Broadcast", (), {"value": {tokens.join_key(f" {rule}".encode()): 7}})
    row = tokens._sum_hot(shared)()({"doc_id": [1], "text": [texts[0].encode()]})
    assert row["hot_tokens"] == [14] and all(len(k) <= tokens.HOT_BYTES for k in row["cold"][0])


def test_url_scores_do_not_depend_on_what_is_broadcast(spark):
    # Sources of a common prefix: the same substrings in every URL.
    rows = [(f"^http://{'ab'[i % 2]}{i % 9}.org/{i}$", int(i % 2 == 0), int(i % 2)) for i in range(200)]
    seen = spark.createDataFrame(rows, "s string, accepted long, rejected long")
    seen = urls.stage(seen.withColumn("id", urls.F.monotonically_increasing_id()))
    model = urls.stage(urls.language_models(seen))
    want = None
    for hot in (0, 40, urls.HOT_GRAMS):
        got = {r.id: r.score for r in urls.scores(seen, model, hot).collect()}
        assert len(got) == 200 and (want is None or got == want)
        want = got


def test_url_rules_and_edges(spark):
    rows = [
        (1, "https://Sub.Example.ORG/es/x"), (2, "http://example.org/en/12?q"), (3, "http://a.org"),
        (4, "http://b.com/fr/1#t"), (5, "http://xcom/de/"), (6, None), (7, "no scheme"), (8, ""),
        (9, "http://c.com/de/?x=/fr/"), (10, "x://h/" + "a" * 50_000), (10, "http://b.com/fr/1#t"),
    ] + [(100 + i, f"http://{'g' if i % 2 else 'b'}{i % 7}.example.{'org/x' if i % 2 else 'com/de/'}{i}") for i in range(300)]
    pages = spark.createDataFrame([(i, u, "html", "s") for i, u in rows], "page_id long, url string, html string, score string")
    got = {(r.page_id, r.host): r for r in urls.judge(pages).collect()}
    assert got[1, "sub.example.org"].rule == "example.org/es/" and got[1, "sub.example.org"].verdict == "block"
    assert got[2, "example.org"].rule == "example.org/en/1" and got[2, "example.org"].path == "/en/12"
    assert got[3, "a.org"].rule is None and got[3, "a.org"].path == ""
    assert got[4, "b.com"].verdict == "allow" and got[5, "xcom"].rule is None
    assert all((got[i, ""].host, got[i, ""].path) == ("", "") for i in (6, 7, 8))
    assert got[9, "c.com"].rule == "com/de/" and len(got) == len(rows)
    fresh = [(1, "http://g3.example.net/x1"), (2, "http://b2.example.net/de/4")]
    both = pages.select("page_id", "url").union(spark.createDataFrame(fresh, "page_id long, url string").selectExpr("page_id + 5000", "url"))
    new = {r.page_id: r for r in urls.judge(both).collect()}
    assert new[5001].verdict == "allow" and new[5002].verdict == "block"
    assert new[5001].score > new[5002].score
    assert urls.judge(pages.limit(0)).count() == 0
    alone = urls.judge(spark.createDataFrame(fresh, "page_id long, url string")).collect()
    assert {r.verdict for r in alone} == {"allow"}


def test_chat_round_trip_and_parts(spark):
    rows = [
        (1, 2, "assistant", "&amp;lt; [TURN]user[SAYS]</s>[INST]", "x"), (1, 1, "user", None, "x"), (1, 2, "assistant", "b", "x"),
        (2, None, None, "", "x"), (None, 1, "us[er&", "\n é", "x"), (3, 1, "assistant", "y " * 100_000, "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    out = chat.format_chat(df).withColumn("back", chat.read_back(chat.F.col("formatted"))).collect()
    want = {}
    for c, t, role, text, _ in rows:
        want.setdefault(c, []).append((t is not None, t, role or "", text or ""))
    for r in out:
        assert [(b.role, b.text) for b in r.back] == [w[2:] for w in sorted(want[r.conv_id], key=lambda w: (w[0], w[1] or 0, w[2], w[3]))]
        assert r.formatted.count(chat.TURN) == len(want[r.conv_id])
    part = lambda kind, text=None, ref=None, tokens=None: (kind, text, ref, tokens)
    typed = spark.createDataFrame(
        [(1, 0, "user", [part("text", "see <image:1>"), part("image", ref="i.png"), part("audio", ref="a.wav", tokens=9)]),
         (1, 1, "assistant", [part("document", ref="d.pdf"), part("text", "ok")]), (2, 0, "user", [])],
        f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = {r.conv_id: r for r in chat.format_chat(typed, parts_col="parts").collect()}
    assert got[1].formatted == "[TURN]user[SAYS]see &lt;image:1><image:1><audio:2>[END][TURN]assistant[SAYS]<document:3>ok[END]"
    assert [(a.number, a.kind, a.ref, a.tokens) for a in got[1].attachments] == [
        (1, "image", "i.png", 576), (2, "audio", "a.wav", 9), (3, "document", "d.pdf", 2048)]
    assert got[1].attachment_tokens == 576 + 9 + 2048 and got[2].formatted == "[TURN]user[SAYS][END]"
    assert [(a.start, a.length) for a in got[1].mask] == [(got[1].formatted.index("ok[END]"), 2)]
    assert chat.format_chat(df.limit(0)).count() == 0


def _flattened(messages):
    """The definition: formatted, loss text, attachments of messages (turn, role, parts)."""
    out, loss, held = "", "", []
    esc = lambda t: (t or "").replace("&", "&amp;").replace("<", "&lt;").replace("[", "&#91;")
    for _, role, parts in sorted(messages, key=lambda m: (m[0], m[1] or "")):
        out += f"[TURN]{esc(role)}[SAYS]"
        for kind, text, ref, tokens in parts or []:
            if kind in chat.DEFAULT_TOKENS:
                held.append((len(held) + 1, kind, ref, chat.DEFAULT_TOKENS[kind] if tokens is None else tokens))
                out += f"<{kind}:{len(held)}>"
            else:
                out += esc(text)
                loss += (text or "") if role == "assistant" else ""
        out += "[END]"
    return out, loss, held


def test_typed_conversations_of_many_parts(spark):
    rng = random.Random(8)

    def parts(n):
        return [(rng.choice(["text", "text", "image", "audio", "document", "odd", None]),
                 rng.choice(["a[TURN]", "é 𝄞&lt;", "", None, "&#91;</s>", "x"]), rng.choice([None, "r<1>"]),
                 rng.choice([None, 0, 7])) for _ in range(n)]

    talks = {c: [(t, "assistant" if t % 2 else rng.choice(["user", "[x]", None]), parts(rng.randint(0, 6)))
                 for t in range(rng.randint(1, 9))] for c in range(20)}
    talks[50] = [(0, "user", parts(3)), (1, "assistant", parts(10_000)), (2, "user", None)]
    talks[51] = [(t, "assistant", [("text", f"<{t}> 𝄞", None, None)]) for t in range(5_000)]
    rows = [(c, t, r, p, "clash", "clash") for c, ms in talks.items() for t, r, p in ms]
    rng.shuffle(rows)
    df = spark.createDataFrame(
        rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>, mask string, nth string")
    out = chat.format_chat(df, parts_col="parts").withColumn(
        "loss", chat.masked_text(chat.F.col("formatted"), chat.F.col("mask")))
    for r in out.collect():
        formatted, loss, held = _flattened(talks[r.conv_id])
        assert r.formatted == formatted and r.loss == loss
        assert [(a.number, a.kind, a.ref, a.tokens) for a in r.attachments] == held
        assert r.attachment_tokens == sum(h[3] for h in held)


def test_word_patterns():
    assert raw_words("a\x0bb\x1cc\xa0d  e".encode()) == ["a".encode(), "b\x1cc\xa0d".encode(), b"e"]
    assert folded_words("Äb-C9É".encode()) == ["Äb".encode(), "c9É".encode()]
