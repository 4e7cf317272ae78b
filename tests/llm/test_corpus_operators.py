"""Operators that compare or place documents among all others, and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crosspanel.llm import graph, mixing, neardup, ordering, sharding, substrings


def bag(rows):
    return Counter(tuple(r) for r in rows)


def test_feistel_is_a_permutation_at_every_size(spark):
    for n in (1, 2, 3, 5, 40, 41, 97, 1000):
        got = spark.range(n).select(sharding.permuted(F.col("id"), n).alias("p")).toPandas().p
        assert sorted(got) == list(range(n))
    one = spark.range(97).select(sharding.permuted(F.col("id"), 97, seed=1).alias("p")).toPandas().p
    two = spark.range(97).select(sharding.permuted(F.col("id"), 97, seed=2).alias("p")).toPandas().p
    assert list(one) != list(two) and list(one) != list(range(97))


def test_shards_edges(spark, awkward, awkward_rows, clashing, empty, monkeypatch):
    got = sharding.shard(awkward, shards=7).collect()
    want = bag((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in awkward_rows)
    assert bag((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 4)  # more buckets, same result
    assert bag(sharding.shard(clashing.repartition(5), shards=7).collect()) == bag(got)
    assert sharding.shard(empty).count() == 0


def test_copies_are_cut_into_pieces(spark):
    df = spark.createDataFrame([(1, 10), (2, 1)], "k long, n long")
    got = ordering.copies(df, "n", "copy", piece=4).collect()
    assert sorted((r.k, r.copy) for r in got) == [(1, i) for i in range(10)] + [(2, 0)]


def _water_level(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, rest, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while rest > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        share = {s: rest * weight[s] / total for s in open_}
        for s, x in share.items():
            target[s] += x
        rest = sum(max(0.0, target[s] - 3 * sizes[s]) for s in open_)
        for s in list(open_):
            if target[s] >= 3 * sizes[s]:
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


def test_mix_meets_targets(spark, awkward, awkward_rows, clashing, empty, monkeypatch):
    rows = mixing.plan(awkward).collect()
    sizes = defaultdict(int)
    for _, t, _, s, _ in awkward_rows:
        sizes[s] += len((t or "").split())
    want = _water_level(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-4
        assert len(r.positions) <= 3 and list(r.positions) == sorted(r.positions)
        assert all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.size * len(r.positions)
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    assert bag((r.doc_id, r.source) for r in rows) == bag((i, s) for i, _, _, s, _ in awkward_rows)
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 3)
    again = mixing.plan(clashing.repartition(4)).collect()
    assert bag((r.doc_id, r.source, r.size, r.copy, tuple(r.positions)) for r in again) == bag(
        (r.doc_id, r.source, r.size, r.copy, tuple(r.positions)) for r in rows)
    assert mixing.plan(empty).count() == 0
    mixed = mixing.mixed_rows(clashing)
    times = Counter()
    for r in rows:
        times[r.doc_id, r.source, r.size] += len(r.positions)
    got = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in mixed.collect())
    assert got == +times and mixed.columns == clashing.columns
    assert mixing.mixed_rows(empty).count() == 0


def test_positions_invert_the_schedule(spark):
    ts = np.linspace(0, 1, 2001)
    for c, schedule in enumerate(mixing.SCHEDULES):
        w = np.interp(ts, *zip(*schedule))
        demand = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(ts))])
        demand /= demand[-1]
        df = spark.createDataFrame([(float(d), c) for d in demand[::100]], "d double, c int")
        got = [r.t for r in df.select(mixing.position_at(F.col("d"), F.col("c")).alias("t")).collect()]
        assert np.allclose(got, ts[::100], atol=1e-6)


def _md5(text):
    return hashlib.md5((text or "").encode()).digest()


def _brute_repeats(docs, k):
    seen, out = set(), []
    for doc, text in sorted(docs.items(), key=lambda d: (d[0][0] is not None, d[0][0] or 0, d[0][1])):
        words, gone = (text or "").encode().split(), set()
        for i in range(len(words) - k + 1):
            w = tuple(words[i:i + k])
            if w in seen:
                gone |= set(range(i, i + k))
            seen.add(w)
        kept = b" ".join(x for i, x in enumerate(words) if i not in gone)
        out.append((doc[0], len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("unit,bucket,hot", [(20, 10, 2.0), (2_000_000, 200_000, 1e-3), (50, 20, 1e-9)])
def test_substrings_against_brute_force(spark, awkward, awkward_rows, clashing, empty, monkeypatch, unit, bucket, hot):
    monkeypatch.setattr(substrings, "BUCKET_WINDOWS", bucket * 50)
    monkeypatch.setattr(substrings, "HOT_SHARE", hot)
    rng = random.Random(unit)
    phrase = ["p q r s t u v", "l m l m l m l m", "z"]
    more = [(500 + i, " ".join(rng.choice(phrase) for _ in range(rng.randint(0, 8)))) for i in range(30)]
    docs = clashing.select("doc_id", "text", "key", "crc", "start").union(
        spark.createDataFrame(more, "doc_id long, text string").selectExpr("*", "'x'", "'x'", "'x'"))
    every = [r[:2] for r in awkward_rows] + more
    # Rows equal in id and text are one document; rows of equal id are ordered by md5.
    distinct = {(i, _md5(t)): t for i, t in every}
    order = sorted(distinct, key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    want = dict(zip(order, _brute_repeats(distinct, 5)))
    got = substrings.dedup_substrings(docs, window=5)
    assert bag(got.drop("kept").collect()) == bag(want[i, _md5(t)] for i, t in every)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got.collect())
    assert substrings.dedup_substrings(empty).count() == 0


def test_texts_of_one_id_and_one_crc32_are_two_documents(spark):
    rng = random.Random(1)
    seen = {}
    while True:
        text = " ".join(str(rng.randrange(10**6)) for _ in range(25))
        crc = zlib.crc32(text.encode())
        if crc in seen:
            break
        seen[crc] = text
    rows = [(1, text), (1, seen[crc]), (2, seen[crc]), (3, text)]
    got = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got.collect()) == [(1, 25, 0), (1, 25, 0), (2, 25, 25), (3, 25, 25)]


@pytest.mark.parametrize("unit_words", [500_000, 50, 1])
def test_a_passage_of_every_text_meets_in_two_levels(spark, monkeypatch, unit_words):
    """The number of groups follows the units; the result doesn't."""
    monkeypatch.setattr(substrings, "UNIT_WORDS", unit_words)
    monkeypatch.setattr(substrings, "BUCKET_WINDOWS", 100)
    passage = " ".join(f"common{i}" for i in range(30))
    rows = [(i, f"own{i}a own{i}b {passage} own{i}c") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    got = substrings.dedup_substrings(docs).collect()
    assert {r.doc_id: r.n_removed for r in got} == {i: 30 if i else 0 for i in range(60)}
    assert {r.kept for r in got if r.doc_id} == {f"own{i}a own{i}b own{i}c" for i in range(1, 60)}


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 120)] + [(300, 300), (200, 201), (201, 200)]
    got = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    root = {r.node: r.root for r in got}
    assert all(root[i] == 0 for i in range(41)) and all(root[i] == 100 for i in range(100, 120))
    assert root[201] == 200 and len(got) == len(root)


def test_components_extended_by_links(spark):
    first = [(i, i + 1) for i in range(10)] + [(100, x) for x in range(101, 120)] + [(50, 51)]
    later = [(5, 119), (7, 400), (401, 400), (60, 61), (50, 51), (101, 102)]
    table = lambda links: spark.createDataFrame(links, "a long, b long")
    roots = graph.components(table(first))
    got = graph.extended(roots, table(later)).collect()
    want = graph.components(table(first + later)).collect()
    assert len(got) == len(want) and set(got) == set(want)


def _brute_classes(docs, least):
    """Components of exact weighted Jaccard over all pairs, by index of the row."""
    hashes = neardup.WordHashes()
    found = [neardup.shingles((t or "").encode(), hashes) for _, t in docs]
    distinct = len(docs)
    values, df = np.unique(np.concatenate([v for v, _ in found]), return_counts=True)
    idf = 1 + np.minimum(1, np.log(distinct / df) / np.log(1 / neardup.RARE))
    idf[df <= neardup.RARE * distinct] = 2
    vectors = [(v, (1 + np.log(tf)) * idf[np.searchsorted(values, v)]) for v, tf in found]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (docs[i][1] or "") == (docs[j][1] or "") or neardup.weighted_jaccard(vectors[i], vectors[j]) >= least:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        groups[find(i)].append(d)
    return bag((d, None if None in g else min(g)) for g in groups.values() for d in g)


@pytest.mark.parametrize("small,block", [(64, 512), (2, 3)])
def test_near_duplicates_against_all_pairs(spark, awkward_rows, clashing, empty, monkeypatch, small, block):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", small)
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", block)
    rng = random.Random(8)
    docs = [r[:2] for r in awkward_rows if r[0] != 9]
    base = [f"t{i}" for i in range(120)]
    for i in range(60):  # one large group of near copies
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(120)] = f"n{i}"
        docs.append((1000 + i, " ".join(words)))
    for i in range(20):
        words = [f"u{rng.randrange(9)}" for _ in range(60)]
        docs += [(2000 + 2 * i, " ".join(words)), (2001 + 2 * i, " ".join(words[:58] + ["end", str(i)]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = neardup.classes(df)
    assert bag(got.select("doc_id", "class_id").collect()) == _brute_classes(docs, 0.8)
    if small == 2:
        return
    kept = neardup.one_of_each(df)
    firsts = neardup.near_duplicates(df).select("class_key", "class_tid").distinct()
    assert kept.count() == firsts.count()
    assert bag(kept.select(F.coalesce("doc_id", F.lit(neardup.NULL_ID))).collect()) == bag(firsts.select("class_key").collect())
    assert got.filter("is_first").select("doc_id").distinct().count() == firsts.select("class_key").distinct().count()
    one = neardup.one_of_each(clashing)
    assert one.columns == clashing.columns and one.filter("doc_id in (1, 2, 3)").count() == 1
    assert neardup.classes(empty).count() == 0 and neardup.one_of_each(empty).count() == 0


def test_samples_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(1)
    values = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    w = rng.choice([1.0, 2.0, 3.4], 400).astype(np.float32)
    w2 = w.copy()
    w2[:100] *= 2
    first = (values[:360], w[:360])
    second = (values[40:], w2[40:])
    a = neardup.samples(*first, np.array([0]), 3000)[0]
    b = neardup.samples(*second, np.array([0]), 3000)[0]
    true = neardup.weighted_jaccard((first[0], first[1].astype(float)), (second[0], second[1].astype(float)))
    assert abs((a == b).mean() - true) < 0.04


def test_frequent_shingles_are_counted_over_all(spark):
    rows = [(i, "very common five word line " + f"own{i} text{i} of{i} its{i} kind{i}") for i in range(300)]
    docs = neardup.identified(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    values, idf = neardup.frequent_shingles(docs, 300)
    mine = neardup.shingles(rows[0][1].encode(), neardup.WordHashes())[0]
    assert set(values) <= set(mine) and len(values) == 1 and idf[0] == 1.0


def test_frequent_shingles_of_small_partitions(spark):
    # At most one document of a partition holds the line, in one of ten documents in all.
    line = lambda i: "very common five word line " if i % 10 == 0 else ""
    rows = [(i, line(i) + f"own{i} text{i} of{i} its{i} kind{i}") for i in range(300)]
    docs = spark.sparkContext.parallelize(rows, 100).toDF("doc_id long, text string")
    values, idf = neardup.frequent_shingles(neardup.identified(docs), 300)
    common = neardup.shingles(b"very common five word line", neardup.WordHashes())[0]
    assert values.tolist() == common.tolist()


def test_pipeline_stages_keep_rows_and_columns(spark, clashing, empty, tmp_path_factory, awkward):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 1, 0), (100, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "one")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for docs in (clashing, empty):
        for name, apply in corpus_pipeline.STAGES:
            out = apply(spark, docs, folder)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            out.collect()
    assert len(corpus_pipeline.STAGES) == 5
    awkward.write.parquet(f"{folder}/documents.parquet")
    rows = corpus_pipeline.run(spark, folder).collect()
    assert 8 not in {r.doc_id for r in rows} and len({(r.shard, r.slot) for r in rows}) == len(rows)
    clean = awkward.filter("doc_id >= 100 and text is not null")
    assert {r.doc_id for r in rows} <= {r.doc_id for r in awkward.select("doc_id").collect()}
    assert clean.count() == 40
