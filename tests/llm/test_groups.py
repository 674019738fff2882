"""Operators over groups against brute force: joins, passages, search, mixing, models, the pipeline."""

from __future__ import annotations

import random
import re
import time
import tracemalloc
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import ODD, documents, shipped  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline
from leadgauge.llm import components, hashing, jaccard_join, linear, mixing, quality, queries, shared, substring_dedup, topk, toxicity

SF = "/root/testdata/sf0.001"
ODD_SPACES = ["a" + chr(c) + "b" for c in range(33)]


def _family(generator: random.Random, words: list[str], length: int, members: int, edits: int) -> list[str]:
    base = generator.choices(words, k=length)
    family = []
    for _ in range(members):
        copy = list(base)
        for _ in range(generator.randint(0, edits)):
            copy[generator.randrange(length)] = generator.choice(words)
        family.append(" ".join(copy))
    return family


def _brute_components(rows: list[tuple], size: int, percent: int) -> tuple[Counter, int, int]:
    """(id, size, component) of all rows by comparing all pairs, how many components have words, and how many rows have none."""
    sets = []
    for _, text in [r[:2] for r in rows]:
        own = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        sets.append({tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own else set())
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                root[find(x)] = find(y)
    least: dict[int, list] = {}
    for x, row in enumerate(rows):
        least.setdefault(find(x), []).append(row[0])
    smallest = {r: min((i for i in ids if i is not None), default=None) for r, ids in least.items()}
    filled = {find(x) for x in range(len(rows)) if sets[x]}
    return Counter((row[0], len(sets[x]), smallest[find(x)]) for x, row in enumerate(rows)), len(filled), sum(not s for s in sets)


@pytest.mark.parametrize(("size", "percent", "edits", "partners", "differences", "batch"), [
    (4, 85, 8, 1024, 4_000_000, 10_000), (5, 80, 8, 1024, 4_000_000, 7), (5, 80, 16, 3, 4_000_000, 10_000), (4, 85, 14, 1024, 300, 10_000),
])
def test_jaccard_components(spark, documents, monkeypatch, size, percent, edits, partners, differences, batch):
    monkeypatch.setattr(jaccard_join, "HELD_PARTNERS", partners)
    monkeypatch.setattr(jaccard_join, "HELD_DIFFERENCES", differences)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    generator = random.Random(size + edits)
    words = [f"w{n}" for n in range(2000)]
    texts = [t for n, m, e in ((120, 40, edits), (35, 20, 3), (10, 15, 1), (3, 4, 0)) for t in _family(generator, words, n, m, e)]
    generator.shuffle(texts)
    rows = [(100 + n, text) for n, text in enumerate(texts)] + ODD
    expected, components_, empty = _brute_components(rows, size, percent)
    try:
        found = jaccard_join.jaccard_components(documents(rows, "node"), size, percent)
        assert Counter(map(tuple, found.select("doc_id", "n_shingles", "component_id").collect())) == expected
        if batch == 7:
            kept = jaccard_join.one_of_each(documents(rows, "key"), size, percent).collect()
            assert sum(bool((r.text or "").strip()) for r in kept) == components_
            assert sum(not (r.text or "").strip() for r in kept) == empty
            assert jaccard_join.jaccard_components(documents([]), size, percent).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@given(st.integers(2, 12), st.integers(5, 60), st.integers(0, 1 << 30))
@settings(max_examples=100, deadline=None)
def test_links_of_partners_join_all_that_link(m, size, seed):
    generator = np.random.default_rng(seed)
    base = np.unique(generator.integers(0, 1 << 63, size, dtype=np.uint64))
    pool = np.unique(generator.integers(0, 1 << 63, 20, dtype=np.uint64))
    sets = []
    for _ in range(m + 1):
        kept = base[generator.random(len(base)) > generator.choice([0.05, 0.2, 0.4])]
        sets.append(np.union1d(kept, generator.choice(pool, generator.integers(1, 8), replace=False)))
    hub, partners = sets[0], []
    for n, own in enumerate(sets[1:]):
        common = len(np.intersect1d(hub, own))
        linked = 100 * common >= 80 * (len(hub) + len(own) - common)
        partners.append((n, linked, np.setdiff1d(own, hub), np.setdiff1d(hub, own)))
    joined = list(range(m + 1))
    links = jaccard_join.links_of_partners(len(hub), partners, 80) + [(n, m) for n, linked, _, _ in partners if linked]
    for _ in joined:
        for a, b in links:
            joined[a] = joined[b] = min(joined[a], joined[b])
    for a in range(m):
        for b in range(a):
            common = len(np.intersect1d(sets[1 + a], sets[1 + b]))
            if 100 * common >= 80 * (len(sets[1 + a]) + len(sets[1 + b]) - common):
                assert joined[a] == joined[b]
    for a, b in jaccard_join.links_of_partners(len(hub), partners, 80):
        common = len(np.intersect1d(sets[1 + a], sets[1 + b]))
        assert 100 * common >= 80 * (len(sets[1 + a]) + len(sets[1 + b]) - common)


@given(st.integers(1, 300), st.integers(0, 60), st.integers(0, 1 << 30))
@settings(max_examples=150, deadline=None)
def test_linked_sets_share_a_signature(size, differences, seed):
    generator, bands = np.random.default_rng(seed), jaccard_join.Bands(80)
    pool = np.unique(generator.integers(0, 1 << 63, size + differences, dtype=np.uint64))
    one, other = pool[: len(pool) - differences // 2], pool[differences - differences // 2 :]
    common = len(np.intersect1d(one, other))
    if len(one) and len(other) and 100 * common >= 80 * (len(one) + len(other) - common):
        shared = np.intersect1d(jaccard_join.signatures(one, bands), jaccard_join.signatures(other, bands))
        assert len(shared)


@given(st.integers(2, 9), st.integers(1, 300), st.integers(0, 1 << 30))
@settings(max_examples=150, deadline=None)
def test_sketches_leave_out_no_set_that_links(m, size, seed):
    generator = np.random.default_rng(seed)
    pool = np.unique(generator.integers(0, 1 << 64, 2 * size + 20, dtype=np.uint64))
    generator.shuffle(pool)
    sets = []
    for _ in range(m):
        kept = pool[:size][generator.random(size) > generator.choice([0, 0.05, 0.1, 0.2, 0.6])]
        sets.append(np.union1d(kept, generator.choice(pool[size:], generator.integers(1, 2 + size // 8), replace=False)))
    near = jaccard_join.near_another([jaccard_join.sketch_of(x) for x in sets], 80)
    for a in range(m):
        for b in range(a):
            common = len(np.intersect1d(sets[a], sets[b]))
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                assert near[a] and near[b]


def test_sketches_of_crowded_ranges_are_near_to_all():
    crowded = np.arange(2000, dtype=np.uint64)
    assert jaccard_join.sketch_of(crowded) == b""
    other = jaccard_join.sketch_of(hashing.mixed(np.arange(40, dtype=np.uint64)))
    assert jaccard_join.near_another([other, b"", other], 80).all()
    far = [jaccard_join.sketch_of(hashing.mixed(np.arange(n, n + 40, dtype=np.uint64))) for n in (0, 1000, 1002, 2000)]
    assert jaccard_join.near_another(far, 80).tolist() == [False, True, True, False]


def test_texts_that_share_a_line_only_are_not_moved(documents, monkeypatch):
    generator = random.Random(8)
    line = " ".join(f"line{n}" for n in range(14))
    texts = [" ".join(generator.choices([f"w{n}" for n in range(3000)], k=80)) + " " + line for _ in range(60)]
    copies = [text + " and more" for text in texts[:9]]
    verified, candidates, kept = [], [], jaccard_join._verified
    near = jaccard_join._near

    def counted(pairs, *others):
        verified.append({frozenset(r) for r in pairs.select("a", "b").collect()})
        return kept(pairs, *others)

    def listed(pairs, *others):
        candidates.append(pairs.count())
        return near(pairs, *others)

    monkeypatch.setattr(jaccard_join, "_verified", counted)
    monkeypatch.setattr(jaccard_join, "_near", listed)
    rows = jaccard_join.one_of_each(documents(list(enumerate(texts + copies)))).collect()
    assert sorted(r.doc_id for r in rows) == list(range(60))
    assert candidates[0] >= 60 and len(verified) == 1
    assert len({node for pair in verified[0] for node in pair}) < 30  # of 69: the copied ones, their copies and hubs of the line


def test_buckets_are_sorted_range_by_range(documents, monkeypatch):
    generator = random.Random(9)
    words = [f"w{n}" for n in range(300)]
    docs = documents(list(enumerate(_family(generator, words, 40, 30, 4) + _family(generator, words, 12, 20, 1))))
    tables, kept = {}, jaccard_join.stored

    def noted(df, name):
        tables.setdefault(name, []).append(kept(df, name))
        return tables[name][-1]

    monkeypatch.setattr(jaccard_join, "stored", noted)
    monkeypatch.setattr(jaccard_join, "discard", lambda *_: None)
    found = Counter(map(tuple, jaccard_join._buckets(docs, 5, 80).collect()))
    nodes: dict[int, set] = {}
    for signature, node in tables["signatures"][0].collect():
        nodes.setdefault(signature, set()).add(node)
    assert found == Counter((s, node, min(own)) for s, own in nodes.items() if len(own) > 1 for node in own)
    sizes = [table.count() for table in tables["buckets"]]
    assert len(sizes) == 4 and max(sizes) < 0.5 * sum(sizes)


def test_stored_leaves_no_shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()

    def files() -> set[Path]:
        return {p for folder in folders for p in Path(str(folder)).rglob("shuffle_*")}

    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_, before = spark.conf.get(conf), files()
    rows = spark.range(50_000).groupBy((F.col("id") % 999).alias("k")).count().repartition(3, "count")
    assert shared.stored(rows, "counts").count() == 999
    for _ in range(100):
        if not any("_0.data" in p.name for p in files() - before):
            break
        time.sleep(0.1)
    # counting 999 rows shuffles a number for each file; the write's own are gone
    assert sum(p.stat().st_size for p in files() - before if p.exists()) < 2000
    assert spark.conf.get(conf) == set_


@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=25))
@settings(max_examples=8, deadline=None)
def test_components(spark, edges):
    found = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    root = {x: x for edge in edges if edge[0] != edge[1] for x in edge}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert found == root


@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.integers(1, 8))
@settings(max_examples=200, deadline=None)
def test_compact_windows_cover_every_stretch(values, width):
    left, centre, right = substring_dedup.compact_windows(np.array(values, dtype=np.uint64), width)
    windows = list(zip(left.tolist(), centre.tolist(), right.tolist()))
    for a in range(len(values)):
        for b in range(a + width, len(values) + 1):
            assert any(lo <= a <= hi and b - 1 <= hi and values[c] == min(values[a:b]) for lo, c, hi in windows)


@given(st.lists(st.lists(st.integers(0, 6), min_size=4, max_size=30), min_size=1, max_size=5), st.integers(1, 4))
@settings(deadline=None, max_examples=60)
def test_compact_windows_of_many_texts_are_those_of_each(texts, width):
    each = [np.stack(substring_dedup.compact_windows(np.array(t, dtype=np.uint64) + 1, width)) for t in texts]
    begins = np.cumsum([0, *map(len, texts)])[:-1]
    values = np.concatenate(texts).astype(np.uint64) + 1
    together = np.stack(substring_dedup.compact_windows(values, width, begins))
    assert together.T.tolist() == np.concatenate([e + b for e, b in zip(each, begins)], axis=1).T.tolist()


def test_words_of_passages_are_counted_by_their_bytes(documents):
    texts = ["", None, " a\u00a0b\tc\x0b\r\nd ", "\u2003 x", "a " * 400_000, "\x1c\x00", *ODD_SPACES]
    docs = documents(list(enumerate(texts))).select("doc_id", substring_dedup.text_or_empty().alias("text"))
    counted = docs.select("doc_id", substring_dedup._word_count("text").alias("n"))
    assert "ArrowEvalPython" in counted._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.n for r in counted.collect()} == {n: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for n, t in enumerate(texts)}


def test_repeated_passages(documents):
    generator = random.Random(5)
    words = [f"v{n}" for n in range(3000)]
    passage = generator.choices(words, k=60)
    line = generator.choices(words, k=20)
    texts = []
    for n in range(12):
        own = generator.choices(words, k=generator.randint(40, 200))
        at = generator.randrange(len(own))
        texts.append(" ".join(own[:at] + (passage if n < 4 else line) + own[at:]))
    near = generator.choices(words, k=120)
    edited = list(near)
    edited[60] = "changed"
    rows = [(10 + n, t) for n, t in enumerate(texts)] + [(50, " ".join(near)), (51, " ".join(edited)), (60, texts[-1])]
    found = substring_dedup.repeated_passages(documents(rows + ODD, "class_id")).collect()
    got = {r.doc_id: r for r in found if r.doc_id is not None and r.doc_id >= 10}
    assert len(found) == len(rows) + len(ODD)
    for n in range(4):
        spans = [texts[n].split()[p.start : p.end] for p in got[10 + n].passages]
        assert any(" ".join(passage) in " ".join(s) for s in spans) and got[10 + n].repeated_words <= 64
        assert got[10 + n].class_id == 10
    assert all(got[10 + n].repeated_words == 0 for n in range(4, 11))
    assert got[50].class_id == got[51].class_id == 50 and got[50].repeated_words >= 110
    assert got[60].class_id == 21 and got[60].repeated_words == got[60].n_words
    assert all(r.repeated_words == 0 and r.class_id == r.doc_id for r in found if r.doc_id in (2, 3, 4))
    assert substring_dedup.repeated_passages(documents([])).count() == 0


def test_equal_passages_under_frequent_shorter_runs(documents):
    """Every stretch of 50 words that two texts hold is found, whoever else holds most of it."""
    generator = random.Random(11)
    words = [f"v{n}" for n in range(3000)]
    run = generator.choices(words, k=46)

    def text(inner: list[str]) -> list[str]:
        return generator.choices(words, k=40) + inner + generator.choices(words, k=40)

    texts = [text(run) for _ in range(25)]
    for _ in range(8):
        inner = generator.choices(words, k=2) + run + generator.choices(words, k=3)
        texts += [text(inner), text(inner)]
    texts += [["again"] * 70 + generator.choices(words, k=30), generator.choices(words, k=30) + ["again"] * 60]
    holders: dict = {}
    for n, own in enumerate(texts):
        for at in range(len(own) - 49):
            holders.setdefault(tuple(own[at : at + 50]), []).append((n, at))
    expected: dict = {n: set() for n in range(len(texts))}
    for held in holders.values():
        if len({n for n, _ in held}) > 1:
            for n, at in held:
                expected[n].update(range(at, at + 50))
    found = substring_dedup.repeated_passages(documents([(n, " ".join(own)) for n, own in enumerate(texts)])).collect()
    got = {r.doc_id: {w for p in r.passages for w in range(p.start, p.end)} for r in found}
    assert all(got[n] >= expected[n] for n in expected)
    classes = {r.doc_id: r.class_id for r in found}
    assert all(classes[n] == classes[held[0][0]] for held in holders.values() for n, _ in held)


def test_edited_passages_are_linked_whichever_is_the_hub(documents):
    """Variants link with their original but not with each other."""
    generator = random.Random(12)
    words = [f"v{n}" for n in range(3000)]
    original = generator.choices(words, k=60)
    texts = [original]
    for at in range(10, 50, 2):
        texts.append([*original[:at], f"new{at}", *original[at + 1 :]])
    rows = [(n, " ".join(generator.choices(words, k=30) + t + generator.choices(words, k=30))) for n, t in enumerate(texts)]
    found = substring_dedup.repeated_passages(documents(rows)).collect()
    linked = [r for r in found if r.class_id == 0 and r.repeated_words >= 50]
    assert len(linked) >= 0.9 * len(rows)


def test_every_shared_passage_of_two_texts_is_verified(documents):
    generator = random.Random(13)
    words = [f"v{n}" for n in range(3000)]
    pairs = [(generator.choices(words, k=56), generator.choices(words, k=56)) for _ in range(6)]
    rows = []
    for one, other in pairs:
        changed = [*other[:26], "changed", *other[27:]]
        rows += [generator.choices(words, k=20) + one + generator.choices(words, k=30) + other for _ in range(2)]
        rows[-1] = rows[-1][:-56] + changed
        rows += [generator.choices(words, k=60) + other[:45] + generator.choices(words, k=9) for _ in range(3)]
    found = substring_dedup.repeated_passages(documents([(n, " ".join(r)) for n, r in enumerate(rows)])).collect()
    got = {r.doc_id: r.repeated_words for r in found}
    assert sum(got[5 * n + k] >= 108 for n in range(6) for k in range(2)) >= 11


@pytest.mark.parametrize(("partners", "tokens"), [(1024, 4_000_000), (3, 500)])
def test_recall_of_edited_passages_in_crowded_keys(documents, monkeypatch, partners, tokens):
    """Brute force over all pairs of texts: which variants of one passage have a stretch of 50 words at a similarity of 0.8."""
    monkeypatch.setattr(substring_dedup, "HELD_PARTNERS", partners)
    monkeypatch.setattr(substring_dedup, "HELD_TOKENS", tokens)
    generator = random.Random(partners + tokens)
    words = [f"v{n}" for n in range(4000)]
    texts, families = [], []
    for members, edits in ((30, 2), (25, 3), (12, 1)) if partners > 3 else ((14, 2), (12, 1)):
        original, family = generator.choices(words, k=62), []
        for _ in range(members):
            variant = list(original)
            for _ in range(generator.randint(1, edits)):
                variant[generator.randrange(62)] = generator.choice(words)
            family.append(variant)
        run = original[20:44]  # a shorter run that others share
        families.append((len(texts), family))
        texts += [generator.choices(words, k=25) + variant + generator.choices(words, k=25) for variant in family]
        texts += [generator.choices(words, k=40) + run + generator.choices(words, k=40) for _ in range(members // 2)]
    found = substring_dedup.repeated_passages(documents([(n, " ".join(own)) for n, own in enumerate(texts)])).collect()
    class_of = {r.doc_id: r.class_id for r in found}
    repeated = {r.doc_id: r.repeated_words for r in found}
    linked, kept, covered, expected = 0, 0, 0, set()
    for start, family in families:
        shingles = [[tuple(v[i : i + 5]) for i in range(58)] for v in family]
        for x in range(len(family)):
            for y in range(x):
                sets = (({*shingles[x][a : a + 46]}, {*shingles[y][a : a + 46]}) for a in range(13))
                if any(100 * len(s & t) >= 80 * len(s | t) for s, t in sets):
                    linked += 1
                    kept += class_of[start + x] == class_of[start + y]
                    expected |= {start + x, start + y}
    covered = sum(repeated[n] >= 50 for n in expected)
    assert linked > 20 and kept >= 0.9 * linked and covered >= 0.9 * len(expected)
    alone = set(range(len(texts))) - {s + n for s, family in families for n in range(len(family))}
    assert all(repeated[n] == 0 and class_of[n] == n for n in alone)


@pytest.mark.parametrize("settings_", [{}, {"shard_rows": 40, "block_rows": 3}])
def test_top_k(spark, settings_):
    generator = np.random.default_rng(3)
    vectors = [(n, generator.normal(size=8).tolist()) for n in range(300)]
    vectors += [(n, vectors[50][1]) for n in range(300, 340)] + [(50, vectors[50][1]), (None, vectors[0][1])]
    bad = [(400, None), (450, [1.0] * 7 + [None]), (500, [float("nan")] * 8), (550, [float("inf")] + [0.0] * 7)]
    vectors += [(n, generator.normal(size=3).tolist()) for n in range(600, 720, 5)] + [(800, []), (801, [])]
    vectors += [(850 + n, [float(n) * 1e30, 1.0]) for n in range(3)]
    df = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<float>").withColumn("row", F.lit(1))
    found = topk.top_k(df.repartition(3), **settings_)
    whole = [(i, [int(x) * 256 if abs(x) > 1e9 else int(np.floor(256 * x)) for x in np.asarray(v, dtype=np.float32).astype(float).tolist()]) for i, v in vectors]
    expected = Counter()
    for x, (i, q) in enumerate(whole):
        if i is not None and i % 50 == 0:
            others = [(-min(sum(a * b for a, b in zip(q, v)), (1 << 63) - 1), j if j is not None else 1 << 62, j) for y, (j, v) in enumerate(whole) if y != x and len(v) == len(q)]
            expected += Counter((i, rank, j, -s) for rank, (s, _, j) in enumerate(sorted(others)[:5], 1))
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()) == expected
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.filter("vec_id in (0, 1)")).count() == 1


@given(st.integers(1, 200), st.integers(1, 4), st.integers(1, 7), st.integers(0, 1 << 30))
@settings(max_examples=60, deadline=None)
def test_ball_tree_search_is_exact(n, width, k, seed):
    generator = np.random.default_rng(seed)
    vectors = generator.integers(-4, 5, (n, width)).astype(float)
    ids = generator.integers(0, 50, n)
    shard = topk.Shard(vectors, ids, np.arange(n))
    shard.tree = topk.BallTree(vectors, leaf_rows=3)
    search = topk.Search(shard, vectors, np.arange(n), np.full(n, topk.NO_SCORE), k)
    search.run()
    for x in range(n):
        best = sorted((-int(vectors[x] @ vectors[y]), int(ids[y]), y) for y in range(n) if y != x)[:k]
        found = [(-s, i, r) for s, i, r in zip(search.scores[x].tolist(), search.ids[x].tolist(), search.rows[x].tolist()) if s > topk.NO_SCORE]
        assert found == best


def test_ball_tree_leaves_subtrees_out():
    generator = np.random.default_rng(6)
    vectors = (generator.integers(-8, 9, (2000, 1)) * 300 + generator.integers(0, 20, (2000, 4))).astype(float)
    shard, looked = topk.Shard(vectors, np.arange(2000), np.arange(2000)), []
    search = topk.Search(shard, vectors[:50], np.arange(50), np.full(50, topk.NO_SCORE), 5)
    plain = search._take
    search._take = lambda which, members, scores: (looked.append(scores.size), plain(which, members, scores))
    search.run()
    assert sum(looked) < 0.5 * 50 * 2000


@given(st.lists(st.integers(0, 50), min_size=1, max_size=9))
def test_targets_share_everything(words):
    weights = [1 + n % 3 for n in range(len(words))]
    found = mixing.targets(words, weights, 3)
    assert sum(found) == sum(words)
    assert all(t <= 3 * w for t, w in zip(found, words))
    units = [t / g for t, g, w in zip(found, weights, words) if t < 3 * w]
    assert len(set(units)) <= 1
    assert all(t / g <= units[0] for t, g in zip(found, weights)) if units else True


def test_mix(spark, documents):
    generator = random.Random(8)
    rows = [(n, "w " * generator.randint(1, 60), generator.choice(["a", "b", "c", None])) for n in range(400)]
    rows += [(900, "same text here", "b")] * 30 + [(901, "z " * 3, "tiny"), (None, "no id", "a"), (902, None, "a"), (903, "", None)]
    docs = documents(rows, "shard").withColumn("extra", F.lit(2))
    mixed = mixing.mix(docs, shard_words=3000)
    result = mixing.taken_words(mixed).collect()
    assert len(result) == len(rows)
    assert Counter(map(tuple, mixing.taken_words(mixing.mix(docs.repartition(3), shard_words=3000)).collect())) == Counter(map(tuple, result))
    by_source: dict = {}
    for r in result:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        sums = by_source.setdefault(r.source, [0, 0, r.target, r.source_size])
        sums[0] += r.size
        sums[1] += r.taken
    assert abs(sum(s[2] for s in by_source.values()) - sum(s[0] for s in by_source.values())) < 1e-6
    for size, taken, target, source_size in by_source.values():
        assert size == source_size and abs(taken - target) <= max(4, 0.01 * target)
    copies = mixed.copies.collect()
    assert len({(c.key, c.key2, c.number, c.copy) for c in copies}) == len(copies) == sum(r.copies for r in result)
    shards = Counter()
    for c in copies:
        shards[c.shard] += c.size
    assert len(shards) > 3
    whole = mixing.mixed_documents(docs, shard_words=3000)
    assert whole.count() == len(copies) and whole.columns == [*docs.columns, "mix_shard", "order"]
    assert mixing.taken_words(mixing.mix(documents([]))).count() == 0


def test_splitting_tree_deals_every_block_once(spark):
    sources = [mixing.Source(None, n, 0, 1, 0, 1, 0) for n in range(3)]
    runs = mixing.quotas(spark, sources, [17, 0, 230], 7, 1).collect()
    for number, n in enumerate([17, 0, 230]):
        places = [p for r in runs if r.source_number == number for p in range(r.first, r.first + r.n)]
        assert sorted(places) == list(range(n))
    assert {sum(r.n for r in runs if r.shard == s) for s in range(7)} <= {35, 36}


def test_dual_coordinate_descent_separates():
    rows = [(np.array([0, 1]), np.array([1.0, 0.2])), (np.array([0]), np.array([0.8])), (np.array([2]), np.array([1.0])), (np.array([1, 2]), np.array([0.1, 1.0]))]
    signs = np.array([1.0, 1.0, -1.0, -1.0])
    w = linear.dual_coordinate_descent(rows, signs, np.ones(4), 3, passes=200)
    assert all(s * (w[c] @ v + w[-1]) > 0 for s, (c, v) in zip(signs, rows))


@given(st.lists(st.integers(-3, 3).map(float), max_size=14))
@settings(max_examples=200)
def test_maximal_segments(scores):
    """The best segment first, then those of what is left on its two sides: the definition of all maximal ones."""

    def define(low: int, high: int) -> set:
        best = max(((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(low, high) for b in range(a + 1, high + 1)), default=(0,))
        if best[0] <= 0:
            return set()
        _, _, _, a, b = best
        return {(a, b, sum(scores[a:b]))} | define(low, a) | define(b, high)

    found = toxicity.maximal_segments(np.array(scores))
    assert sum(s for _, _, s in found) == sum(s for _, _, s in define(0, len(scores)))
    assert max((s for _, _, s in found), default=0) == max((s for _, _, s in define(0, len(scores))), default=0)
    ends = [place for a, b, _ in sorted(found) for place in (a, b)]
    assert ends == sorted(ends)


@pytest.mark.parametrize(("name", "label", "floor"), [("op3_quality", "quality", 0.97), ("op5_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, floor):
    sf_dir = "/root/testdata/sf0.01"
    scored = queries.QUERIES[name](spark, sf_dir).toPandas()
    given_ = duckdb.sql(f"select doc_id, {label} as y from '{sf_dir}/labels.parquet'").df()
    held = scored.merge(given_, on="doc_id").query("held_out")
    assert len(scored) == 1000 and scored.score.between(0, 1).all()
    assert (held.predicted == held.y).mean() >= floor


def test_models_on_odd_rows(spark, documents):
    docs = documents(ODD, "score")
    some = documents([(n, "good words " * 3 if n % 2 else "bad!! %% words") for n in range(60)])
    labels = spark.createDataFrame([(n, n % 2, 1 - n % 2) for n in range(60)] + [(None, 1, 1), (1, None, 7), (3, 0, 0)], "doc_id long, quality int, toxic int")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        for table in (labels, labels.limit(0), labels.filter("quality = 1")):
            model = module.fit(some, table, label)
            found = module.scored(docs, model).collect()
            assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
            assert len({r.score for r in found if r.doc_id in (2, 3)}) == 1
        assert module.scored(documents([]), model).count() == 0
    assert quality.accepted(docs, quality.fit(some, labels), 0.0).columns == docs.columns


def test_few_edges_are_few_files(spark, monkeypatch):
    settings_ = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings_}
    files = []
    kept = components.stored

    def counted(df, name):
        table = kept(df, name)
        files.append(len(table.inputFiles()))
        return table

    monkeypatch.setattr(components, "stored", counted)
    try:
        for k, v in settings_.items():
            spark.conf.set(k, v)
        pairs = spark.range(1, 400).selectExpr("id AS a", "id - id % 7 AS b")
        found = {r.node: r.root for r in components.components(pairs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {n: n - n % 7 for n in range(400) if n < 399 or n % 7} and max(files[1:]) == 1


def test_quality_holds_little_and_sends_texts_once(spark, documents):
    text = " ".join(f"word{n} Other, {n}!" for n in range(50_000))[: 1 << 20]
    model = quality.Model(np.zeros(1 << quality.COLUMN_BITS), 0.0, (1.0, 0.0))
    texts = pa.array([text])
    model.scores(texts)
    tracemalloc.start()
    model.scores(texts)
    held = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    plan = quality.accepted(documents([(1, "a b")]), model)._jdf.queryExecution().executedPlan().toString()
    assert held < 60 and "ArrowEvalPython" in plan and "MapInArrow" not in plan


def test_pipeline(spark):
    docs, columns = queries.read(spark, SF, "documents"), None
    clash = docs.withColumn("key", F.lit(1)).withColumn("node", F.lit("x"))
    for given_ in (docs, clash, docs.limit(0)):
        stage_rows = given_
        for name, stage in corpus_pipeline.STAGES:
            columns = stage_rows.columns
            stage_rows = stage(spark, stage_rows, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert stage_rows.columns == columns
        assert (stage_rows.count() > 0) == (given_ is not stage_rows and not given_.isEmpty())
    assert "test-pipeline" not in columns
