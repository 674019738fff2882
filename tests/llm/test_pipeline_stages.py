"""Each stage of the pipeline against a plain computation on the documents of the smallest folder."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from odd_rows import shipped  # noqa: F401
from test_groups import _brute_components
from test_rows import _base

import corpus_pipeline
from leadgauge.llm import decontaminate, mixing, quality, queries

SF, WITH_SECRETS = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before and after each stage, as rows."""
    docs, tables = queries.read(spark, SF, "documents"), []
    tables.append(docs.collect())
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(tables[-1], docs.schema)
        out = stage(spark, docs, SF)
        tables.append(out.collect())
        docs = out
    return tables


def _least_edits(window: bytes, text: bytes, most: int) -> bool:
    """Whether some stretch of the text is within `most` edits of the window: bit-parallel over the window's bytes."""
    places: dict[int, int] = {}
    for i, b in enumerate(window):
        places[b] = places.get(b, 0) | 1 << i
    full, top, score = (1 << len(window)) - 1, 1 << len(window) - 1, len(window)
    up, down = full, 0
    for b in text:
        equal = places.get(b, 0)
        across = (((equal & up) + up) ^ up) | equal | down
        more, less = down | ~(across | up) & full, up & across
        score += bool(more & top) - bool(less & top)
        more, less = more << 1 & full, less << 1 & full
        up, down = less | ~(equal | down | more) & full, more & (equal | down)
        if score <= most:
            return True
    return False


def test_quality_keeps_what_the_classifier_accepts(spark, stages):
    docs = queries.read(spark, SF, "documents")
    scored = quality.scored(docs, quality.fit(docs, queries.read(spark, SF, "labels"))).collect()
    accepted = {r.doc_id for r in scored if r.score >= 0.7}
    assert [r for r in stages[0] if r.doc_id in accepted] == sorted(stages[1], key=lambda r: r.doc_id) and 0 < len(accepted) < len(scored)


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1]]
    expected = {i if not n else c for i, n, c in _brute_components(rows, 5, 80)[0]}
    assert {r.doc_id for r in stages[2]} == expected and len(stages[2]) == len(expected) < len(rows)
    assert set(stages[2]) <= set(stages[1])


def test_documents_with_benchmark_passages_go(spark, stages):
    items = [r.text.encode().lower() for r in queries.read(spark, SF, "benchmark").collect()]
    windows = [(item[a : a + w], decontaminate.edit_budget(w)) for item in items for a, w in decontaminate.windows(len(item))]
    kept = {r.doc_id for r in stages[3]}
    gone = [r for r in stages[2] if r.doc_id not in kept]
    short = sorted((r for r in stages[3] if r.text), key=lambda r: len(r.text))[:20]
    holds = lambda r: any(_least_edits(w, r.text.encode().lower(), k) for w, k in windows)
    assert gone and all(holds(r) for r in gone) and not any(holds(r) for r in short)
    whole = [w for w, _ in windows]
    assert not any(w in (r.text or "").encode().lower() for r in stages[3] for w in whole)
    assert set(stages[3]) <= set(stages[2])


def test_secrets_are_replaced_and_nothing_else(spark, stages):
    assert {r.doc_id for r in stages[4]} == {r.doc_id for r in stages[3]}
    docs = queries.read(spark, WITH_SECRETS, "documents")  # the smallest folder has none
    before, after = docs.collect(), {r.doc_id: r for r in corpus_pipeline.without_secrets(spark, docs, SF).collect()}
    assert set(after) == {r.doc_id for r in before}
    found = 0
    for r in before:
        clean = after[r.doc_id]
        pieces = (clean.text or "").split("[SECRET]")
        assert re.fullmatch(".+".join(map(re.escape, pieces)), r.text or "", re.DOTALL) and clean.n_chars == len(clean.text or "")
        found += len(pieces) > 1
        at, kept = 0, ""
        for a, _, b, _ in _base(r.text or ""):
            kept, at = kept + (r.text[at:a] if a >= at else ""), max(at, b)
        assert not _base(clean.text or "") and (len(pieces) > 1) >= bool(_base(r.text or ""))
        assert (clean.lang, clean.source) == (r.lang, r.source)
    assert found


def test_mixing_takes_whole_documents_as_often_as_told(spark, stages):
    docs = spark.createDataFrame(stages[4])
    told = {r.doc_id: r.copies for r in mixing.taken_words(mixing.mix(docs)).collect()}
    taken = Counter(r.doc_id for r in stages[5])
    assert {i: n for i, n in told.items() if n} == dict(taken)
    assert {tuple(r)[: len(docs.columns)] for r in stages[5]} <= set(map(tuple, stages[4]))
