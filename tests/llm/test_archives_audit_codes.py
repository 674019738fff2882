"""Web archives, the filter audit and vector codes against brute force."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import ODD, documents, shipped  # noqa: F401
from pyspark.sql import functions as F

from leadgauge.llm import filter_audit, queries, vector_codes, warc

SF = "/root/testdata/sf0.001"
PAGE = "page_id long, url string, html string"


@pytest.mark.parametrize("name", ["op4_chat", "op6_jaccard_join", "op10_topk", "op11_warc", "op12_filter_audit", "op13_vector_codes"])
def test_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels", "conversations"):
        duck.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, SF).toArrow(), duck.sql(queries.SQL[name]).to_arrow_table()
    columns = sorted(theirs.column_names)
    assert sorted(ours.column_names) == columns and ours.num_rows > 0
    assert [str(ours.schema.field(c).type) for c in columns] == [str(theirs.schema.field(c).type) for c in columns]
    rows = [Counter(zip(*(t.column(c).to_pylist() for c in columns))) for t in (ours, theirs)]
    assert rows[0] == rows[1]


LARGE = "<p>" + "word " * 300 + "</p>"
PAGES = [
    (1, "https://h.example/a", LARGE), (5, "https://h.example/b c\r\nX: y", LARGE), (3, None, LARGE), (None, "u", LARGE),
    (7, "v", None), (8, "v", ""), (9, "é", "small"), (10, "é", "small"),
    (11, "w", "x" * 999), (12, "w", "x" * 999), (13, "w", "x" * 1000), (14, "w", "x" * 1000),
    (20, "r", "same" * 300), (20, "r", "same" * 300), (2, "r", "same" * 300),
    (None, "n", "null" * 300), (None, "n", "null" * 300), (30, "long", "é𝄞" * 400_000),
]


@pytest.mark.parametrize("archive_bytes", [1, warc.ARCHIVE_BYTES])
def test_pages_come_back_from_their_archives(spark, archive_bytes):
    pages = spark.createDataFrame(PAGES, PAGE).withColumn("record_type", F.lit("clash")).withColumn("key", F.lit(1))
    last: dict = {}
    for page_id, _, html in PAGES:
        if page_id is not None:
            last[html] = max(page_id, last.get(html, page_id))
    expected = Counter()
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        again = len(data) >= 1000 and html in last and page_id != last[html]
        expected[page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last[html] if again else None] += 1
    found = warc.page_records(pages.repartition(4), archive_bytes=archive_bytes)
    assert Counter(tuple(r)[:5] for r in found.collect()) == expected
    assert warc.page_records(pages.limit(0)).count() == 0


def test_archives_hold_one_readable_member_for_each_record(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, PAGE).coalesce(1)
    archives = warc.write_archives(pages, f"file://{tmp_path}/w")
    (listed,) = archives.collect()
    data = open(listed.archive.removeprefix("file://"), "rb").read()
    assert listed.records == len(PAGES) and listed.bytes == len(data)
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == len(PAGES)
    rows = warc.read_archives(archives, with_payload=True).orderBy("place").collect()
    assert [r.problem for r in rows] == [None] * len(PAGES)
    for row, (page_id, url, html) in zip(rows, PAGES):
        assert row.page_id == (None if page_id is None else str(page_id)) and (row.uri is None) == (url is None)
        assert row.payload == (None if row.record_type == "revisit" else (html or "").encode())
    ends = [r.place for r in rows[1:]] + [len(data)]
    for row, end in zip(rows, ends):  # each place begins a member that can be read by itself
        assert gzip.decompress(data[row.place : end]).startswith(b"WARC/1.1")


def _archive(*payloads: bytes) -> list[bytes]:
    return [warc.member(warc.record("response", f"urn:{n}", p, str(n), "u", None)) for n, p in enumerate(payloads)]


def test_damaged_records_are_told_and_passed_over():
    random_bytes = random.Random(1).randbytes(300_000)
    good = _archive(b"one", random_bytes, b"three")
    plain = warc.record("response", "urn:x", b"payload", "9", "u", None)

    def read(data: bytes) -> list[tuple]:
        return [(r.get("page_id"), r.get("problem")) for r in warc.records(io.BytesIO(data))]

    assert read(b"".join(good)) == [("0", None), ("1", None), ("2", None)]
    assert read(b"") == []
    assert read(good[0] + good[1][:-20]) == [("0", None), (None, "cut off")]
    broken = bytearray(good[1])
    broken[1000:1010] = b"\x00" * 10
    found = read(good[0] + bytes(broken) + good[2])
    assert found[0] == ("0", None) and found[-1] == ("2", None) and all(p for _, p in found[1:-1]) and len(found) >= 3
    assert read(b"no gzip at all" + good[0]) == [(None, "no gzip"), ("0", None)]
    digest = plain.replace(b"payload\r\n\r\n", b"PAYLOAD\r\n\r\n")
    assert read(warc.member(digest) + good[0]) == [("9", "block differs from its digest"), ("0", None)]
    longer, shorter = plain + b"x", plain[:-8]
    assert read(warc.member(longer) + good[0]) == [(None, "longer than its length"), ("0", None)]
    assert read(warc.member(shorter) + good[0]) == [(None, "shorter than its length"), ("0", None)]
    assert read(warc.member(b"WARC/1.1\r\nContent-Length: -3\r\n\r\n") + good[0]) == [(None, "no WARC header"), ("0", None)]
    assert read(warc.member(b"") + good[0]) == [(None, "no end of the header"), ("0", None)]


def test_revisits_without_their_response_are_told(spark, tmp_path):
    spark.createDataFrame(PAGES, PAGE).createOrReplaceTempView("pages_of_test")
    archives = warc.write_archives(spark.table("pages_of_test").repartition(len(PAGES)), f"file://{tmp_path}/w", archive_bytes=1)
    found = warc.read_archives(archives)
    assert warc.resolved(found).filter("problem is not null").count() == 0
    lost = warc.resolved(found.filter("page_id is null or page_id <> '5'")).filter("problem is not null").collect()
    assert {r.page_id for r in lost} == {"1", "3", None} and {r.problem for r in lost} == {"revisits no such response"}


def _audit(rows, labels) -> dict:
    """(part, order, step) to counters, by going through the filters one after the other."""
    least: dict = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    fails = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text).split(" ") if w]
        own = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words))
        own += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
        fails.append(own + "E" * (doc_id is not None and text in least and doc_id > least[text]))
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    table, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        left = list(range(len(rows)))
        for step, letter in enumerate(order, 1):
            gone = [n for n in left if letter in fails[n]]
            left = [n for n in left if letter not in fails[n]]
            for part in {r[2] or "" for r in rows}:
                of = {n for n, r in enumerate(rows) if (r[2] or "") == part}
                failing = {n for n in of if letter in fails[n]}
                here = of & set(gone)
                shapley[part, letter] += len(here)
                counts = [len(of & set(left)), len(here), len(failing - here - set(left)), sum(fails[n] == letter for n in of)]
                counts += [sum(rows[n][0] in good for n in here), sum(rows[n][0] in toxic for n in here)]
                table[part, order, step] = counts
    return {key: (*counts, shapley[key[0], key[1][key[2] - 1]]) for key, counts in table.items()}


def test_filter_audit(spark, documents):
    generator = random.Random(3)
    words = [f"w{n}" for n in range(200)] + ["UP", "A#", "é", "B"]
    rows = [(n, " ".join(generator.choices(words[: generator.choice([20, 204])], k=generator.choice([10, 49, 50, 120]))), generator.choice(["a", "b", None, ""])) for n in range(60)]
    rows += [(100 + n, rows[n % 7][1], "a") for n in range(30)] + [(*r[:2], r[2] if len(r) > 2 else "s") for r in ODD]
    labels = [(n, n % 2, n % 3) for n in range(0, 140, 2)] + [(5, 0, None), (5, 1, 1), (None, 1, 1), (7, None, 1), (1, 1, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    found = filter_audit.filter_audit(documents(rows, "mask"), table).collect()
    got = {tuple(r)[:3]: tuple(r)[3:] for r in found}
    assert len(got) == len(found) and got == _audit(rows, labels)
    assert filter_audit.filter_audit(documents([]), table).count() == 0
    assert filter_audit.filter_audit(documents(rows), table.limit(0)).agg(F.sum("good_lost")).collect()[0][0] == 0


def test_packed_fields_do_not_overflow():
    many = (1 << 61) + 3
    total = sum(many * filter_audit.packed_outcomes(code) for code in (0b00001, 0b11111))
    fields = filter_audit.unpacked(total)
    assert set(fields.ravel().tolist()) == {0, many, 2 * many}


@given(st.lists(st.integers(0, 127), max_size=40))
@settings(max_examples=30, deadline=None)
def test_sums_of_outcomes_are_sums_of_counters(codes):
    total = filter_audit.unpacked(sum(map(filter_audit.packed_outcomes, codes)))
    single = sum((filter_audit.unpacked(filter_audit.packed_outcomes(c)) for c in codes), np.zeros_like(total))
    assert (total == single).all()


@given(st.integers(1, 60), st.integers(0, 6), st.sampled_from([1, 3, 50, 1 << 20, 1 << 27]), st.integers(0, 1 << 30))
@settings(max_examples=120, deadline=None)
def test_access_tree_finds_the_nearest_entry_of_lowest_index(n, width, spread, seed):
    generator = np.random.default_rng(seed)
    entries = generator.integers(-spread, spread + 1, (n, width))
    queries_ = np.concatenate([generator.integers(-spread, spread + 1, (30, width)), entries[: min(n, 10)]])
    at, best = vector_codes.AccessTree(entries, arity=3, leaf=2).nearest(queries_)
    for query, i, distance in zip(queries_.tolist(), at.tolist(), best.tolist()):
        assert (distance, i) == min((sum((a - b) ** 2 for a, b in zip(query, e)), k) for k, e in enumerate(entries.tolist()))


def test_access_tree_leaves_subtrees_out():
    generator = np.random.default_rng(2)
    entries = (generator.integers(0, 6, (256, 1)) * 100_000 + generator.integers(0, 50, (256, 4))).astype(np.int64)
    tree, looked = vector_codes.AccessTree(entries), []
    plain = vector_codes.AccessTree._visit

    def counted(self, node, asked, which, at, best):
        looked.append(len(which) * len(node.points))
        plain(self, node, asked, which, at, best)

    vector_codes.AccessTree._visit = counted
    try:
        tree.nearest(entries[:100])
    finally:
        vector_codes.AccessTree._visit = plain
    assert sum(looked) < 0.5 * 100 * 256


def _codes(rows, entries=256, rounds=4):
    """Brute force in unbounded integers."""
    kept = [(i, [int(np.floor(x * 1024)) if abs(x) < 1e300 else int(x) * 1024 for x in map(float, v)], label) for i, v, label in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    found = []
    for length in {len(v) for _, v, _ in kept}:
        own = sorted((r for r in kept if len(r[1]) == length), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        width = -(-length // 4)
        cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(4)] for _, v, _ in own]
        books = [[c[p] for c in cut[:entries]] for p in range(4)]

        def nearest(p, part):
            return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

        for _ in range(rounds):
            held = [defaultdict(list) for _ in range(4)]
            for c in cut:
                for p in range(4):
                    held[p][nearest(p, c[p])[1]].append(c[p])
            for p in range(4):
                for k, parts in held[p].items():
                    books[p][k] = tuple(sum(x) // len(parts) for x in zip(*parts))
        text = ",".join(str(x) for book in books for e in book for x in e)
        for (i, _, label), c in zip(own, cut):
            best = [nearest(p, c[p]) for p in range(4)]
            error = min(sum(d for d, _ in best), vector_codes.MOST)
            found.append((i, "".join(f"{k:02x}" for _, k in best), error, label, hashlib.sha256(text.encode()).hexdigest()))
    total = Counter()
    for _, _, error, label, _ in found:
        total[label] += error
    return Counter((i, code, e, min(total[label], vector_codes.MOST), digest) for i, code, e, label, digest in found)


def test_vector_codes(spark):
    generator = np.random.default_rng(4)
    rows = [(n, generator.normal(size=8).round(2).tolist(), int(n % 3) if n % 5 else None) for n in range(90)]
    rows += [(n, rows[n % 4][1], 1) for n in range(90, 130)] + [(3, rows[8][1], 2), (3, rows[9][1], 2), (None, rows[1][1], None)]
    rows += [(200 + n, generator.normal(size=5).tolist(), 9) for n in range(9)] + [(300, [], 9), (301, [1e30] * 3, 7), (302, [1.0, -2e30, 0.5], 8)]
    bad = [(400, None, 1), (401, [1.0, None] * 4, 1), (402, [float("nan")] * 8, 1), (403, [float("-inf")] * 8, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit(1))
    found = vector_codes.vector_codes(df.repartition(5), entries=16).drop("label")
    assert Counter(map(tuple, found.collect())) == _codes(rows, entries=16)
    assert vector_codes.vector_codes(df.filter("vec_id >= 400")).count() == 0
    blocks = list(vector_codes._blocks([1, 2, 5000, 9000], 256))
    assert [n for b in blocks for n in b] == [1, 2, 5000, 9000] and len(blocks) == 2
