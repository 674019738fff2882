"""Row operators against brute force: token counts, secrets, decontamination, chat."""

from __future__ import annotations

import hashlib
import json
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import ODD, documents, shipped  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leadgauge.llm import chat, decontaminate, secret_scan, token_count

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@given(st.text(max_size=60) | st.text("ab'slt <|endoftx>", max_size=40))
@settings(max_examples=200, deadline=None)
def test_token_counts_are_the_librarys(text):
    assert token_count.load(PATH).count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("shape", ["{}", "a{}b", "1{}{}!"])
def test_token_counts_of_every_code_point(shape):
    tokenizer = token_count.load(PATH)
    texts = [shape.format(chr(c), chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(texts), 100_000):
        part = texts[start : start + 100_000]
        found = [len(e.ids) for e in LIBRARY.encode_batch(part, add_special_tokens=False)]
        assert [t for t, n in zip(part, found) if tokenizer.count(t) != n] == []


def test_token_counts_of_odd_rows(documents):
    rows = token_count.token_counts(documents(ODD, "n_tokens"), PATH, limit=3).collect()
    expected = Counter(
        (i[0], len((i[1] or "").encode()), n := len(LIBRARY.encode(i[1] or "", add_special_tokens=False).ids), n > 3) for i in ODD
    )
    assert Counter(map(tuple, rows)) == expected
    assert token_count.token_counts(documents([]), PATH).count() == 0


SECRETS = [
    (1, "password: hunter22 and token='abc' PassWord=abcdef AKIA" + "A1" * 9 + " 🎉 secret=token:abcdefg"),
    (2, "deadbeef" * 5 + " api_key : \"Zx9+/=_-.\" AKIA1 AKIAAKIA" + "Q" * 20),
    (3, "key " + "".join(random.Random(4).choices("0123456789abcdefABCDEFGHIJKLMNOPQRSTUVWXYZ", k=48))),
]


def _base(text: str) -> list[tuple]:
    assign = "((?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign += r""")["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(assign, text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_base_spans(documents):
    rows = SECRETS + ODD
    found = secret_scan.secret_spans(documents(rows, "spans")).select(
        "row.doc_id", "row.text", F.sha2(secret_scan.listed(F.col("base")), 256), secret_scan.redacted(F.col("text"), F.col("base"))
    )
    for _, text, digest, redacted in found.collect():
        spans = _base(text or "")
        assert digest == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()
        at, expected = 0, ""
        for a, _, b, _ in spans:
            if a >= at:
                expected += (text or "")[at:a] + "[SECRET]"
            at = max(at, b)
        assert redacted == expected + (text or "")[at:]
    assert secret_scan.secret_spans(documents([])).count() == 0


def test_many_matches_keep_their_places(documents):
    text = " ".join(f"token={n:06d}" for n in range(1500))
    (row,) = secret_scan.secret_spans(documents([(1, text)])).select("base").collect()
    assert [(s.start, s.end) for s in row.base] == [(m.start(), m.end()) for m in re.finditer("token=[0-9]+", text)]


def test_random_tokens_are_told_from_structured_ones(documents):
    generator = random.Random(0)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(generator.choices(alphabet, k=40)) for _ in range(300)]
    keys = [k for k in keys if re.search("[0-9]", k)]
    plain = ["section1ofthedocumentaboutthethingsthatare" + str(n % 10) for n in range(100)] + ["a1" * 20] * 50
    rows = [(n, f"see {t} now") for n, t in enumerate(keys + plain)]
    found = secret_scan.secret_spans(documents(rows)).filter("size(spans) > size(base)").select("row.doc_id").collect()
    flagged = {row[0] for row in found}
    assert len(flagged & set(range(len(keys)))) > 0.9 * len(keys)
    assert len(flagged - set(range(len(keys)))) <= 0.1 * len(flagged)


def test_random_tokens_after_names_and_in_mixed_runs(documents):
    generator = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    shapes = ["AWS_ACCESS_VALUE={}", "see https://h.example/a?sig={}&v=1", "Server=db;Pwd={};", "get /files/my-data/{} now", "v={}=="]
    rows, keys = [], []
    for n in range(300):
        keys.append("".join(generator.choices(alphabet, k=39)) + "7")
        rows.append((n, shapes[n % len(shapes)].format(keys[-1])))
    found = secret_scan.secret_spans(documents(rows)).select("row.doc_id", "row.text", "spans").collect()
    by_shape = Counter(r.doc_id % len(shapes) for r in found if any(keys[r.doc_id] in r.text[s.start : s.end] for s in r.spans))
    assert all(by_shape[shape] > 0.8 * 60 for shape in range(len(shapes)))
    assert not any(r.text[s.start : s.end].startswith(("AWS", "sig", "Pwd")) for r in found for s in r.spans if s.kind == "random")


@pytest.fixture
def benchmark(spark):
    generator = random.Random(1)
    words = ["".join(generator.choices("etaoinshrdlu", k=generator.randint(2, 9))) for _ in range(400)]
    items = [(n, " ".join(generator.choices(words, k=size))) for n, size in enumerate([20, 45, 80, 12])]
    items += [(4, None), (5, ""), (6, "short"), (None, " ".join(generator.choices(words, k=30)))]
    return items, spark.createDataFrame(items, "item_id long, text string"), words


def test_leaks_exact_edited_and_partial(documents, benchmark):
    items, table, words = benchmark
    generator = random.Random(2)
    filler = lambda n: " ".join(generator.choices(words, k=n))

    def edited(text: str, edits: int) -> str:
        letters = list(text)
        for at in generator.sample(range(len(letters)), edits):
            letters[at] = "#"
        return "".join(letters)

    rows = [(100 + n, f"{filler(30)} {text} {filler(20)}") for n, (_, text) in enumerate(items) if text and len(text) > 10]
    rows += [(200, f"{filler(9)} {edited(items[1][1], 8)}"), (201, items[2][1].upper()), (202, items[2][1][:260])]
    rows += [(300 + n, filler(200)) for n in range(20)]
    for index_bytes in (1 << 24, 300):
        found = decontaminate.leaks(documents(rows + ODD, "item_id"), table, index_bytes=index_bytes).collect()
        got = {(r.doc_id, r.item_id) for r in found}
        assert got == {(100, 0), (101, 1), (102, 2), (103, 3), (107, None), (200, 1), (201, 2), (202, 2)}
        (exact,) = [r for r in found if r.doc_id == 101]
        assert dict((r[0], r[1]) for r in rows)[101][exact.start : exact.end] == items[1][1] and exact.edits == 0
        kept = decontaminate.decontaminated(documents(rows + ODD, "__t"), table, index_bytes)
        assert kept.count() == 20 + len(ODD) and kept.columns == documents([], "__t").columns
    assert decontaminate.leaks(documents(ODD), table.limit(0)).count() == 0
    assert decontaminate.decontaminated(documents([]), table).count() == 0


@pytest.mark.parametrize("size", [81, 113, 150, 184, 233, 394])
def test_halves_of_items_and_changed_words_leak(size):
    import numpy as np

    generator = random.Random(size)
    words = ["".join(generator.choices("etaoinshrdlu", k=generator.randint(2, 9))) for _ in range(400)]
    item = " ".join(generator.choices(words, k=100))[:size]
    index = decontaminate.Index.of([(1, item)])

    def found(text: str) -> bool:
        data = np.frombuffer(text.encode(), np.uint8)
        return bool(list(index.leaks(data, np.array([0, len(data)]))))

    half = (size + 1) // 2
    assert all(found("#" * 50 + item[at : at + half] + "#" * 50) for at in range(size - half + 1))
    changed = item.split(" ")
    for at in range(9, len(changed), 10):
        changed[at] = "#" * len(changed[at])
    assert found(" ".join(changed))
    assert not found(" ".join(generator.choices(words, k=300)))


def _index(items: list[str]):
    return decontaminate.Index.of(list(enumerate(items)))


def _places(index, texts: list[str]) -> list[tuple]:
    import numpy as np

    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(t) for t in raw])
    return list(index.leaks(decontaminate.LOWER[np.frombuffer(b"".join(raw), np.uint8)], offsets))


def _least_edits(window: str, text: str) -> int:
    """The fewest edits between a window and any stretch of a text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(window, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


@pytest.mark.parametrize("seed", range(12))
def test_search_finds_every_window_within_its_edits(seed):
    """Brute force: the least edits of each window over all stretches of each text."""
    generator = random.Random(seed)
    letters = "abcde" if seed % 2 else "abcdefghijklmnopqrstuvwxyz"
    items = ["".join(generator.choices(letters, k=n)) for n in (8, 15, 25, 40, 90, 200)]
    texts = ["".join(generator.choices(letters, k=n)) for n in (0, 5, 300)]
    for item in items:
        for edits in range(0, 10, 2):
            start = generator.randrange(max(1, len(item) - 64))
            piece = list(item[start : start + generator.randint(30, 80)])
            for _ in range(edits):
                at = generator.randrange(len(piece))
                piece[at : at + generator.randint(0, 1)] = generator.choices(letters, k=generator.randint(0, 2))
            texts.append("".join(generator.choices(letters, k=40)) + "".join(piece) + "".join(generator.choices(letters, k=30)))
    expected = set()
    for t, text in enumerate(texts):
        for i, item in enumerate(items):
            if any(_least_edits(item[a : a + w], text) <= decontaminate.edit_budget(w) for a, w in decontaminate.windows(len(item))):
                expected.add((t, i))
    assert {(t, i) for t, i, *_ in _places(_index(items), texts)} == expected


def test_every_place_and_items_too_short_for_windows():
    item = "".join(random.Random(8).choices("abcdefghij", k=60))
    texts = [item + "#" * 200 + item, "xyz and XYZ" + "-" * 60 + "xyz", "", "xy", "z", "aaaa"]
    found = _places(_index([item, "xyz", "yz", "a"]), texts)
    assert [f for f in found if f[1] == 0] == [(0, 0, 0, 60, 0), (0, 0, 260, 320, 0)]
    assert [f for f in found if f[1] == 1] == [(1, 1, 0, 11, 0), (1, 1, 71, 74, 0)]
    assert [f for f in found if f[1] == 2] == [(1, 2, 1, 11, 0), (1, 2, 72, 74, 0)]
    assert (5, 3, 0, 4, 0) in found


def test_columns_of_any_name_pass_the_row_stages(spark, documents, benchmark):
    import corpus_pipeline
    from leadgauge.llm import mixing, quality

    odd = {"__text": "a", "a`b": "b", "row": "c", "a.b": "d", "shard": "e", "mix_shard": "f", "spans": "g"}
    docs = documents([(n, f"some words {n} here") for n in range(5)] + ODD)
    for name, value in odd.items():
        docs = docs.withColumn(name, F.lit(value))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    clean = quality.accepted(docs, quality.fit(docs, labels), 0.0)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert decontaminate.decontaminated(docs, benchmark[1]).select("`a.b`", "__text").distinct().collect() == [("d", "a")]
    safe = corpus_pipeline.without_secrets(spark, docs, "")
    assert safe.columns == docs.columns and safe.select("`a``b`").distinct().collect() == [("b",)]
    mixed = mixing.mixed_documents(docs)
    assert len(set(mixed.columns)) == len(docs.columns) + 2 and mixed.select("`a``b`").distinct().collect() == [("b",)]


@given(st.text("ab", min_size=8, max_size=30), st.text("ab", max_size=40), st.integers(-3, 12))
@settings(max_examples=150, deadline=None)
def test_banded_alignment_is_the_edit_distance_inside_the_band(window, text, low):
    import numpy as np

    width, most = 6, 3
    found = decontaminate.aligned(np.frombuffer(window.encode(), np.uint8), np.frombuffer(text.encode(), np.uint8), low, width, most)
    if found is not None:
        start, end, edits = found
        rows = list(range(end - start + 1))
        for i, a in enumerate(window, 1):
            last, rows[0] = rows[0], i
            for j, b in enumerate(text[start:end], 1):
                last, rows[j] = rows[j], min(last + (a != b), rows[j] + 1, rows[j - 1] + 1)
        assert rows[-1] <= edits <= most
    elif any(text[d : d + len(window)] == window for d in range(max(low, 0), low + width)):
        raise AssertionError("an exact stretch in the band was missed")


SCHEMA = {"type": "object", "properties": {"n": {"type": "integer", "minimum": 0}}, "required": ["n"], "additionalProperties": False}


def _calls(*calls) -> str:
    return json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments", "after"), c)) for c in calls]})


def test_tool_calls(spark):
    rows = [
        (1, 0, "assistant", _calls(("b", "f", {"n": 1}, ["a"]), ("a", "f", {"n": 2}, []), ("c", "f", {"n": -1}, []))),
        (1, 1, "tool", '{"tool_call_id": "a", "content": {"z": 1, "é": [true, null]}}'),
        (1, 2, "tool", '{"tool_call_id": "b", "content": "x\\"y"}'),
        (1, 3, "assistant", _calls(("a", "f", {"n": 3}, ["zzz"]), ("d", "g", {}, []), ("e", "f", {"n": True}, []))),
        (1, 4, "assistant", _calls(("p", "f", {"n": 1}, ["q"]), ("q", "f", {"n": 1}, ["p"]), (None, "f", {"n": 1}, []))),
        (None, 0, "assistant", _calls(("a", "f", {"n": 1}, []))),
        (None, 1, "tool", '{"tool_call_id": "a", "content": 1}'),
        (2, 0, "user", None),
        (2, 1, "tool", "not json {"),
        (2, 2, None, "[" * 50_000),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.linked_calls(messages.withColumn("call", F.lit(1)), {"f": SCHEMA}).collect()
    got = {(r.conv_id, r.turn, r.place): (r.call_id, r.status, r.result_turn) for r in found}
    assert got == {
        (1, 0, 0): ("a", "ok", 1), (1, 0, 1): ("b", "ok", 2), (1, 0, 2): ("c", "invalid", None),
        (1, 3, 0): ("a", "dangling", None), (1, 3, 1): ("d", "unknown", None), (1, 3, 2): ("e", "invalid", None),
        (1, 4, 0): (None, "unanswered", None), (1, 4, 1): ("p", "cycle", None), (1, 4, 2): ("q", "cycle", None),
        (None, 0, 0): ("a", "ok", 1),
    }
    for r in found:
        value = json.loads(r.call)
        assert r.call == chat.canonical(value) and value["status"] == r.status
    first = next(json.loads(r.call) for r in found if (r.conv_id, r.turn, r.place) == (1, 0, 0))
    assert first["result"] == {"z": 1, "é": [True, None]} and first["arguments"] == {"n": 2}
    assert chat.linked_calls(messages.limit(0), {"f": SCHEMA}).count() == 0


def test_messages_that_cannot_be_written_again_have_no_calls(spark):
    bad = ['{"n": NaN}', '{"n": 1e400}', '{"n": -Infinity}', '{"n": "\\ud800"}', "[" * 200_000 + "]" * 200_000]
    rows = [(1, n, "assistant", '{"tool_calls": [{"id": "a", "name": "f", "arguments": ' + b + "}]}") for n, b in enumerate(bad)]
    rows += [(2, n, "assistant", f'{{"tool_calls": [{{"id": {b}, "name": "f"}}]}}') for n, b in enumerate(['"\\udc00"', "NaN", "1e999"])]
    rows += [(3, n, "tool", f'{{"tool_call_id": "a", "content": {b}}}') for n, b in enumerate(bad)]
    rows += [(4, 0, "assistant", '{"tool_calls": [{"id": "\\ud83d\\ude00", "name": "f", "arguments": {"n": 1.5}}]}')]
    rows += [(4, 1, "tool", '{"tool_call_id": "\\ud83d\\ude00", "content": "\\u00e9"}')]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    schema = {"type": "object", "properties": {"n": {"type": ["number", "null"]}}}
    (found,) = chat.linked_calls(messages, {"f": schema}).collect()
    assert (found.conv_id, found.call_id, found.status, found.result_turn) == (4, "\U0001f600", "ok", 1)
    assert json.loads(found.call)["result"] == "é"
    assert chat.fits(None, {"type": ["integer", "null"]}) and not chat.fits(True, {"type": ["integer", "null"]})


@given(st.lists(st.lists(st.integers(0, 7), max_size=3), max_size=8))
@settings(deadline=None)
def test_topological_order(needs):
    names = [str(n) for n in range(len(needs))]
    order, stuck = chat.topological(names, [[str(x) for x in own] for own in needs])
    assert sorted(order) == list(range(len(needs)))
    place = {i: p for p, i in enumerate(order)}
    for i, own in enumerate(needs):
        if i not in stuck:
            assert all(place[x] < place[i] for x in own if x < len(needs))
