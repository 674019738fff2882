"""Shortened word and rule lists decide like the full ones; word patterns find what a plain search finds."""

from __future__ import annotations

import re
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadgauge.config import Rule, ScorecardConfig, live_rules, minimal_words
from leadgauge.functions.text import any_word_pattern, first_rule, has_word

words = st.lists(st.text("abc.", min_size=1, max_size=4), min_size=1, max_size=12)
texts = st.text("abc.X", max_size=12)
patterns = st.text("ab_%", max_size=4).map(lambda t: f"%{t}%")
rules = st.lists(st.builds(Rule, st.sampled_from(["url", "referrer"]), patterns, st.sampled_from("PQR")), max_size=8)


def like(text: str, pattern: str) -> bool:
    wild = {"%": ".*", "_": "."}
    return re.fullmatch("".join(wild.get(c, re.escape(c)) for c in pattern), text, re.DOTALL) is not None


def decide(rule_list, row):
    return next((r.label for r in rule_list if like(row[r.column], r.pattern)), None)


@given(words, texts)
def test_minimal_words_find_the_same(all_words, text):
    assert any(w in text for w in all_words) == any(w in text for w in minimal_words(all_words))


@given(words, texts)
def test_pattern_finds_any_word(all_words, text):
    assert bool(re.search(any_word_pattern(all_words), text)) == any(w in text for w in all_words)


@given(rules, texts, texts)
@settings(max_examples=300)
def test_live_rules_decide_the_same(all_rules, url, referrer):
    row = {"url": url, "referrer": referrer}
    assert decide(live_rules(all_rules), row) == decide(all_rules, row)


def test_default_lists_are_whole():
    config = ScorecardConfig(own_site="site.example", own_hosts=("demo.example", "chat.example"))
    assert len(config.all_personal_domains()) == len(set(config.all_personal_domains())) == 102
    assert (len(config.name_nouns), len(config.first_touch_rules())) == (185, 166 + len(config.url_rules))
    assert "flowers" not in minimal_words(config.name_nouns) and "flowers" in config.name_nouns


def test_a_rule_that_is_taken_out_brings_back_the_one_it_shadowed():
    mail = Rule("referrer", "%mail.google.com%", "EMAIL")
    config = ScorecardConfig()
    assert mail in config.first_touch_rules() and mail not in live_rules(config.first_touch_rules())
    without = tuple(rule for rule in config.referrer_rules if rule.pattern != "%google.%")
    assert mail in live_rules(replace(config, referrer_rules=without).first_touch_rules())


def test_own_site_names_its_rules():
    rules = ScorecardConfig(own_site="site.example").first_touch_rules()
    assert Rule("referrer", "%growth.site%", "PAID MARKETING") in rules
    assert Rule("referrer", "%https://site.example%", "OWN SITE") in rules
    assert not any("{" in rule.pattern for rule in rules)


@pytest.mark.parametrize("name", ["tutorials_over", "docs_over", "connection_limit_over", "message_limit_over"])
def test_negative_thresholds_are_refused(name):
    with pytest.raises(ValueError, match=name):
        ScorecardConfig(**{name: -1})


@pytest.mark.parametrize("bad", [[], ["a", ""]])
def test_empty_words_are_refused(bad):
    with pytest.raises(ValueError, match="must not be empty"):
        any_word_pattern(bad)


def test_spark_runs_pattern_and_rules(spark):
    df = spark.createDataFrame([("xa.bx",), ("aXb",), ("it's",), ("a\\b",), (None,)], "url string")
    found = df.select(has_word(F.col("url"), ["a.b", "'s"])).collect()
    assert [row[0] for row in found] == [True, False, True, False, None]
    rule_list = [Rule("url", "%'s%", "quote"), Rule("url", "%a_b%", "wild"), Rule("url", "x%", "x")]
    labels = df.select(first_rule(rule_list, str)).collect()
    assert [row[0] for row in labels] == ["wild", "wild", "quote", "wild", None]


def test_long_vocabulary_in_spark(spark):
    vocabulary = ["".join(chr(97 + (n * k + k * k) % 26) for k in range(2, 7)) for n in range(400)]
    texts = [f"x{word}y" for word in vocabulary[::7]] + [word[:-1] for word in vocabulary[::5]] + ["", "zzz"]
    df = spark.createDataFrame([(text,) for text in texts], "url string")
    found = [row[0] for row in df.select(has_word(F.col("url"), vocabulary)).collect()]
    assert found == [any(word in text for word in vocabulary) for text in texts]
    assert True in found and False in found
