"""Counts of terms by key, against plain Python, and what they move."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from facet.operators import search
from facet.operators.search import Analyzer
from facet.plans import catalogue

TEXTS = ["a b a  a", "", None, "aba\0ba\0b", "été 😀😀 été 😀", "x", "the cats, the cat. The", "多い 文字 多い", "ab" * 50, "tail a b"]
WIDE = "".join(chr(0x4E00 + 7 * i % 2000) for i in range(2500))
ANALYZERS = [
    Analyzer(), Analyzer(("whitespace",), ()), Analyzer(("pattern", "[,.]"), (("lowercase",), ("length", 3, 40))), Analyzer(("keyword",), ()), Analyzer(("ngram", 2, 3), ()), Analyzer(("ngram", 1, 7), (("lowercase",),)),
    Analyzer(("ngram", 2, 3), (("length", 3, 3),)), Analyzer(("standard",), (("lowercase",), ("stopwords", "english"), ("stemmer", "english"))),
]
KEYS = {"different": list(range(11)), "repeated": [1, 2, None, 1, None, 3, 4, 1, 5, None, 6], "strings": [f"k{i % 9}" for i in range(11)]}


def counts(df, key="k"):
    rows = [(r[key], r["term"], r["n"]) for r in df.collect()]
    out = {(k, t): n for k, t, n in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("keys", KEYS)
@pytest.mark.parametrize("a", ANALYZERS, ids=lambda a: "-".join(map(str, a.tokenizer)) + f"-{len(a.filters)}")
@pytest.mark.parametrize("at_once", [1, 1 << 18])
def test_counts(spark, monkeypatch, a, keys, at_once):
    monkeypatch.setattr(search, "AT_ONCE", at_once)
    rows = list(zip(KEYS[keys], [*TEXTS, WIDE]))
    want = Counter()
    for k, t in rows:
        for w in a.of(t or ""):
            want[k, w] += 1
    kind = "string" if keys == "strings" else "long"
    got = counts(search.term_counts(spark.createDataFrame(rows, f"k {kind}, body string").coalesce(2), "k", "body", a))
    assert got == dict(want)


def test_many_repeated_keys_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(search, "ONE_TASK", 0)
    df = spark.createDataFrame([(1, "a b"), (1, "b c"), (2, "a"), (None, "z"), (None, "z")], "k long, body string")
    assert counts(search.term_counts(df, "k", "body")) == {(1, "a"): 1, (1, "b"): 2, (1, "c"): 1, (2, "a"): 1, (None, "z"): 2}


@pytest.mark.parametrize("name", ["tokenizer_standard", "tokenizer_whitespace", "tokenizer_pattern", "tokenizer_ngram"])
def test_terms_of_different_documents_are_not_shuffled(spark, name):
    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_n_grams_are_cut_from_the_text_itself(spark):
    df = spark.createDataFrame([(1, "abc")], "k long, body string")
    plan = search.term_counts(df, "k", "body", Analyzer(("ngram", 2, 3), ()))._jdf.queryExecution().executedPlan().toString()
    assert "transform" not in plan
    assert df.select(F.size(Analyzer(("ngram", 2, 3), ()).terms(F.col("body")))).first()[0] == 3
