"""Registered searches read the tables in one pass: nothing but what is found is written or moved."""

import os
import re

import pytest
from pyspark.sql import functions as F

from olai.functions import letters as L
from olai.plans import registry
from olai.sources import vocabulary

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


def scan(spark, monkeypatch, name):
    """The plan of a query that has found something, and has written nothing and joined nothing for it."""
    monkeypatch.setattr(vocabulary, "_BUILT", {})
    folder = spark.conf.get("spark.checkpoint.dir")
    kept = set(os.listdir(folder))
    df = registry.QUERIES[name](spark, SF)
    assert df.collect() and set(os.listdir(folder)) == kept
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    return plan


@tables
@pytest.mark.parametrize("name", ["search_repeat", "search_transliterated", "search_spelling", "classify_precedence", "search_alternative", "search_joint"])
def test_search_writes_no_index(spark, monkeypatch, name):
    scan(spark, monkeypatch, name)


@tables
def test_highlights_look_for_the_hits_of_a_segment_once(spark, monkeypatch):
    monkeypatch.setattr(vocabulary, "_BUILT", {})
    kept = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    df = registry.QUERIES["highlight_hits"](spark, SF)
    assert df.collect() and set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) == kept
    assert "array_contains(filter" not in df._jdf.queryExecution().analyzed().toString()


def test_tokens_of_odd_texts(spark):
    every = "".join(chr(k) for k in range(1, 128))
    texts = ["", " ", "a", "..a  B\tc\x00d\x7fe'f", every, every * 2, "né é x y Ünï’s", "12 3", None]
    got = [r.t for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(L.tokens(F.col("t")).alias("t")).collect()]
    to = str.maketrans(L.LATIN, L.LATIN_CODES)
    cut = lambda t: [w for w in (re.sub("[^a-zA-Z]", "", x).lower().translate(to) for x in re.findall("[A-Za-z\u0080-\U0010ffff]+", t)) if w]
    assert got == [None if t is None else cut(t) for t in texts]
