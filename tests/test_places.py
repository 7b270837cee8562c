"""Where words stand: brackets leave the JVM as outlines, and a hit is judged for its own place only."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from olai.functions import letters as L
from olai.plans import registry, script_queries
from olai.sources import lexicon

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


def by_hand(text):
    """Whether each word is in parentheses, read off character by character."""
    depth, outside, opener, out = 0, False, None, []
    for part in re.findall("[A-Za-z\u0080-\U0010ffff]+|[(){}\\[\\]]", text):
        if part in "([{":
            depth += 1
            opener = part if depth == 1 else opener
        elif part in ")]}":
            depth = max(0, depth - 1)
        elif re.search("[A-Za-zஂ-ௗ]", part):
            outside = outside or depth == 0
            out.append(depth > 0 and not (not outside and depth == 1 and opener == "("))
    return out


def test_outlines_and_parentheses_of_random_texts(spark):
    draw = random.Random(4)
    pieces = ["ab", "w", "é", "né", "கடல்", " ", "1", "(", ")", "[", "]", "{", "}", "\n"]
    texts = ["".join(draw.choices(pieces, k=draw.randrange(1, 30))) for _ in range(300)] + ["(", "w", "é(é)", "(ab) (w)"]
    rows = spark.createDataFrame(list(enumerate(texts)), "index int, text string")
    for row in rows.select("text", L.outline(F.col("text")).alias("o"), F.size(L.tokens(F.col("text"))).alias("n")).collect():
        assert row.o.count("w") == row.n and re.sub("w", "", row.o) == re.sub(r"[^(){}\[\]]", "", row.text)
    found = {}
    for row in lexicon.definition_postings(rows).orderBy("entry", "word_idx").collect():
        found.setdefault(row.entry, []).append(row.in_paren)
    assert [found.get(k, []) for k in range(len(texts))] == [by_hand(t) for t in texts]


@tables
def test_hits_are_judged_for_their_place_and_words_stay_in_the_jvm(spark):
    plan = registry.QUERIES["classify_precedence"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    judged = [line for line in plan.splitlines() if "AS class0" in line]
    # One filter a branch, and no class of another place: before, each branch had ten expressions and a struct of all classes.
    assert judged and all(line.count("RLIKE(word") <= 8 and "struct(whole" not in line for line in judged)
    assert "ArrowEvalPython" in plan and "regexp_extract_all(translate(" not in plan


def test_texts_are_cut_into_other_letters_as_into_words_translated_after(spark):
    texts = ["", "ab (c) w", "né [xyz", "கடல் ab ) (Ab", "(கa zz", "12 q"]
    rows = spark.createDataFrame(list(enumerate(texts)), "index int, text string")
    read = lambda df: sorted(map(tuple, df.collect()))
    after = lexicon.definition_postings(rows).withColumn("word", script_queries.in_codes(F.col("word")))
    assert read(lexicon.definition_postings(rows, latin_as=script_queries.TAMIL_CODES)) == read(after)


@tables
def test_words_of_texts_are_translated_once(spark):
    plan = registry.QUERIES["search_joint"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # Those of headwords only: before, the words of both kinds of texts too.
    assert len([line for line in plan.splitlines() if re.search(r"translate\(w(ord)?#", line)]) == 2
