"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from olai.llm import bitsliced, decontamination, licenses, line_dedup, mixing, secrets, simhash, suffix_dedup, toxicity, url_filter
from tests.llm.helpers import awkward, docs, empty

RULES = (("com/", "allow"), ("example.com/en/", "block"))


def items(spark):
    return spark.createDataFrame([(1, "twice the same row twice the same row twice", 5), (None, "one two three", 5), (3, None, 5), (4, "", 5), (4, "one two three", 5)], "item_id long, text string, size int")


def network(spark):
    toxic = [(f"what an awful {w} you are number {i}", 1) for i in range(12) for w in ("moron", "idiot")]
    clean = [(f"what a lovely {w} you are number {i}", 0) for i in range(12) for w in ("person", "friend")]
    return toxicity.train(*map(list, zip(*(toxic + clean))), steps=60)


OPERATORS = {
    "mixing": lambda s, d: mixing.mix_sources(d),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, network(s)),
    "licenses": lambda s, d: licenses.scan_licenses(d.withColumn("path", F.col("source"))),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "simhash_wide": lambda s, d: simhash.near_duplicates(d, **pipeline.NEAR),
    "suffix": lambda s, d: suffix_dedup.remove_repeats(d),
    "secrets": lambda s, d: secrets.scan_secrets(d),
    "lines": lambda s, d: line_dedup.dedup_lines(d),
    "urls": lambda s, d: url_filter.filter_urls(d.withColumn("page_id", F.col("doc_id")).withColumn("url", F.col("text")).withColumn("host", F.lit("h")), RULES),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_each_input_row(spark, name):
    d = awkward(spark)
    rows = OPERATORS[name](spark, d).collect()
    assert len(rows) == d.count()
    # Repeated rows have equal results.
    by_id = [r.asDict() for r in rows if r.asDict().get("doc_id", r.asDict().get("page_id")) == 6]
    assert len(by_id) == 2
    if name != "mixing":
        assert by_id[0] == by_id[1]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, empty(spark)).collect() == []


def test_defined_results_of_odd_texts(spark):
    d = awkward(spark)
    mixed = {(r.doc_id, r.source): r for r in mixing.mix_sources(d).collect()}
    assert mixed[(None, None)]["size"] == 0 and mixed[(2, "b")].taken == 0 and mixed[(3, None)]["size"] == 0
    prints = {r.doc_id: list(r.fp) for r in simhash.near_duplicates(d).collect()}
    assert prints[1] == prints[2] == prints[3] == [0]
    removed = {r.doc_id: r for r in suffix_dedup.remove_repeats(d).collect()}
    assert removed[2].n_bytes == 0 and removed[2].kept == b"" and removed[5].n_removed == removed[5].n_bytes and removed[4].n_removed < removed[4].n_bytes
    assert removed[9].n_bytes == len("é ü 漢字 😀 ﬁn".encode()) and removed[6].n_removed > 0
    found = {r.doc_id: r for r in secrets.scan_secrets(d).collect()}
    assert found[2].base == [] and found[1].base == [] and len(found[4].base) == 6000
    kept = {r.doc_id: r for r in line_dedup.dedup_lines(d).collect()}
    assert kept[2].kept is None and kept[1].kept == "" and kept[1].n_removed == 0 and kept[5].n_removed > 3000


def test_contamination(spark):
    d = awkward(spark)
    pairs = sorted((r.doc_id, r.item_id or 0, r.containment) for r in decontamination.find_contamination(d, items(spark)).collect())
    assert pairs == [(6, 1, 1.0), (6, 1, 1.0), (12, 0, 1.0), (12, 4, 1.0)]
    assert decontamination.find_contamination(empty(spark), items(spark)).collect() == []
    assert decontamination.find_contamination(d, items(spark).limit(0)).collect() == []
    kept = decontamination.drop_contaminated(d, items(spark))
    assert kept.columns == d.columns and kept.count() == d.count() - 3


def ranked(df, queries, k):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in bitsliced.top_k(df, queries, k).collect())


def test_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (1, None, 1), (2, [], 1), (3, [None, 1.0], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf")], 1), (None, [1.0, 1.0], 1), (7, [0.5], 1), (8, [0.5, 0.0], 1), (8, [0.5, 0.0], 1), (40, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    out = ranked(df, df.where("vec_id % 20 = 0"), 20)
    # An empty vector takes part, with score 0.
    assert out == [(q, r, v, s) for q, other in ((0, 20), (20, 0)) for r, v, s in ((1, other, 4096), (2, 7, 2048), (3, 8, 2048), (4, 8, 2048), (5, 2, 0))]
    assert bitsliced.top_k(df.limit(0), df).collect() == [] and bitsliced.top_k(df, df.limit(0)).collect() == []
    empty_only = spark.createDataFrame([(0, []), (1, [])], "vec_id long, embedding array<double>")
    assert ranked(empty_only, empty_only, 3) == [(0, 1, 1, 0), (1, 1, 0, 0)]


def test_huge_components_are_exact(spark):
    kind = "vec_id long, embedding array<double>"
    huge = spark.createDataFrame([(0, [1e10, 0.5]), (1, [-1e10, 0.5]), (2, [1e10, -0.5]), (3, [3e38, 0.0]), (4, [2.0, 1.0]), (5, [-3e38, 0.0]), (6, [1e308 * 10, 0.0])], kind)
    # Ranked by the exact score, given as the limits of a long where it holds no more.
    assert ranked(huge, huge.where("vec_id = 0"), 5) == [(0, 1, 3, (1 << 63) - 1), (0, 2, 2, (1 << 63) - 1), (0, 3, 4, 640_000_000_000 * 128 + 32 * 64), (0, 4, 1, -(1 << 63)), (0, 5, 5, -(1 << 63))]
    # A component beyond 2**61 whose score a long holds.
    odd = spark.createDataFrame([(0, [1 / 64, 0.0]), (1, [1e17, 0.0]), (2, [-1e17, 3.0]), (3, [1e17 - 16, 0.0])], kind)
    assert ranked(odd, odd.where("vec_id = 0"), 3) == [(0, 1, 1, 6_400_000_000_000_000_000), (0, 2, 3, 64 * (10**17 - 16)), (0, 3, 2, -6_400_000_000_000_000_000)]


def test_each_query_row_is_ranked(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [-1.0]), (0, [1.0]), (1, [2.0]), (2, [1.0]), (2, [-2.0])], "vec_id long, embedding array<double>")
    up, down = [(1, 1, 8192), (2, 2, 4096), (3, 2, -8192)], [(1, 2, 8192), (2, 2, -4096), (3, 1, -8192)]
    assert ranked(df, df.where("vec_id = 0"), 20) == sorted((0, r, v, s) for r, v, s in up + down)


def test_blocks_of_vectors(spark, monkeypatch):
    """Many blocks in few tasks, against plain products."""
    monkeypatch.setattr(bitsliced, "INDEX_BLOCK", 16)
    monkeypatch.setattr(bitsliced, "TASKS_A_CORE", 1)
    pick = random.Random(5)
    rows = [(i, [pick.randint(-3, 3) / pick.choice((1, 7)) for _ in range(3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    want = []
    for q in range(0, 300, 20):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:7]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert ranked(df, df.where("vec_id % 20 = 0"), 7) == sorted(want)


@pytest.fixture(scope="module")
def side_tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, "one two three four five six", 5)], "item_id long, text string, size int").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, 0, int(i > 3)) for i in range(1, 9)] + [(None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.mark.parametrize("stage", [name for name, _ in pipeline.STAGES])
def test_stages(spark, side_tables, stage):
    run = dict(pipeline.STAGES)[stage]
    out = run(spark, awkward(spark), side_tables)
    if stage != pipeline.STAGES[-1][0]:
        assert sorted(out.columns) == sorted(pipeline.COLUMNS)
    assert out.count() > 0
    assert run(spark, empty(spark), side_tables).collect() == []


def test_stages_take_effect(spark, side_tables):
    passage = "\n".join(f"shared line number {k} that some documents hold word for word" for k in range(30))
    near = " ".join(f"w{k}" for k in range(300))
    d = docs(spark, [(1, passage), (2, passage), (3, "clean text of its own"), (4, near), (5, near.replace("w150", "other")), (6, "zero one two three four five six seven"), (7, near), (8, None), (9, "\n".join([passage.replace("some", "no")] * 6))])
    kept = {r.doc_id: r for r in pipeline.lines(spark, d, side_tables).collect()}
    assert set(kept) == {1, 3, 4, 5, 6, 7, 8, 9}
    # A text that repeats itself loses the repeats, but is no copy.
    assert len(kept[9].text) < 0.5 * len(d.where("doc_id = 9").first().text) and kept[9].n_chars == len(kept[9].text)
    kept = {r.doc_id for r in pipeline.near(spark, d, side_tables).collect()}
    assert kept == {1, 3, 4, 6, 8, 9}
    assert {r.doc_id for r in pipeline.leaks(spark, d, side_tables).collect()} == {1, 2, 3, 4, 5, 7, 8, 9}
