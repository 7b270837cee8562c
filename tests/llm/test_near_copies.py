"""Near-copies of the pipeline against exact Jaccard similarity."""

import random

import pytest

import corpus_pipeline as pipeline
from olai.llm import simhash
from tests.llm.helpers import docs


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def pairs_around_the_threshold():
    """Pairs of texts of about 0.7 to 0.9 similarity, and the component of each by hand."""
    r = random.Random(11)
    rows = []
    for k in range(120):
        own = [f"v{r.randrange(90000)}" for _ in range(300)]
        cut = [300 - c for c in (30, 40, 50, 55, 58, 62, 68, 75, 90, 53)][k % 10]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join([*own[:cut], *(f"u{r.randrange(90000)}" for _ in range(15))]))]
    truth, similar = {}, []
    for (a, x), (b, y) in zip(rows[::2], rows[1::2]):
        j = len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y))
        similar.append(j)
        truth |= {a: a, b: a if j >= 0.8 else b}
    return rows, truth, similar


def test_links_are_exact_around_the_threshold(spark):
    rows, truth, similar = pairs_around_the_threshold()
    assert sum(0.8 <= j < 0.9 for j in similar) > 20 and sum(0.65 <= j < 0.8 for j in similar) > 40
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(docs(spark, rows), **pipeline.NEAR).collect()}
    wrong = {k for k in truth if got[k] != truth[k]}
    # None joined below 0.8; of those at 0.8 or more the search may miss one in a hundred.
    assert not {k for k in wrong if truth[k] == k} and len(wrong) <= 1


@pytest.mark.parametrize("block", [256, 4])
def test_verified_links_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(2)
    base = [[r.randrange(10**6) for _ in range(40)] for _ in range(5)]
    sets = [(g * 100 + k, g, sorted({*own[: 40 - r.choice((0, 1, 2, 9, 18, 24))], *(r.randrange(10**6) for _ in range(r.randrange(4)))})) for g, own in enumerate(base) for k in range(30)]
    root = {n: n for n, _, _ in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, g, x in sets:
        for b, g2, y in sets:
            if g == g2 and a < b and len({*x} & {*y}) >= 0.8 * len({*x} | {*y}):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    links = simhash.verified_links(spark.createDataFrame(sets, "node long, root long, h array<bigint>"), 0.8)
    got = {x.node: x.root for x in simhash.connected_components(links).collect()}
    assert {n: got.get(n, n) for n in root} == {n: find(n) for n in root} and len({find(n) for n in root}) > 5
