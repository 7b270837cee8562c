"""Line dedup of whole repeated runs against plain Python."""

import random

import corpus_pipeline as pipeline
from olai.llm import line_dedup
from tests.llm.helpers import docs


def by_hand(rows):
    """What is left of each text, and the lines that went, one chunk after the other."""
    texts = {k: t.split("\n") for k, t in sorted(rows) if t and "\n" in t}
    first, again = {}, {k: set() for k in texts}
    for k, lines in texts.items():
        for a, b in line_dedup.chunk_bounds(lines):
            if first.setdefault(tuple(lines[a:b]), (k, a, b)) != (k, a, b):
                again[k].add(a)
    gone = {k: set() for k, _ in rows}
    for k, lines in texts.items():
        at = line_dedup.cuts(lines)
        for a, b in line_dedup.chunk_bounds(lines):
            d, s, e = first[tuple(lines[a:b])]
            if a not in again[k] or (d == k and a < e):
                continue
            other, cut = texts[d], line_dedup.cuts(texts[d])
            top = max(at[max(at.index(a) - 2, 0)] - a, cut[max(cut.index(s) - 2, 0)] - s, e - a if d == k else -len(lines))
            up = 0
            while (a == 0 or at[at.index(a) - 1] not in again[k]) and -up > top and lines[a - up - 1] == other[s - up - 1]:
                up += 1
            end = min(at[min(at.index(b) + 2, len(at) - 1)] - b, cut[min(cut.index(e) + 2, len(cut) - 1)] - e, a - up - e if d == k else len(lines))
            down = 0
            while at[at.index(a) + 1] not in again[k] and down < end and lines[b + down] == other[e + down]:
                down += 1
            gone[k] |= set(range(a - up, b + down))
    return {k: (t and "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[k]), len(gone[k])) for k, t in rows}


def corpus(r):
    lines = [f"line {k} of a common text" for k in range(60)]
    rows = []
    for k in range(120):
        s, n = r.randrange(50), r.randrange(2, 12)
        own = [f"own {k} {j}" for j in range(r.randrange(1, 6))]
        rows.append((k, "\n".join([*own[: len(own) // 2], *lines[s : s + n], *own[len(own) // 2 :], *["same"] * r.choice((0, 0, 5, 14))])))
    return rows + [(200, rows[3][1]), (201, "one"), (202, "one\ntwo"), (203, "one\ntwo"), (204, None), (205, "")]


def test_repeats_against_plain_python(spark):
    for seed in (4, 5):
        rows = corpus(random.Random(seed))
        got = {x.doc_id: (x.kept, x.n_removed) for x in line_dedup.dedup_lines(docs(spark, rows)).collect()}
        assert got == by_hand(rows) and got[200][0] == "" and got[203] == ("", 2) and got[202] == ("one\ntwo", 0)


def test_long_repeated_passages_go_whole(spark):
    """Of passages that occur earlier, nearly all lines go, wherever they stand."""
    r = random.Random(6)
    passages = [[f"passage {p} has line {k}" for k in range(r.randrange(6, 30))] for p in range(40)]
    rows = [(k, "\n".join([*[f"own {k} {j}" for j in range(r.randrange(1, 9))], *passages[k % 40], *[f"end {k} {j}" for j in range(r.randrange(1, 9))]])) for k in range(200)]
    got = {x.doc_id: x for x in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert all(got[k].n_removed == 0 for k in range(40))
    assert sum(got[k].n_removed for k in range(40, 200)) >= 0.97 * sum(len(passages[k % 40]) for k in range(40, 200))
    assert all(f"own {k} 0" in got[k].kept and f"end {k} 0" in got[k].kept for k in range(200))


def test_chunks():
    r = random.Random(8)
    for _ in range(300):
        own = [f"line {r.randrange(30)}" for _ in range(r.randrange(2, 30))] + ["same"] * r.randrange(20) + [f"end {k}" for k in range(r.randrange(3))]
        bounds, at = line_dedup.chunk_bounds(own), line_dedup.cuts(own)
        assert bounds[0][0] == 0 and bounds[-1][1] >= len(own) - 1 and all(b - a > 1 for a, b in bounds) and {x for b in bounds for x in b} <= set(at)
        assert all(b == min(x for x in at if x >= a + 2) for a, b in bounds)
    assert line_dedup.chunk_bounds(["one"]) == []
    assert line_dedup.chunk_bounds(["same"] * 12) == [(0, 2), *((k, k + 2) for k in range(2, 11))]


def test_what_is_left_of_a_document_stays(spark):
    passage = "\n".join(f"shared line number {k} that some documents hold" for k in range(30))
    rows = [(1, passage), (2, passage + "\nan end of its own"), (3, passage + "\n \n"), (4, passage), (5, "\t\n"), (6, None)]
    got = {x.doc_id: x.text for x in pipeline.lines(spark, docs(spark, rows), "").collect()}
    assert got == {1: passage, 2: "an end of its own", 5: "\t\n", 6: None}
