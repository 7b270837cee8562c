"""Importance resampling, exact dedup and the Merkle manifest against plain Python, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from olai.llm import exact_dedup, merkle, resampling
from olai.sources import numbering
from tests.llm.helpers import awkward, docs, empty

TEXTS = ["Alpha beta gamma", "alpha, BETA; gamma!", "été 42 x", "漢字 and words", "", None, "one", "a b c d e f g h i j k l m n o p q r s t u v w"]


def corpus(spark, n=90, seed=4):
    pick = random.Random(seed)
    rows = [(i * 3 - 20, " ".join(pick.choice(TEXTS[:4]) for _ in range(pick.randint(1, 14))) if pick.random() < 0.9 else pick.choice(TEXTS)) for i in range(n)]
    return rows, docs(spark, rows)


def split_words(text):
    low = (text or "").translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def resampled(rows, target, run=1, buckets=10_000, least=20, percent=10):
    grams = lambda t: [" ".join(w[i : i + n]) for w in [split_words(t)] for n in range(1, run + 1) for i in range(len(w) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(bucket(g) for _, x in rows for g in grams(x)), Counter(bucket(g) for x in target for g in grams(x))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    out = []
    for i, x in rows:
        own = [gain[bucket(g)] for g in grams(x)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(split_words(x))))
    able = sorted((o for o in out if o[4] >= least), key=lambda o: (-o[3], o[0] is None, o[0] or 0))
    rank = {o[0]: k + 1 for k, o in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*o[:4], rank.get(o[0])) for o in out), key=repr)


@pytest.mark.parametrize("own", [{}, {"run": 2, "buckets": 50, "least_words": 3, "percent": 37}, {"percent": 100, "least_words": 0}, {"percent": 0}])
def test_resampling(spark, own):
    rows, df = corpus(spark)
    target = ["alpha beta", "words and 42", None, ""]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    got = sorted(map(tuple, resampling.resample(df, items, **own).collect()), key=repr)
    names = {"least_words": "least"}
    assert got == resampled(rows, target, **{names.get(k, k): v for k, v in own.items()})


def test_words_are_those_of_the_contract():
    for text in [*TEXTS, "a_b-c'd\x00e\x7ff{g}h", "ÀÉ Straße x 1/2:3", "x" * 70_000 + " Y"]:
        assert resampling.words(text) == [w.encode() for w in split_words(text)]


def test_radix_selection_finds_the_key(spark):
    pick = random.Random(9)
    big = [-(1 << 63), (1 << 63) - 1, 0, -1]
    for values in ([(pick.randint(-5, 5), pick.choice(big)) for _ in range(60)], [(7, 7)] * 9, [(pick.randint(-(10**6), 10**6), i) for i in range(50)]):
        df = spark.createDataFrame(values, "a long, b long")
        for k in {1, 2, len(values) // 2, len(values)}:
            for digit in (1, 5, 12):
                assert tuple(resampling.kth_key(df, ["a", "b"], k, digit)) == sorted(values)[k - 1]
            if len(values) > 9:
                break


def test_resampling_of_awkward_rows(spark):
    d = awkward(spark)
    items = spark.createDataFrame([("twice the same row",), (None,)], "text string")
    rows = resampling.resample(d, items, least_words=2, percent=50).collect()
    assert len(rows) == d.count() and {r["rank"] for r in rows if r["rank"]} == set(range(1, sum(r["rank"] is not None for r in rows) + 1))
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[1][0].n_features == by_id[2][0].n_features == by_id[3][0].n_features == 0 and by_id[1][0].weight == 0
    assert by_id[4][0].n_features == len(split_words(d.where("doc_id = 4").first().text))
    assert by_id[6][0].score == by_id[6][1].score
    # 9 rows have two words or more, so 4 are drawn; repeated rows count one by one.
    able = d.where("text IS NOT NULL").collect()
    assert sum(r["rank"] is not None for r in rows) == sum(len(split_words(r.text)) >= 2 for r in able) // 2
    assert resampling.resample(empty(spark), items).collect() == []
    assert all(r.weight is not None for r in resampling.resample(d, items.limit(0)).collect())


def test_misra_gries_keeps_what_is_frequent():
    pick = random.Random(2)
    values = [f"v{pick.randint(0, 4000)}" for _ in range(6000)] + ["hot"] * 900 + ["warm"] * 200
    pick.shuffle(values)
    own = exact_dedup.MisraGries(50)
    for at in range(0, len(values), 100):
        counted = Counter(values[at : at + 100])
        own.add(list(counted), list(counted.values()))
    found, true = own.frequent(0.02), Counter(values)
    assert own.error <= len(values) / 51 and len(own.counts) <= 50
    assert {"hot", "warm"} <= set(found)
    assert all(own.counts[v] <= true[v] <= own.counts[v] + own.error for v in true)


@pytest.mark.parametrize("share", [1 / 1024, 1 / 16, 0.9])
def test_copies(spark, share):
    pick = random.Random(6)
    texts = ["hot  copy\tof a\ntext"] * 60 + ["hot copy of a text"] * 20 + [f"text {pick.randint(0, 30)}" for _ in range(80)] + ["", None, " ", "  ", "x y", "x y"]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    df = docs(spark, rows).repartition(5)
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = sorted((i, min(groups[norm(t)]), len(groups[norm(t)]), i == min(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    assert sorted(map(tuple, exact_dedup.find_copies(df, share=share).collect())) == want
    kept = exact_dedup.drop_copies(df, share=share)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want if w[3])
    # What is frequent is split off, and is what has that share.
    keys = exact_dedup._keys(df, "doc_id", "text")
    hot = {bytes(r.digest).hex(): r.group_size for r in exact_dedup.frequent_winners(keys, share).collect()}
    assert hot == {w[4]: w[2] for w in want if w[2] > 1 and w[2] >= share * len(rows)}


def test_copies_of_awkward_rows(spark):
    d = awkward(spark)
    rows = sorted(map(tuple, exact_dedup.find_copies(d).collect()), key=repr)
    assert len(rows) == d.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], []).append(r)
    # Null, empty and the row without id and text are equal; the least id stays, a null id last.
    assert by_id[1][0][1:4] == (1, 3, True) and by_id[2][0][1:4] == (1, 3, False) and {r[1:4] for r in by_id[None]} == {(1, 3, False), (None, 1, True)}
    assert by_id[3][0][2] == 1 and by_id[5][0][1] == 4
    assert by_id[6][0] == by_id[6][1] and by_id[6][0][1:4] == (6, 2, True)
    kept = exact_dedup.drop_copies(d)
    assert kept.columns == d.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (1, 3, 4, 6, 6, 7, 8, 9, 10, 11, 12)] + [(True, 0)]
    assert exact_dedup.find_copies(empty(spark)).collect() == [] and exact_dedup.drop_copies(empty(spark)).collect() == []


def sha(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def beside(levels, at):
    """For each level, the node's run and its place in it."""
    return [(levels[k][at >> k & ~1 : (at >> k & ~1) + 2], (at >> k) % 2) for k in range(len(levels) - 1)]


def manifests(rows):
    leaf = lambda *values: sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])
    langs = {}
    for i, text, lang, source, n in rows:
        langs.setdefault(lang, []).append((i is not None, i or 0, leaf(i, source, lang, n, text), (i, text, lang, source, n)))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([x[2] for x in sorted(langs[g], key=lambda x: x[:3])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for number, g in enumerate(order):
        for at, (_, _, own, (i, text, lang, source, n)) in enumerate(sorted(langs[g], key=lambda x: x[:3])):
            way = beside(trees[g], at) + beside(top, number)
            proof = sha(*[run[1 - k] for run, k in way if len(run) > 1])
            now = leaf(i, source, lang, n + 1, text) if i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None else own
            for run, k in way:
                now = sha(*[now if j == k else x for j, x in enumerate(run)])
            out.append((i, own, trees[g][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("sizes", "bits"), [({"en": 37, "de": 8, None: 5, "zz": 1}, 2), ({"en": 64}, 3), ({"en": 1}, 2), ({f"l{k:03}": 2 for k in range(19)} | {"a": 30}, 1), ({"en": 50, "fr": 20}, 11)])
def test_manifest(spark, sizes, bits):
    pick = random.Random(1)
    rows, at = [], -10
    for lang, n in sizes.items():
        for _ in range(n):
            at += pick.randint(1, 5)
            text = pick.choice(["é 漢", "", None, "plain text", "x" * 5000])
            rows.append((at, text, lang, pick.choice(["s", None]), pick.choice([len(text or ""), None])))
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    found = merkle.manifest(df, bits).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, found), key=repr) == manifests(rows)


def test_manifest_of_awkward_rows(spark):
    d = awkward(spark)
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in d.collect()]
    found = merkle.manifest(d, 2).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, found), key=repr) == manifests(rows)
    assert merkle.manifest(empty(spark)).collect() == []


def test_numbers_in_order(spark):
    pick = random.Random(8)
    rows = [(pick.choice(["a", "b", None]), pick.choice([None, *range(6)])) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(6)
    got = numbering.number_in_order(df, [F.col("v").asc_nulls_first()], "g").collect()
    for g in ("a", "b", None):
        own = sorted((r.pos, r.v) for r in got if r.g == g)
        values = sorted((v for x, v in rows if x == g), key=lambda v: (v is not None, v or 0))
        assert own == list(enumerate(values)) and {r.pos_of for r in got if r.g == g} == {len(own)}
    alone = numbering.number_in_order(df, [F.col("v").desc()]).collect()
    assert sorted(r.pos for r in alone) == list(range(200))
