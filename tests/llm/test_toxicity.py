"""The toxicity network: its forward pass by hand, its gradients, held-out documents, and the query."""

import os
import zlib

import duckdb
import numpy as np
import pytest

from olai.llm import op3_toxicity as query
from olai.llm import toxicity
from olai.llm.op3_toxicity import op3_toxicity
from olai.llm.toxicity import CHAR_DIM, HIDDEN, WINDOW, WORD_DIM, Network

SF = "/root/testdata/sf0.1"


def by_hand(net, words):
    """The logit of one window, a number at a time."""
    w = {k: v.astype(float) for k, v in net.weights.items()}
    code, gram, owner = toxicity.word_codes(words)
    rows = []
    for i in range(len(words)):
        own = [w["char"][g] for g, o in zip(gram, owner) if o == i]
        rows.append([*w["word"][code[i]], *(sum(own) / len(own))])
    soft = lambda x: x / (1 + abs(x))
    states = {}
    for d in "fb":
        h, out = [0.0] * HIDDEN, [None] * len(rows)
        for t in range(len(rows)) if d == "f" else reversed(range(len(rows))):
            x = [sum(rows[t][i] * w["W" + d][i][k] for i in range(len(rows[t]))) + w["c" + d][k] for k in range(3 * HIDDEN)]
            u = [sum(h[i] * w["U" + d][i][k] for i in range(HIDDEN)) for k in range(3 * HIDDEN)]
            z = [0.5 + 0.5 * soft(x[k] + u[k]) for k in range(HIDDEN)]
            r = [0.5 + 0.5 * soft(x[HIDDEN + k] + u[HIDDEN + k]) for k in range(HIDDEN)]
            n = [soft(x[2 * HIDDEN + k] + r[k] * u[2 * HIDDEN + k]) for k in range(HIDDEN)]
            h = [(1 - z[k]) * n[k] + z[k] * h[k] for k in range(HIDDEN)]
            out[t] = h
        states[d] = out
    full = [f + b for f, b in zip(states["f"], states["b"])]
    attention = [sum(soft(sum(s[i] * w["A"][i][k] for i in range(2 * HIDDEN))) * w["v"][k] for k in range(HIDDEN)) for s in full]
    share = np.exp(attention) / np.exp(attention).sum()
    return sum(a * sum(s[k] * w["u"][k] for k in range(2 * HIDDEN)) for a, s in zip(share, full)) + w["b"][0]


def test_forward_pass_by_hand():
    net = Network.fresh(seed=3)
    words = [b"some", b"words", b"a", b"\xc3\xa9t\xc3\xa9", b"some", b"x1"]
    assert np.isclose(net.score([b" ".join(words).decode()])[0][0], by_hand(net, words), atol=1e-4)
    # A longer text has a score for each of its overlapping windows, each as if it stood alone.
    text = [f"w{i % 23}".encode() for i in range(75)]
    scores = net.score([b" ".join(text).decode(), None, "", "one"])
    assert [len(s) for s in scores] == [4, 1, 1, 1]
    for start, s in zip(toxicity.windows(75), scores[0]):
        assert np.isclose(s, net.score([b" ".join(text[start : start + WINDOW]).decode()])[0][0], atol=1e-4)


def test_gradients():
    net = Network.fresh(seed=1)
    words = [[b"one", b"two", b"three", b"two"], [b"bad", b"words", b"here"], [b"x"]]
    y = np.array([0, 1, 1], np.float32)
    for k in net.weights:
        net.weights[k] = net.weights[k].astype(np.float64)
    before = {k: v.copy() for k, v in net.weights.items()}
    net.step(words, y, 0.0)
    grads = {k: m1 / 0.1 for k, (m1, _) in ((k, v) for k, v in net._adam.items() if k != "n")}

    def loss():
        s = [net.score([b" ".join(w).decode()])[0][0] for w in words]
        p = 1 / (1 + np.exp(-np.array(s, np.float64)))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    code, gram, _ = toxicity.word_codes([b"bad", b"words", b"here"])
    at = {"u": 3, "b": 0, "v": 2, "A": (3, 5), "Uf": (1, 2), "Ub": (4, HIDDEN + 3), "Wf": (2, 2 * HIDDEN), "Wb": (WORD_DIM + CHAR_DIM - 1, 1), "cf": 1, "cb": 2 * HIDDEN + 1, "word": (code[0], 1), "char": (gram[0], 2)}
    assert set(at) == set(net.weights)
    for k, i in at.items():
        found = []
        for e in (1e-2, -1e-2):
            net.weights[k] = before[k].copy()
            net.weights[k][i] += e
            found.append(loss())
        net.weights[k] = before[k]
        assert np.isclose((found[0] - found[1]) / 2e-2, grads[k][i], rtol=0.05, atol=2e-4), k


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
def test_query_on_held_out_documents(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(query, "fit_toxicity", lambda *a: fitted.append(toxicity.fit_toxicity(*a)) or fitted[0])
    out = {r.doc_id: r for r in op3_toxicity(spark, SF).collect()}
    con = duckdb.connect()
    assert len(out) == con.execute(f"SELECT count(*) FROM '{SF}/documents.parquet'").fetchone()[0]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in out.items())
    labels = [(i, y) for i, y in con.execute(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall() if out[i].held_out]
    right = sum(out[i].predicted == y for i, y in labels) / len(labels)
    caught = [out[i].predicted for i, y in labels if y]
    assert right >= 0.96 and sum(caught) / len(caught) >= 0.85
    # Whole texts: toxic words at the far end of a long text are found.
    net = fitted[0]
    clean = con.execute(f"SELECT text FROM '{SF}/documents.parquet' JOIN '{SF}/labels.parquet' USING (doc_id) WHERE toxic = 0 AND length(text) > 5000 ORDER BY doc_id").fetchall()
    clean = next(t for (t,) in clean if net.score([t])[0].max() < net.shift)
    assert net.score([clean + " you stupid worthless moron what trash"])[0].max() > net.shift


def test_whole_texts_and_defined_scores():
    # Labels of texts of several windows, of which one is toxic.
    friend = "what a lovely friend you are "
    toxic = [(friend * (i % 9) + f"what an awful {w} you are number {i} " + friend * (i % 7), 1) for i in range(60) for w in ("moron", "idiot")]
    clean = [(friend * (i % 9) + f"what a lovely {w} you are number {i} " + friend * (i % 7), 0) for i in range(60) for w in ("person", "sister")]
    net = toxicity.train(*map(list, zip(*(toxic + clean))), steps=200)
    far = net.score([friend * 2000 + "what an awful moron you are", friend * 2000])
    assert far[0].max() > net.shift > far[1].max() and int(np.argmax(far[0])) >= len(far[0]) - 2
    assert toxicity.train([], []).constant == 0.0 and toxicity.train(["a", "b"], [1, 1]).constant == 1.0
    again = toxicity.train(*map(list, zip(*(toxic + clean))), steps=200)
    assert again.shift == net.shift and all((again.weights[k] == v).all() for k, v in net.weights.items())
