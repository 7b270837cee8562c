"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, STRIDE, HIDDEN = 32, 16, 16
WORD_BUCKETS, WORD_DIM = 8192, 8
#: Bytes of the character n-grams of a word with its bounds; a shorter word is one n-gram.
GRAM, CHAR_BUCKETS, CHAR_DIM = 5, 16384, 16
INPUT = WORD_DIM + CHAR_DIM
#: Windows, and characters of texts, that are scored at once (or one longer text).
BLOCK, CHARS = 2048, 1 << 21
# Letters and digits stay, A-Z lower-cased, with all bytes of other scripts; the rest separates.
_TOKENS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TOKENS).split()


def word_codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, and the buckets of the character n-grams of all words with the word they belong to."""
    text = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(size) - size
    of = np.repeat(np.arange(len(words)), size)
    text = np.append(text, np.zeros(GRAM - 1, np.uint32))
    h = np.zeros(len(of), np.uint32)
    inside = np.arange(len(of)) - start[of]
    for k in range(GRAM):
        h = (h ^ text[k : k + len(h)] * (inside + k < size[of])) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    whole = (inside == 0) | (inside <= size[of] - GRAM)
    text = text[: len(of)]
    mixed = (text + np.uint32(1)) * (inside.astype(np.uint32) * np.uint32(2654435762) | np.uint32(1))
    mixed ^= mixed >> np.uint32(15)
    word = np.add.reduceat(mixed * np.uint32(0x85EBCA6B), start)
    return (word ^ word >> np.uint32(16)) % np.uint32(WORD_BUCKETS), h[whole] % np.uint32(CHAR_BUCKETS), of[whole]


def windows(n: int) -> np.ndarray:
    """Starts of the overlapping windows that cover ``n`` words; an empty text has one."""
    return np.arange(0, max(1, n - STRIDE), STRIDE)


def _squash(x: np.ndarray) -> np.ndarray:
    """Softsign, in place of the hyperbolic tangent: a fraction of its cost in numpy."""
    return x / (1 + np.abs(x))


def _slope(gate: np.ndarray) -> np.ndarray:
    """The derivative of ``gate = (1 + softsign(x)) / 2`` in x."""
    return 2 * np.minimum(gate, 1 - gate) ** 2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Weights by name; a text of highest logit x has the probability ``sigmoid(slope * (x - shift))``."""

    weights: dict[str, np.ndarray]
    shift: float = 0.0
    slope: float = 1.0
    constant: float | None = None
    _adam: dict = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        w = lambda *s, by=0.3: (r.standard_normal(s) * by).astype(np.float32)
        weights = {"word": w(WORD_BUCKETS, WORD_DIM, by=0.1), "char": w(CHAR_BUCKETS, CHAR_DIM), "A": w(2 * HIDDEN, HIDDEN), "v": w(HIDDEN), "u": w(2 * HIDDEN), "b": np.zeros(1, np.float32)}
        for d in "fb":
            weights |= {f"W{d}": w(INPUT, 3 * HIDDEN), f"U{d}": w(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        return Network(weights)

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        """An input row for each word: its embedding, and the mean embedding of its character n-grams."""
        code, gram, owner = word_codes(words)
        count = np.bincount(owner, minlength=len(words)).astype(np.float32)
        char = np.zeros((len(words), CHAR_DIM), np.float32)
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        char[owner[starts]] = np.add.reduceat(self.weights["char"][gram], starts, axis=0)
        return np.concatenate([self.weights["word"][code], char / count[:, None]], 1), (code, gram, owner, count)

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """Hidden states ``(T, B, H)`` over projected inputs ``(T, B, 3H)``."""
        u, h = self.weights["U" + way], np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.empty((*x.shape[:2], HIDDEN), np.float32)
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            hu = h @ u
            gates = 0.5 + 0.5 * _squash(x[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = _squash(x[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, hu, z, r, n, m))
            h = h + m * (new - h)
            out[t] = h
        return out

    def _pool(self, h: np.ndarray, mask: np.ndarray) -> tuple:
        k = _squash(h @ self.weights["A"])
        s = k @ self.weights["v"] - 30 * (1 - mask)
        a = np.exp(s - s.max(axis=0))
        a /= a.sum(axis=0)
        c = np.einsum("tb,tbh->bh", a, h)
        return k, a, c, c @ self.weights["u"] + self.weights["b"][0]

    def logits(self, x: dict[str, np.ndarray], ids: np.ndarray) -> np.ndarray:
        """Of windows given as word numbers ``(B, T)`` into the projected rows ``x``; -1 pads."""
        out = np.empty(len(ids), np.float32)
        for at in range(0, len(ids), BLOCK):
            own = ids[at : at + BLOCK].T
            mask = (own >= 0).astype(np.float32)
            h = np.concatenate([self._run(x[d][np.maximum(own, 0)], mask, d) for d in "fb"], 2)
            out[at : at + BLOCK] = self._pool(h, mask)[3]
        return out

    def project(self, rows: np.ndarray) -> dict[str, np.ndarray]:
        return {d: rows @ self.weights["W" + d] + self.weights["c" + d] for d in "fb"}

    def score(self, texts: list[str | None]) -> list[np.ndarray]:
        """Logits of all windows of each whole text."""
        number: dict[bytes, int] = {}
        ids, counts = [], []
        for text in texts:
            own = np.array([number.setdefault(w, len(number)) for w in tokens(text)], np.int64)
            at = windows(len(own))[:, None] + np.arange(WINDOW)
            ids.append(np.where(at < len(own), own[np.minimum(at, len(own) - 1)] if len(own) else -1, -1))
            counts.append(len(at))
        words = list(number) or [b"-"]
        x = self.project(self.inputs(words)[0])
        return np.split(self.logits(x, np.concatenate(ids)), np.cumsum(counts)[:-1]) if texts else []

    def calibrate(self, top: np.ndarray, y: np.ndarray) -> None:
        """Fit the logistic curve that turns the highest logit of a text into its probability, by damped Newton steps."""
        mean, scale = top.mean(), top.std() + 1e-6
        x, c = np.stack([(top - mean) / scale, np.ones(len(top))], 1), np.array([1.0, 0.0])
        for _ in range(50):
            p = _sigmoid(x @ c)
            hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
            c -= np.clip(np.linalg.solve(hess, x.T @ (p - y) + 0.1 * c * [1, 0]), -1, 1)
        self.slope = float(max(c[0], 1e-3) / scale)
        self.shift = float(mean - c[1] / max(c[0], 1e-3) * scale)

    def step(self, batch: list[list[bytes]], y: np.ndarray, rate: float, drop: np.ndarray | None = None, decay: float = 0.0) -> float:
        """One step of Adam on windows of words; returns the loss.

        ``drop`` scales the word embedding of each place ``(T, B)``; ``decay``
        shrinks the embeddings that the batch uses.
        """
        w, steps = self.weights, WINDOW
        words: list[bytes] = []
        at = np.full((steps, len(batch)), -1)
        for b, own in enumerate(batch):
            at[: len(own), b] = np.arange(len(words), len(words) + len(own))
            words += own
        rows, (code, gram, owner, count) = self.inputs(words or [b"-"])
        mask = (at >= 0).astype(np.float32)
        inp = rows[np.maximum(at, 0)]
        if drop is not None:
            inp[:, :, :WORD_DIM] *= drop[:, :, None]
        kept: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self._run(inp @ w["W" + d] + w["c" + d], mask, d, kept[d]) for d in "fb"], 2)
        k, a, c, logit = self._pool(h, mask)
        p = _sigmoid(logit)
        d_logit = ((p - y) / len(y)).astype(np.float32)
        g = {"u": c.T @ d_logit, "b": np.array([d_logit.sum()])}
        dc = d_logit[:, None] * w["u"]
        da = np.einsum("bh,tbh->tb", dc, h)
        ds = a * (da - (a * da).sum(axis=0))
        g["v"] = np.einsum("tb,tbk->k", ds, k)
        dk = ds[:, :, None] * w["v"] * (1 - np.abs(k)) ** 2
        g["A"] = np.einsum("tbh,tbk->hk", h, dk)
        dh_all = a[:, :, None] * dc + dk @ w["A"].T
        d_rows = np.zeros((steps, len(batch), INPUT), np.float32)
        for i, d in enumerate("fb"):
            dx, du, carry = np.zeros((steps, len(batch), 3 * HIDDEN), np.float32), np.zeros_like(w["U" + d]), 0.0
            for t, prev, hu, z, r, n, m in reversed(kept[d]):
                dh = dh_all[t][:, i * HIDDEN : (i + 1) * HIDDEN] + carry
                new = m * dh
                pre_n = new * (1 - z) * (1 - np.abs(n)) ** 2
                pre_z, pre_r = new * (prev - n) * _slope(z), pre_n * hu[:, 2 * HIDDEN :] * _slope(r)
                dhu = np.concatenate([pre_z, pre_r, pre_n * r], 1)
                dx[t] = np.concatenate([pre_z, pre_r, pre_n], 1)
                du += prev.T @ dhu
                carry = (1 - m) * dh + new * z + dhu @ w["U" + d].T
            g |= {"U" + d: du, "W" + d: np.einsum("tbi,tbk->ik", inp, dx), "c" + d: dx.sum(axis=(0, 1))}
            d_rows += dx @ w["W" + d].T
        if drop is not None:
            d_rows[:, :, :WORD_DIM] *= drop[:, :, None]
        own = decay * rows / len(batch)
        own[at[at >= 0]] += d_rows[at >= 0]
        g["word"] = np.stack([np.bincount(code, own[:, j], WORD_BUCKETS) for j in range(WORD_DIM)], 1)
        g["char"] = np.stack([np.bincount(gram, (own[:, WORD_DIM + j] / count)[owner], CHAR_BUCKETS) for j in range(CHAR_DIM)], 1)
        n = self._adam["n"] = self._adam.get("n", 0) + 1
        for name, grad in g.items():
            grad = np.asarray(grad, w[name].dtype)
            m1, m2 = self._adam.setdefault(name, (np.zeros_like(grad), np.zeros_like(grad)))
            m1 += 0.1 * (grad - m1)
            m2 += 0.001 * (grad * grad - m2)
            w[name] -= m1 * (rate / (1 - 0.9**n)) / (np.sqrt(m2 / (1 - 0.999**n)) + 1e-8)
        return float(-np.mean(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)))


def train(texts: list[str], labels: list[int], steps: int = 600, batch: int = 64, rounds: int = 6, seed: int = 7) -> Network:
    """Fit on labelled texts; without both labels the network is constant.

    A label holds for a whole text, a score for a window, so this is learning
    from bags: a text stands in a batch by one of its windows, at first any,
    after each of ``rounds`` parts of the run mostly the one that the network
    itself finds the most toxic (looked up anew for 1,500 texts of each label
    in turn). One text in ten is kept from the steps; on
    those the highest logit of a text is turned into a probability.
    """
    y = np.array(labels, np.int64)
    same: dict[bytes, bytes] = {}
    docs = [[same.setdefault(w, w) for w in tokens(t)] for t in texts]
    if len(set(labels)) < 2:
        return Network({}, constant=float(y[0]) if len(y) else 0.0)
    r = np.random.default_rng(seed)
    net, best = Network.fresh(seed), np.full(len(docs), -1)
    groups = [np.flatnonzero(y == k) for k in (0, 1)]
    kept = [g[r.permutation(len(g))] for g in groups]
    aside = np.sort(np.concatenate([k[: len(k) // 10] for k in kept]))
    groups = [np.sort(k[len(k) // 10 :]) for k in kept]

    def rescore(of: np.ndarray) -> np.ndarray:
        top = np.empty(len(of))
        for i in range(0, len(of), 500):
            for j, (k, s) in enumerate(zip(of[i : i + 500], net.score([texts[k] for k in of[i : i + 500]])), i):
                best[k], top[j] = int(windows(len(docs[k]))[int(np.argmax(s))]), s.max()
        return top

    for i in range(steps):
        if i and i % (steps // rounds) == 0:
            rescore(np.concatenate([g[r.permutation(len(g))[:1500]] for g in groups]))
        picked = np.concatenate([r.choice(g, batch // 2) for g in groups])
        at = [best[k] if best[k] >= 0 and r.random() < 0.7 else int(r.integers(0, max(1, len(docs[k]) - WINDOW + 1))) for k in picked]
        net.step([docs[k][s : s + WINDOW] for k, s in zip(picked, at)], y[picked].astype(np.float32), 0.005 if i < steps * 0.7 else 0.0015, 2.0 * (r.random((WINDOW, batch)) < 0.5).astype(np.float32), 0.01)
    judged = aside if len(set(y[aside].tolist())) == 2 else np.arange(len(docs))
    net.calibrate(rescore(judged), y[judged])
    net._adam = {}
    return net


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = 6000, fit_chars: int = 50_000) -> Network:
    """Train on at most ``fit_rows`` labelled documents of at most ``fit_chars`` characters (the bounds of the fit).

    These are the first by md5 of their ids. Only documents count whose
    ``crc32(id) mod 5`` is not 0; rows without a label or an id don't. Of rows
    that repeat an id the least text counts, of repeated texts the first id.
    """
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(F.crc32(F.col(id_col).cast("string")) % 5 != 0)
    ids = ids.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label")).orderBy(F.md5(F.col("_id").cast("string"))).limit(fit_rows)
    # At most fit_rows ids.
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).where(F.length("_text") <= fit_chars)
    # At most fit_rows ids.
    rows = texts.join(F.broadcast(ids), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_label").alias("_label")).toPandas()
    rows = rows.sort_values("_id").drop_duplicates("_text")
    return train(rows["_text"].tolist(), rows["_label"].astype(int).tolist())


def toxicity(docs: DataFrame, network: Network, text_col: str = "text") -> Column:
    """A column for ``docs``: a struct of ``score, n_windows, worst``, see :func:`score_toxicity`."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(texts: pd.Series) -> pd.DataFrame:
        net, found = shared.value, []
        if net.constant is not None:
            found = [(net.constant, 1, 0)] * len(texts)
        size = np.cumsum([len(t) if isinstance(t, str) else 0 for t in texts], dtype=np.int64)
        for _, part in texts.groupby(size // CHARS, sort=True) if net.constant is None else ():
            scores = net.score([t if isinstance(t, str) else None for t in part])
            found += [(round(float(_sigmoid(net.slope * (np.float64(s.max()) - net.shift))), 6), len(s), int(np.argmax(s)) * STRIDE) for s in scores]
        return pd.DataFrame(found, columns=["score", "n_windows", "worst"])

    return F.pandas_udf(run, "score double, n_windows long, worst long").asNondeterministic()(F.col(text_col))


def score_toxicity(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, score, n_windows, worst``.

    ``score`` is the highest probability of any of the overlapping windows of
    the whole text, ``worst`` the number of the first word of that window.
    Null, empty and wordless texts are scored as one empty window. Repeated
    rows score alike; an empty table gives an empty result; other columns are
    ignored.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), toxicity(docs, network, text_col).alias("t"))
    return found.select("doc_id", "t.score", "t.n_windows", "t.worst")
