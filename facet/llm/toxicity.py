"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (on UTF-8 bytes, with marks at its ends), each hashed to
an embedding; the average of the bag feeds a two-class softmax.  Embeddings and softmax are trained
jointly (Adam, full batches, numpy) on the words of a bounded labelled sample: a word's target is the
smoothed share of toxic documents among those that have it.  A misspelling never seen shares most
n-grams, and so most of its vector, with the word it is made from.

The average over a whole document drowns the few words that make it toxic (README: held-out figures of both forms), so
a document's score pools its words' logits: a logistic model, fitted on sampled documents whose words
were not counted, takes the highest and the second highest logit, the logs of how many words are warm and of how many there are.
Scoring covers every whole text.

Defined results: null and empty texts score what a document without words scores; without labelled
rows of both classes, or without words in them, every document gets the share of toxic rows (0.5 without any); repeated rows
get a row each; texts and words of any length are read whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_texts

SAMPLE = 3000  # labelled documents a class
BUCKETS = 1 << 16
DIM = 8
SIZES = (4, 5, 6)
_CHUNK = 1 << 20
_FOLD = np.full(256, 32, np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        _FOLD[_c] = ord(chr(_c).lower()) if _c < 128 else _c
_TURN = np.uint64(0x9E3779B97F4A7C15)


def folded(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def grams(b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: buckets of the n-grams that start at i, and whether each lies in one word with its end marks.

    ``b`` is folded, and starts and ends with a space."""
    gap = b == 32
    h = np.zeros(len(b), np.uint64)
    inner = np.zeros(len(b), bool)  # a gap between the first and the last byte
    for n in range(1, max(SIZES) + 1):
        m = len(b) - n + 1
        if m <= 0:
            return
        if n > 2:
            inner = inner[:m] | gap[n - 2 : n - 2 + m]
        h = (h[:m] ^ b[n - 1 :]) * _TURN
        h ^= h >> np.uint64(31)
        if n in SIZES:
            yield (h >> np.uint64(11)).astype(np.int64) & (BUCKETS - 1), ~inner[:m]


@dataclass
class Model:
    weight: np.ndarray  # by bucket: the embedding's share of the logit
    bias: float
    pool: np.ndarray  # weights of what ``pooled`` gives

    def pooled(self, texts: list[str | None]) -> np.ndarray:
        """By text: 1, highest and second highest logit of its words, log(1 + what logits have above -1), log(1 + words)."""
        n = len(texts)
        top, second, words, warm = np.full(n, -np.inf), np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n)
        held: list[bytes] = []
        owner: list[int] = []

        def flush() -> None:
            b = _FOLD[np.frombuffer(b" " + b" ".join(held) + b" ", np.uint8)]
            logits, starts = self.logits(b)
            lengths = np.array([len(x) + 1 for x in held])
            doc = np.array(owner)[np.searchsorted(np.cumsum(lengths), starts - 1, side="right")]
            if len(doc):
                by = np.lexsort((logits, doc))
                d, v = doc[by], logits[by]
                last = np.flatnonzero(np.append(d[1:] != d[:-1], True))
                before = np.where((last > 0) & (d[np.maximum(last - 1, 0)] == d[last]), v[np.maximum(last - 1, 0)], -np.inf)
                k = d[last]
                second[k] = np.maximum(np.minimum(top[k], v[last]), np.maximum(second[k], before))
                top[k] = np.maximum(top[k], v[last])
                np.add.at(words, doc, 1)
                np.add.at(warm, doc, np.maximum(0, logits + 1))
            held.clear()
            owner.clear()

        room = 0
        for i, t in enumerate(texts):
            b = folded(t)
            a = 0
            while a < len(b):
                z = min(len(b), a + _CHUNK)
                if z < len(b):  # not within a word
                    z = 1 + max(b.rfind(b" ", a, z), b.rfind(b"\n", a, z)) or z
                    z = z if z > a else min(len(b), a + _CHUNK)
                held.append(b[a:z])
                owner.append(i)
                room += z - a
                a = z
                if room >= _CHUNK:
                    flush()
                    room = 0
        if held:
            flush()
        low = self.bias
        return np.column_stack([np.ones(n), np.where(np.isfinite(top), top, low), np.where(np.isfinite(second), second, low), np.log1p(warm), np.log1p(words)])

    def logits(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logit of each word of a folded buffer, and where it starts."""
        word = b != 32
        starts = np.flatnonzero(word[1:] & ~word[:-1]) + 1
        ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
        total, count = np.zeros(len(b) + 1), np.zeros(len(b) + 1)
        for bucket, good in grams(b):
            total[2 : 2 + len(good)] += np.where(good, self.weight[bucket], 0)
            count[2 : 2 + len(good)] += good
        total, count = total.cumsum(), count.cumsum()  # at i + 1: of n-grams whose second byte is before i + 1
        return (total[ends] - total[starts]) / np.maximum(count[ends] - count[starts], 1) + self.bias, starts

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.pooled(texts) @ self.pool, -500, 500)))


def _adam(p: np.ndarray, g: np.ndarray, state: list[np.ndarray], step: int, rate: float) -> None:
    state[0][:] = 0.9 * state[0] + 0.1 * g
    state[1][:] = 0.999 * state[1] + 0.001 * g * g
    p -= rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)


def train_words(words: list[bytes], share: np.ndarray, weight: np.ndarray, epochs: int = 20, rate: float = 0.05, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """(logit weight by bucket, bias) for words whose targets are ``share``, jointly over embeddings and softmax."""
    b = _FOLD[np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)]
    starts = np.cumsum([1, *[len(w) + 1 for w in words[:-1]]])
    ids, owner = [], []
    for bucket, good in grams(b):
        at = np.flatnonzero(good)
        ids.append(bucket[at])
        owner.append(np.searchsorted(starts, at + 1, side="right") - 1)
    ids_, owner_ = np.concatenate(ids), np.concatenate(owner)
    n = np.maximum(np.bincount(owner_, minlength=len(words)), 1)
    rng = np.random.default_rng(0)
    e, w, c = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    c[1] = np.log(np.average(share, weights=weight) + 1e-6)
    states = [[np.zeros_like(x), np.zeros_like(x)] for x in (e, w, c)]
    scale = weight / weight.sum()
    for step in range(1, epochs + 1):
        mean = np.column_stack([np.bincount(owner_, e[ids_, k], len(words)) for k in range(DIM)]) / n[:, None]
        z = mean @ w + c
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        d = (p - np.column_stack([1 - share, share])) * scale[:, None]
        back = (d @ w.T) / n[:, None]
        ge = np.column_stack([np.bincount(ids_, back[owner_, k], BUCKETS) for k in range(DIM)]) + decay * e / BUCKETS
        _adam(w, mean.T @ d + 1e-4 * w, states[1], step, rate)
        _adam(c, d.sum(0), states[2], step, rate)
        _adam(e, ge, states[0], step, rate)
    return e @ (w[:, 1] - w[:, 0]), float(c[1] - c[0])


def fit(texts: list[str | None], toxic: np.ndarray) -> Model:
    """Two thirds of the texts give the words' targets, the rest fits the pooling."""
    base = float(toxic.mean()) if len(toxic) else 0.5
    flat = Model(np.zeros(BUCKETS), 0.0, np.array([np.log((base + 1e-3) / (1 - base + 1e-3)), 0, 0, 0, 0]))
    if len(set(toxic.tolist())) < 2:
        return flat
    part = np.arange(len(texts)) % 3 == 0 if len(texts) >= 30 else np.zeros(len(texts), bool)
    seen: dict[bytes, list[int]] = {}
    for t, y, out in zip(texts, toxic, part):
        if not out:
            for w in set(_FOLD[np.frombuffer(folded(t), np.uint8)].tobytes().split()):
                seen.setdefault(w, [0, 0])[int(y)] += 1
    words = sorted(seen)
    own = np.array([seen[w] for w in words], float).reshape(-1, 2)
    if not words:
        return flat
    rows = toxic[~part] if (~part).any() else toxic
    own[:, 1] *= 0.1 / max(rows.mean(), 1e-6)  # as if a tenth of the documents were toxic
    own[:, 0] *= 0.9 / max(1 - rows.mean(), 1e-6)
    share = (own[:, 1] + 0.2) / (own.sum(1) + 2)
    weight, bias = train_words(words, share, np.minimum(own.sum(1), 30))
    model = Model(weight, bias, np.zeros(5))
    use = part if part.any() else ~part
    x, y = model.pooled([t for t, u in zip(texts, use) if u]), toxic[use].astype(float)
    model.pool = _logistic(x, y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 0.01) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (p - y) + ridge * beta
        h = (x.T * (p * (1 - p) + 1e-6)) @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        beta -= np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on ``sample`` labelled documents a class: those with the least hashes of their ids, each whole.

    An id that repeats counts once, with the first of its texts in order; it is toxic if one of its labels is."""
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    y = bounded_sample(y.select("i", F.col("y").cast("string").alias("y")), "y", ["i"], sample)
    chosen = F.broadcast(y.select("i", F.col("y").cast("int").alias("y")))  # at most 2 * sample rows
    got = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).join(chosen, "i").groupBy("i", "y").agg(F.min("t").alias("t")).collect()
    got.sort(key=lambda r: (str(r["i"]), r["t"] or ""))
    return fit([r["t"] for r in got], np.array([r["y"] for r in got], int))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, as it is, and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    out = map_texts(docs, [F.col(id_col).alias("id")], F.col(text_col), "score double", lambda: lambda texts: [shared.value.scores(texts)])
    return out.withColumnRenamed("id", id_col)
