"""Language ID with interpolated Kneser-Ney character models, one a language.

Texts become lower-cased letters, every run of other characters one space.  Each language's model
gives each character a probability after its last ``order - 1`` characters: absolute discounting at
the highest order, continuation counts below, interpolated down to a uniform floor.  The n-grams of
all languages share one sorted array of 64-bit hashes an order, with a row of log probabilities (and
one of back-off weights a context) by language; one binary search scores a position for all
languages, and only n-grams that no language has seen go on to the next lower order.

The prediction is the language with the least cross-entropy a character; the score is its posterior.
A document is rejected if that cross-entropy is above what texts of the language have: for each of several lengths, pieces of
documents that were not counted give a median and a 97 % quantile, and a text may be thrice as far above the median as
that (at least ``LEEWAY``: documents may quote other languages); below the shortest length the room widens as the root of the length shrinks.

The fit uses a bounded sample (``SAMPLE`` documents a language, the least hashes of their ids, each
whole) of the rows given for training; scoring covers every whole text.

Defined results: a text that is null or has no letter is ``und`` with score 0 and rejected; without
training rows every text is ``und``; ties go to the language first in code-point order; repeated
rows give a row each; texts of any length are read whole, in pieces of ``_CHUNK`` characters; an empty table gives an empty
result; kept columns pass through untouched, further ones are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_texts

SAMPLE = 400
ORDER = 4
LENGTHS = np.array([32, 64, 128, 256, 512, 1024])  # characters of the texts that calibrate the rejection
LEEWAY = 0.8  # nats a character above the median that are never rejected
UNKNOWN = "und"
_TURN = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 18
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """By code point: 1 for letters."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)], bool)
    return _letters


def codes(text: str) -> np.ndarray:
    """Code points of the folded text, with one space before, between and after its words; empty if it has no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    good = letters()[c]
    if not good.any():
        return np.zeros(0, np.uint32)
    keep = good.copy()
    keep[1:] |= good[:-1]  # the first character after a word stands for the space
    out = np.where(good, c, 32)[keep]
    return np.concatenate([[32], out, [] if out[-1] == 32 else [32]]).astype(np.uint32)


def grams(c: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams; the i-th starts at i."""
    h = np.zeros(max(0, len(c) - n + 1), np.uint64)
    for k in range(n):
        h = (h ^ c[k : k + len(h)].astype(np.uint64)) * _TURN
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Model:
    languages: list[str]
    order: int
    keys: list[np.ndarray]  # by order from 1 on: sorted hashes
    logp: list[np.ndarray]  # rows as keys, a column a language
    contexts: list[np.ndarray]  # by context length from 1 on
    backoff: list[np.ndarray]
    floor: np.ndarray
    limit: np.ndarray  # by language and length: median cross-entropy of its own texts, and what is allowed above

    def logs(self, c: np.ndarray) -> np.ndarray:
        """For each character but the first ``order - 1`` its log probabilities, a column a language."""
        return self._logs([grams(c, n)[self.order - n :] for n in range(1, self.order + 1)], [grams(c, n)[self.order - 1 - n :][: max(0, len(c) - self.order + 1)] for n in range(1, self.order)])

    def _logs(self, h: list[np.ndarray], ctx: list[np.ndarray]) -> np.ndarray:
        n = len(h)
        found, at = _find(self.keys[n - 1], h[-1])
        out = self.logp[n - 1][at]
        miss = np.flatnonzero(~found)
        if len(miss):
            if n == 1:
                out[miss] = self.floor
            else:
                known, where = _find(self.contexts[n - 2], ctx[n - 2][miss])
                out[miss] = np.where(known[:, None], self.backoff[n - 2][where], 0) + self._logs([x[miss] for x in h[:-1]], [x[miss] for x in ctx[: n - 2]])
        return out

    def entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean negative log probability by text and language, and the number of characters scored (0: no letter)."""
        sums, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        pad = np.full(self.order - 2, 32, np.uint32)
        held: list[np.ndarray] = []
        owner: list[int] = []
        room = 0

        def flush() -> None:
            nonlocal room
            if not held:
                return
            c = np.concatenate(held)
            starts = np.cumsum([0, *map(len, held[:-1])])
            logs = self.logs(c)
            for_each = np.add.reduceat(logs, starts, axis=0) if len(held) > 1 else logs.sum(0, keepdims=True)
            # the windows that reach from one piece into the next are not part of either
            for j in range(len(held) - 1):
                z = starts[j + 1]
                for_each[j] -= logs[z - self.order + 1 : z].sum(0)
            np.add.at(sums, owner, for_each)
            np.add.at(sizes, owner, [len(x) - self.order + 1 for x in held])
            held.clear()
            owner.clear()
            room = 0

        for i, t in enumerate(texts):
            c = codes(t) if t else pad[:0]
            if not len(c):
                continue
            c = np.concatenate([pad, c])
            for a in range(0, len(c) - self.order + 1, _CHUNK):
                piece = c[a : a + _CHUNK + self.order - 1]
                held.append(piece)
                owner.append(i)
                room += len(piece)
                if room >= _CHUNK:
                    flush()
        flush()
        return -sums / np.maximum(sizes, 1)[:, None], sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and whether it is rejected, by text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        ce, sizes = self.entropy(texts)
        best = ce.argmin(1)
        total = (ce - ce.min(1, keepdims=True)) * np.minimum(sizes, 200)[:, None]  # characters are not independent
        score = 1 / np.exp(-np.minimum(total, 700)).sum(1)
        at = np.searchsorted(LENGTHS, sizes, side="right") - 1
        middle, room = np.moveaxis(self.limit[best, np.maximum(at, 0)], -1, 0)
        rejected = ce.min(1) > middle + room * np.where(at < 0, np.sqrt(LENGTHS[0] / np.maximum(sizes, 1)), 1)
        none = sizes == 0
        return [UNKNOWN if z else self.languages[b] for z, b in zip(none, best)], np.where(none, 0, score), rejected | none


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return keys[at] == h, at


def _count(texts: list[str], order: int) -> list[dict[int, tuple[tuple[int, ...], int]]]:
    """By order from 1 on: the counts of n-grams, as {gram: count}."""
    out: list[dict] = [{} for _ in range(order)]
    for n in range(1, order + 1):
        own = out[n - 1]
        rows = []
        for t in texts:
            c = codes(t)
            if len(c):
                rows.append(np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(order - 2, 32, np.uint32), c]), order)[:, order - n :])
        if rows:
            grams_, counts = np.unique(np.concatenate(rows), axis=0, return_counts=True)
            own |= dict(zip(map(tuple, grams_.tolist()), counts.tolist()))
    return out


def kneser_ney(texts: list[str], order: int, alphabet: int) -> tuple[list[dict], list[dict], float]:
    """One language: by order, probabilities of its n-grams; by context length, back-off weights; the floor."""
    counts = _count(texts, order)
    for n in range(order - 1, 0, -1):  # below the highest order: by how many different characters it is preceded
        seen: dict = {}
        for g in counts[n]:
            seen[g[1:]] = seen.get(g[1:], 0) + 1
        counts[n - 1] = seen
    floor = 1.0 / alphabet
    probs: list[dict] = []
    weights: list[dict] = []
    for n in range(1, order + 1):
        own = counts[n - 1]
        ones, twos = sum(v == 1 for v in own.values()), sum(v == 2 for v in own.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        total: dict = {}
        kinds: dict = {}
        for g, v in own.items():
            total[g[:-1]] = total.get(g[:-1], 0) + v
            kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
        weight = {h: d * kinds[h] / total[h] for h in total}
        lower = probs[-1] if probs else None
        probs.append({g: (v - d) / total[g[:-1]] + weight[g[:-1]] * (floor if lower is None else lower[g[1:]]) for g, v in own.items()})
        weights.append(weight)
    return probs, weights[1:], weights[0].get((), 1.0) * floor


def _room(x: np.ndarray) -> float:
    """How far above the median a cross-entropy may be: thrice as far as nearly all of ``x`` are."""
    return max(LEEWAY, 3 * float(np.quantile(x, 0.97) - np.median(x)))


def fit(texts: dict[str, list[str]], order: int = ORDER) -> Model:
    """Four fifths of each language's texts are counted; the rest calibrates the rejection."""
    languages = sorted(k for k, v in texts.items() if any(len(codes(t)) for t in v))
    counted = {k: [t for i, t in enumerate(texts[k]) if i % 5 or len(texts[k]) < 10] for k in languages}
    alphabet = len(set().union(*(np.unique(codes(t)).tolist() for k in languages for t in counted[k]))) + 1 if languages else 2
    got = [kneser_ney(counted[k], order, alphabet) for k in languages]
    floor = np.log([g[2] for g in got]) if got else np.zeros(0)
    keys, logp, contexts, backoff = [], [], [], []

    def prob(k: int, g: tuple[int, ...]) -> float:
        if not g:
            return 1.0 / alphabet
        p = got[k][0][len(g) - 1].get(g)
        if p is not None:
            return p
        w = (got[k][1][len(g) - 2].get(g[:-1], 1.0)) if len(g) > 1 else np.exp(floor[k]) * alphabet
        return w * prob(k, g[1:])

    def table(rows: list[tuple[int, ...]], n: int, value) -> tuple[np.ndarray, np.ndarray]:
        if not rows:
            return np.zeros(1, np.uint64), np.zeros((1, len(languages)), np.float32)
        h = grams(np.array(rows, np.uint32).ravel(), n)[::n]
        by = np.argsort(h)
        v = np.log([[value(k, g) for k in range(len(languages))] for g in rows]).astype(np.float32)
        return h[by], v[by]

    for n in range(1, order + 1):
        a, b = table(sorted(set().union(*(g[0][n - 1] for g in got))), n, prob)
        keys.append(a)
        logp.append(b)
        if n < order:
            a, b = table(sorted(set().union(*(g[1][n - 1] for g in got))), n, lambda k, g, n=n: got[k][1][n - 1].get(g, 1.0))
            contexts.append(a)
            backoff.append(b)
    model = Model(languages, order, keys, logp, contexts, backoff, floor.astype(np.float32), np.zeros((len(languages), len(LENGTHS), 2)))
    for k, name in enumerate(languages):
        own = [t for i, t in enumerate(texts[name]) if not i % 5] if len(texts[name]) >= 10 else texts[name]
        seen = (0.0, 10.0)
        for j, n in enumerate(LENGTHS.tolist()):
            pieces = [t[a : a + n] for t in own for a in range(0, min(len(t) - n + 1, (4 if n <= 256 else 1) * n), n)]
            ce, sizes = model.entropy(pieces or [None])
            x = ce[sizes > n / 2, k]
            if len(x) >= 5:
                seen = np.median(x), _room(x)
            elif not j:  # short texts only: as they are
                ce, sizes = model.entropy(own)
                x = ce[sizes > 0, k]
                seen = np.median(x), _room(x)
            model.limit[k, j] = seen
    return model


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on ``sample`` documents a language (those with the least hash of their id), each whole."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("l"), F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    got = bounded_sample(rows, "l", ["i", "t"], sample).orderBy("l", "_rank").select("l", "t").collect()
    texts: dict[str, list[str]] = {}
    for r in got:
        texts.setdefault(r["l"], []).append(r["t"])
    return fit(texts)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (the id alone unless given), as they are, and lang_pred, score, rejected, of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by that of the sample
    names = keep if keep is not None else [id_col]
    kept = [F.col(c).alias(f"c{i}") for i, c in enumerate(names)]
    out = map_texts(docs, kept, F.col(text_col), "lang_pred string, score double, rejected boolean", lambda: shared.value.predict)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "lang_pred", "score", "rejected")
