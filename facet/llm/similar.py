"""Exact similarity of sets of word shingles, and candidates for it by min-wise bands.

``simhash.near_dedup`` uses this where it is asked for a similarity: at a Jaccard similarity of 0.8 two fingerprints
differ in some ten of their 64 bits, beyond what a pigeonhole join can probe, so that most such pairs
need other candidates.  A set's signature is the least value of each of BANDS * ROWS permutations; sets that agree in
all rows of a band are candidates, which at similarity s holds with chance 1 - (1 - s ** ROWS) ** BANDS: all but three in a
million at 0.8, fewer missed above.

Members of a bucket are first compared with its least member alone, and pairs within a bucket are formed only between members
that the links so far leave in different classes.  A bucket of over ``hot`` members is split into finer ones, by a second and
then a third band: a pair at 0.8 agrees in two bands but for five chances in 100,000, in three but for four in 10,000.
Before sets are fetched, a pair must agree in MATCHES of its signatures' low bytes, which a pair at 0.8 misses with a
chance below 1 in 10,000.  Every link is verified on the sets themselves, of which shingles are held as 64-bit hashes.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_texts

BANDS, ROWS = 32, 5
MATCHES = 108  # of BANDS * ROWS: 128 are expected at 0.8, with a deviation of 5
_CHUNK = 1 << 10
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RNG = np.random.default_rng(42)
_FLIP = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_ODD = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of a text's shingles, repeats included; a text shorter than a shingle is one."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = list(itertools.accumulate([len(w) + 1 for w in words]))
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a : z - 1], seed) for a, z in zip([0, *ends], ends[width - 1 :])], np.uint64)


def node_of(own: np.ndarray) -> int:
    """A name of a sorted set."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64))


def signature(own: np.ndarray) -> tuple[bytes, list[int]]:
    """The low bytes of a set's signature, and a key a band as a signed long."""
    low = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(own), _CHUNK):
        low = np.minimum(low, ((own[at : at + _CHUNK, None] ^ _FLIP) * _ODD).min(0))
    keys = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(low.reshape(BANDS, ROWS))]
    return (low >> np.uint64(32)).astype(np.uint8).tobytes(), np.array(keys, np.uint64).view(np.int64).tolist()


class Verifier:
    """Which pairs of sets are similar; ``texts`` has text_hash and t, ``nodes`` has node, text_hash, size and sign."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, width: int, least: float):
        self.texts, self.nodes, self.width, self.least = texts, nodes, width, least

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, items) of the given nodes."""
        wanted = nodes.join(self.nodes.select("node", "text_hash"), "node").select("text_hash")
        width = self.width

        def items(texts: list) -> list:
            own = [np.unique(hashes(t, width)) for t in texts]
            ends = np.cumsum([0, *map(len, own)])
            return [[node_of(o) for o in own], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(own).view(np.int64)))]

        found = self.texts.join(wanted, "text_hash", "left_semi")
        return map_texts(found, [], F.col("t"), "node bigint, items array<bigint>", lambda: items, rows=256).dropDuplicates(["node"])

    def links(self, pairs: DataFrame) -> DataFrame:
        """The similar ones of the pairs (a, b) of nodes."""
        side = lambda c, x: self.nodes.select(F.col("node").alias(c), F.col("size").alias("n" + x), F.col("sign").alias("s" + x))
        both = pairs.distinct().join(side("a", "x"), "a").where("a <> b").join(side("b", "y"), "b").where(F.least("nx", "ny") / F.greatest("nx", "ny") >= self.least)
        same = F.aggregate(F.sequence(F.lit(1), F.lit(BANDS * ROWS)), F.lit(0), lambda n, i: n + (F.substring("sx", i, F.lit(1)) == F.substring("sy", i, F.lit(1))).cast("int"))
        fit = durable(both.where(same >= MATCHES).select("a", "b"))
        sets = durable(self.sets(fit.select(F.col("a").alias("node")).union(fit.select("b")).distinct()))
        both = fit.join(sets.toDF("a", "p"), "a").join(sets.toDF("b", "q"), "b").withColumn("n", F.size(F.array_intersect("p", "q")))
        return durable(both.where(F.col("n") / (F.size("p") + F.size("q") - F.col("n")) >= self.least).select("a", "b"))


def buckets(nodes: DataFrame, hot: int) -> DataFrame:
    """(key, node): the members of each bucket of two or more; those of more than ``hot`` in finer ones."""
    rows = nodes.select("node", F.explode("keys").alias("key"))
    found = None
    for level in range(3):
        sizes = durable(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        big = sizes.where(F.col("n") > hot).select("key") if level < 2 else sizes.where("false")
        small = rows.join(sizes.where(F.col("n") <= hot).select("key") if level < 2 else sizes.select("key"), "key")
        found = small if found is None else found.unionByName(small)
        if not big.limit(1).count():
            break
        crowd = rows.join(big, "key").join(nodes.select("node", "keys"), "node")
        rows = crowd.select("node", "key", F.explode("keys").alias("k")).select("node", F.xxhash64("key", "k").alias("key"))
    return durable(found.distinct())
