"""SimHash near-dedup by a generalised pigeonhole join.

A text's words (ASCII letters lower-cased) give word shingles; a bit of the 64-bit fingerprint is set
if it is set in over half of the shingles' XXH64 hashes.  Fingerprints that differ in few bits link
their documents, and a document's class is the connected component it lies in.

The join works on distinct fingerprints (copies collapse first).  The 64 bits are grouped, correlated
bits together, into m parts.  If two fingerprints differ in at most t bits, then for any thresholds
t_i >= -1 with sum t - m + 1 some part differs in at most t_i bits (-1: the part is not used).  The
m and the thresholds are those for which a dynamic programme finds the least estimated work (probes
plus candidates); the estimates come from the pairs of a bounded sample of fingerprints and only
steer cost: every link is found under any choice.  Each fingerprint probes a part with all values
within its threshold; candidates are verified on all bits.

Values shared by more than ``hot`` fingerprints are split: in such a bucket the remaining bits are
again cut by the pigeonhole principle and joined on the finer keys, up to three times.

A dense class is never written out as all its pairs: each bucket's members are linked with its least member first, and
then only pairs that those links leave in different classes are made.

Defined results: null and empty texts have fingerprint zero, linked like any other (by similarity: their sets are equal);
a text of any length is read whole, its hashes ``_CHUNK`` at a time; repeated rows and ids give a row each, ids of any type
pass through untouched, and a null id names a class only where all its ids are null; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach_group, durable, map_texts, salted_join
from .components import components
from .similar import _LOWER, Verifier, buckets, hashes, node_of, signature

BITS = 64
SAMPLE = 2048
_BLANK = " \t\n\x0b\f\r"
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = (np.arange(8, dtype=np.int64) * 256)[None, :]
_CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of a text, over all its shingles, in bounded memory beyond its words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = max(1, len(words) - width + 1)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate([len(w) + 1 for w in words]))
    starts, ends = [0, *ends[: n - 1]], ends[min(width, len(words)) - 1 :]
    h = xxhash.xxh64_intdigest
    return majority(np.array([h(joined[a : z - 1], seed) for a, z in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])], np.uint64) for at in range(0, n, _CHUNK))


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of the hashes."""
    counts, n = np.zeros((8, 256), np.int64), 0
    for own in parts:
        counts += np.bincount((own.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256)
        n += len(own)
    bits = (counts @ _BITS_OF_BYTE).ravel() * 2 > n
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long.  Ids pass through untouched."""
    make = lambda: lambda texts: [np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)]
    return map_texts(docs, [F.col(id_col).alias("id")], F.col(text_col), "fp bigint", make)


# ---- the plan of the join


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of nearly equal size, each grown from a seed by the strongest correlation."""
    if len(sample) > 1:
        bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
        z = bits - bits.mean(0)
        norm = np.sqrt((z * z).sum(0))
        corr = np.abs(z.T @ z) / np.maximum(np.outer(norm, norm), 1e-9)
    else:
        corr = np.zeros((BITS, BITS))
    left, groups = set(range(BITS)), []
    for p in range(parts):
        room = BITS // parts + (p < BITS % parts)
        rest = sorted(left)
        group = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        left.discard(group[0])
        while len(group) < room:
            b = max(sorted(left), key=lambda b: (corr[b, group].sum(), -b))
            group.append(b)
            left.discard(b)
        groups.append(sorted(group))
    return groups


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def allot(costs: list[list[float]], budget: int) -> list[int]:
    """Thresholds from -1 on, one a part, with sum ``budget`` and least total cost; costs[i][t + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, picks) in best.items():
            for t in range(-1, len(own) - 1):
                key, value = total + t, (cost + own[t + 1], [*picks, t])
                if key not in new or value < new[key]:
                    new[key] = value
        best = new
    return best[budget][1]


def plan(sample: np.ndarray, rows: int, distance: int) -> list[tuple[int, int]]:
    """(mask of the part's bits, threshold) of each used part: the choice with the least estimated work a row."""
    options = []
    few = sample[:512]
    pairs = (few[:, None] ^ few[None, :])[np.triu_indices(len(few), 1)]
    for parts in range(1, distance + 3):
        masks = [mask_of(g) for g in group_bits(sample, parts)]
        costs = []
        for m in masks:
            size = m.bit_count()
            gap = np.bitwise_count(pairs & np.uint64(m)) if len(pairs) else np.zeros(0, int)
            own = [0.0]
            for t in range(distance + 1):
                probes = sum(_choose(size, k) for k in range(t + 1))
                blind = probes / 2.0**size  # what independent fair bits would give: a floor for what the sample can't see
                own.append(probes + rows * max(blind, float((gap <= t).mean()) if len(gap) else 0.0))
            costs.append(own)
        picks = allot(costs, distance - parts + 1)
        work = sum(c[t + 1] for c, t in zip(costs, picks))
        options.append((work, [(m, t) for m, t in zip(masks, picks) if t >= 0]))
    return min(options, key=lambda o: o[0])[1]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _split(mask: int, parts: int) -> list[int]:
    bits = [b for b in range(BITS) if mask >> b & 1]
    return [mask_of(bits[i::parts]) for i in range(parts)]


def _keys(fp: Column, plan_: list[tuple[int, int]], probe: bool) -> Column:
    """An array of (part, key): of the part's own value, or of all values within its threshold."""
    out = []
    for i, (m, t) in enumerate(plan_):
        bits = [b for b in range(BITS) if m >> b & 1]
        flips = [sum(1 << b for b in c) for k in range(t + 1 if probe else 1) for c in itertools.combinations(bits, k)]
        value = fp.bitwiseAND(F.lit(_signed(m)))
        if len(flips) == 1:
            keys = F.array(F.xxhash64(F.lit(i), value))
        else:
            masks = F.from_json(F.lit("[" + ",".join(str(_signed(f)) for f in flips) + "]"), "array<bigint>")
            keys = F.transform(masks, lambda f: F.xxhash64(F.lit(i), value.bitwiseXOR(f)))
        out.append(F.transform(keys, lambda k: F.struct(F.lit(i).alias("path"), k.alias("key"))))
    return F.concat(*out)


def links(distinct: DataFrame, distance: int, plan_: list[tuple[int, int]], hot: int = 4096, roots: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints (column fp) that differ in at most ``distance`` bits.

    Given ``roots`` (node, root), only pairs whose roots differ; a fingerprint without a row is its own root."""
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    near = (F.col("a") < F.col("b")) & close
    if roots is None:
        distinct = distinct.select("fp", F.lit(None).cast("bigint").alias("root"))
    else:
        distinct = distinct.select("fp").join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))
        near = near & (F.col("ra") != F.col("rb"))
    index = distinct.select(F.col("fp").alias("b"), F.col("root").alias("rb"), F.explode(_keys(F.col("fp"), plan_, False)).alias("k")).select("b", "rb", "k.*")
    exact = all(t == 0 for _, t in plan_)
    probe = index.withColumnsRenamed({"b": "a", "rb": "ra"}) if exact else distinct.select(F.col("fp").alias("a"), F.col("root").alias("ra"), F.explode(_keys(F.col("fp"), plan_, True)).alias("k")).select("a", "ra", "k.*")
    left = {i: (1 << BITS) - 1 - m for i, (m, _) in enumerate(plan_)}  # by path: the bits not yet used
    found = None
    for level in range(4):
        big = durable(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("key")) if level < 3 else None
        done = big is None or not big.limit(1).count()
        cold = (probe, index) if done else (probe.join(big, "key", "left_anti"), index.join(big, "key", "left_anti"))
        pairs = cold[0].join(cold[1].drop("path"), "key").where(near).select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        if done:
            break
        subs = {p: _split(rest, distance + 1) for p, rest in left.items()}
        order = sorted(subs)
        table = F.from_json(F.lit(str([[_signed(m) for m in subs[p]] for p in order])), "array<array<bigint>>")
        back = {p: i for i, p in enumerate(order)}
        at = F.from_json(F.lit(str([back.get(p, 0) for p in range(max(order) + 1)])), "array<int>")

        def finer(side: DataFrame, c: str, r: str) -> DataFrame:
            masks = F.element_at(table, F.element_at(at, F.col("path") + 1) + 1)
            cut = F.transform(masks, lambda m, j: F.struct((F.col("path") * (distance + 1) + j).alias("path"), F.xxhash64("key", j, F.col(c).bitwiseAND(m)).alias("key")))
            return side.join(big, "key", "left_semi").select(c, r, F.explode(cut).alias("k")).select(c, r, "k.*")

        probe, index = finer(probe, "a", "ra"), finer(index, "b", "rb")
        left = {p * (distance + 1) + j: left[p] & ~m for p in order for j, m in enumerate(subs[p])}
    return found.distinct()


def star_links(distinct: DataFrame, distance: int, plan_: list[tuple[int, int]]) -> DataFrame:
    """(a, b), a < b: of each bucket the links of its members with its least member, a row a member at most."""
    index = distinct.select("fp", F.explode(_keys(F.col("fp"), plan_, False)).alias("k")).select("fp", "k.key")
    heads = index.groupBy("key").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    pairs = index.join(heads, "key").where((F.col("a") < F.col("fp")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= distance))
    return pairs.select("a", F.col("fp").alias("b")).distinct()


def linked(distinct: DataFrame, distance: int, plan_: list[tuple[int, int]], hot: int = 4096) -> DataFrame:
    """(node, root) as of ``components`` over all links, without making all pairs of a dense class.

    Each bucket's members are first linked with its least member alone; then only pairs that those links leave
    in different classes are made, which changes no class."""
    stars = durable(star_links(distinct, distance, plan_))
    if not stars.limit(1).count():
        return components(links(distinct, distance, plan_, hot))
    rest = durable(links(distinct, distance, plan_, hot, components(stars)))
    return components(stars.unionByName(rest))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3, hot: int = 4096, least: float | None = None) -> DataFrame:
    """One row a document: id_col, fingerprint (hex), component_id (the least id reachable).

    With ``least``, fingerprints only propose: texts are linked if their sets of shingles have that Jaccard similarity or more,
    verified exactly, and ``similar`` adds the candidates that no fingerprint join can reach."""
    numbered = lambda d: durable(d.withColumn("rid", F.monotonically_increasing_id()))
    if least is None:
        rows = numbered(fingerprints(docs, id_col, text_col, width))
        distinct = durable(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("node", F.col("fp")))
        roots = linked(distinct, distance, plan_of(distinct, distance), hot)
    else:
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).withColumn("text_hash", F.xxhash64("t"))
        rows = numbered(_sets(texts, width))
        distinct = durable(rows.groupBy("node").agg(F.min("id").alias("first"), F.min("text_hash").alias("text_hash"), F.min("fp").alias("fp"), F.first("size").alias("size"), F.first("sign").alias("sign"), F.first("keys").alias("keys")))
        roots = similar_roots(texts, distinct, width, distance, least, hot)
    nodes = durable(distinct.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    classes = attach_group(nodes, ["root"], ["node"], [F.min("first").alias("least")], [F.min("least").alias("component_id")])
    name = "fp" if least is None else "node"
    out = salted_join(rows.select("id", "rid", "fp", F.col(name).alias("node")), classes.select("node", "component_id"), ["node"], ["rid"])
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(id, text_hash, node, fp, size, sign, keys): node names the text's set of shingles."""

    def work(batch: list) -> list:
        out = []
        for t in batch:
            h = hashes(t, width)
            own = np.unique(h)
            out.append((node_of(own), _signed(majority([h]) if (t or "").strip(_BLANK) else 0), len(own), *signature(own)))
        return list(map(list, zip(*out))) if out else [[]] * 5

    return map_texts(texts, [F.col("id"), F.col("text_hash")], F.col("t"), "node bigint, fp bigint, size int, sign binary, keys array<bigint>", lambda: work)


def similar_roots(texts: DataFrame, nodes: DataFrame, width: int, distance: int, least: float, hot: int) -> DataFrame:
    """(node, root) as of ``components`` over all links by similarity."""
    verify = Verifier(texts, nodes, width, least)
    fps = durable(nodes.groupBy("fp").agg(F.min("node").alias("node")))
    near = linked(fps, distance, plan_of(fps, distance), hot)
    heads = fps.join(near, fps.fp == near.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))
    heads = heads.join(fps.toDF("root", "head"), "root").select("fp", "head")
    close = nodes.select("node", "fp").join(heads, "fp").select(F.col("node").alias("a"), F.col("head").alias("b"))
    members = buckets(nodes, hot)
    stars = members.join(members.groupBy("key").agg(F.min("node").alias("head")), "key").select(F.col("node").alias("a"), F.col("head").alias("b"))
    first = verify.links(close.union(stars).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    known = durable(members.join(components(first), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    mixed = known.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    left = durable(known.join(mixed, "key"))
    pairs = left.toDF("key", "a", "r").join(left.toDF("key", "b", "s"), "key").where("a < b AND r <> s").select("a", "b")
    return components(first.union(verify.links(pairs)))


def plan_of(distinct: DataFrame, distance: int) -> list[tuple[int, int]]:
    """The plan for a table of distinct fingerprints (column fp), by a bounded sample of them."""
    got = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    return plan(np.array([r["fp"] for r in got], np.int64).view(np.uint64), distinct.count(), distance)
