"""Mixing sources to target weights by entropy balancing.

Each document gets a rate (expected copies) as close as can be, in Kullback-Leibler divergence, to
one copy each, under one token constraint a source (its rates times sizes sum to the source's
target) and a bound of ``most`` copies.  The solution is exponentially tilted,
``rate = min(most, exp(lambda_source * size / mean size))``; the convex dual in the lambdas is solved
by Newton iterations, each one distributed aggregation over the histogram of (source, size), which
is a sufficient statistic; a bracket guards the steps.  Rates are then rounded to whole copies:
documents of a source are taken from the longest to the shortest in classes of size, within a class
extra copies are spread evenly by a running sum of the rates' fractions, and what a class rounds too
little or too much is made up for by the next shorter class.

The driver holds a few numbers a source (the mixture's own definition has a weight for each);
nothing a document.

Defined results: texts of any length are counted whole; null or empty texts have size 0 and rate 1, and take nothing; a null source is a
source of its own, last; an empty table gives an empty result; reruns agree, since sums are exact decimals and ties are broken by a
hash of the id, then the id, and repeated rows (same id) are interchangeable; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, literal_rows, n_words, salted_rank

MOST = 2
_SMALL = 20_000  # sources up to which their table is broadcast
_TURN = 4.0  # width of a class of sizes, as a factor


def contract_weight(i: int) -> float:
    return (5.0, 2.0, 1.0)[i % 3]


def water_fill(sizes: list[float], weights: list[float], budget: float, most: float) -> list[float]:
    """Shares of budget by weight, none above most * size; the excess goes to the others by weight."""
    targets, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], budget
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w >= most * sizes[i]]
        if not over:
            for i in free:
                targets[i] = left * weights[i] / w
            break
        for i in over:
            targets[i] = float(most * sizes[i])
        left -= sum(targets[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return targets


def _with(df: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """``df`` joined with a table by source (``src``); broadcast only while it is small."""
    side = literal_rows(df.sparkSession, rows, schema)
    if len(rows) <= _SMALL:
        return df.join(F.broadcast(side), "src")
    d = df.withColumn("_s", F.pmod(F.xxhash64("size"), F.lit(16)))
    return d.join(side.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(15)))), ["src", "_s"]).drop("_s")


def _exact_sum(x: Column) -> Column:
    """A sum that does not depend on the order in which partitions arrive: reruns agree to the last bit."""
    return F.sum(x.cast("decimal(38,12)"))


def solve_tilts(hist: DataFrame, sizes: dict[str, float], counts: dict[str, int], targets: dict[str, float], most: float, tolerance: float = 1e-9, rounds: int = 60) -> dict[str, float]:
    """lambda of each source; hist has src, size, n."""
    mean = {s: sizes[s] / counts[s] for s in sizes}
    tilt = {s: 0.0 for s in sizes}
    low, high = {s: -math.inf for s in sizes}, {s: math.inf for s in sizes}
    active = {s for s in sizes if sizes[s] > 0 and targets[s] < most * sizes[s]}
    tilt |= {s: math.inf for s in sizes if sizes[s] > 0 and s not in active}
    for _ in range(rounds):
        if not active:
            break
        x = F.col("size") / F.col("mean")
        raw = F.exp(F.least(F.col("tilt") * x, F.lit(50.0)))
        got = _with(hist, [{"src": s, "tilt": tilt[s], "mean": mean[s]} for s in sorted(active)], "src:string,tilt:double,mean:double").groupBy("src").agg(
            _exact_sum(F.col("n") * F.col("size") * F.least(raw, F.lit(float(most)))).alias("g"), _exact_sum(F.when(raw < most, F.col("n") * F.col("size") * x * raw)).alias("h"),
        ).collect()
        for r in got:
            s, gap, slope = r["src"], targets[r["src"]] - float(r["g"]), float(r["h"] or 0)
            if abs(gap) <= tolerance * targets[s]:
                active.discard(s)
                continue
            low[s], high[s] = (tilt[s], high[s]) if gap > 0 else (low[s], tilt[s])
            step = tilt[s] + max(-3.0, min(3.0, gap / slope)) if slope else math.nan
            if not low[s] < step < high[s]:
                step = (low[s] + high[s]) / 2 if math.isfinite(low[s] + high[s]) else 2 * tilt[s] + math.copysign(1, gap)
            if step == tilt[s]:
                active.discard(s)
            tilt[s] = step
    return tilt


def _rounded(hist: DataFrame, info: dict[str, dict], most: float) -> list[dict]:
    """For each (source, class of sizes) what is added to its rates' fractions, longest class first."""
    top = hist.agg(F.max("size")).first()[0] or 0
    spans, high = [], float("inf")
    edge = float(top)
    while edge >= 1:
        edge /= _TURN
        spans.append((edge, high))
        high = edge
    carry = {s: 0.0 for s in info}
    out = []
    for k, (a, z) in enumerate(spans):
        here = hist.where((F.col("size") > a) & (F.col("size") <= z) & (F.col("size") > 0))
        words = {r["src"]: r for r in here.groupBy("src").agg(F.sum(F.col("n") * F.col("size")).alias("w"), _exact_sum(F.col("n") * F.col("size") * F.col("rate")).alias("e")).collect()}
        words = {s: {"w": r["w"], "e": float(r["e"])} for s, r in words.items()}
        nudge = {s: max(-r["e"] / r["w"], min(most - r["e"] / r["w"], carry[s] / r["w"])) for s, r in words.items()}
        out += [{"src": s, "k": k, "nudge": v} for s, v in nudge.items()]
        if not nudge:
            continue
        cells = extra_cells(_with(here, [{"src": s, "nudge": v} for s, v in nudge.items()], "src:string,nudge:double").withColumn("k", F.lit(k)), most)
        taken = {r["src"]: r["t"] for r in cells.groupBy("src").agg(F.sum(F.col("size") * (F.col("n") * F.col("base") + F.floor(F.col("f1")) - F.floor(F.col("f0")))).alias("t")).collect()}
        for s, r in words.items():
            carry[s] += r["e"] - taken[s]
    return out, [a for a, _ in spans]


def extra_cells(cells: DataFrame, most: float) -> DataFrame:
    """Cells (src, k, size, n, rate, nudge) with base copies, the fraction f, and its running sum before (f0) and after (f1)."""
    r = F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.col("rate") + F.col("nudge")))
    c = cells.withColumn("r", r).withColumn("base", F.floor("r")).withColumn("f", F.col("r") - F.col("base"))
    w = Window.partitionBy("src", "k").orderBy(F.desc("size"))  # distinct sizes of a class, not documents
    run = F.coalesce(F.sum(F.col("f") * F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + 0.5
    return c.withColumn("f0", run).withColumn("f1", F.col("f0") + F.col("f") * F.col("n"))


def mix_sources(
    docs: DataFrame, weight: Callable[[int], float] = contract_weight, share: float = 1.5, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """id_col, size, source_size, target, rate, copies, taken; weight(i) is that of the i-th source by code point, null last."""
    src = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    rows = durable(docs.select(F.col(id_col).alias("id"), src.alias("src"), n_words(F.col(text_col)).alias("size")))
    hist = durable(rows.groupBy("src", "size").agg(F.count(F.lit(1)).alias("n")))
    got = hist.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("w"), F.sum("n").alias("n")).collect()
    if not got:
        return rows.select(F.col("id").alias(id_col), "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("taken"))
    names = sorted((r["src"] for r in got), key=lambda s: (s[0] == "n", s))
    sizes, counts = {r["src"]: r["w"] for r in got}, {r["src"]: r["n"] for r in got}
    targets = dict(zip(names, water_fill([sizes[s] for s in names], [weight(i) for i in range(len(names))], share * sum(sizes.values()), most)))
    tilt = solve_tilts(hist, sizes, counts, targets, most)
    info = {s: {"src": s, "source_size": sizes[s], "target": targets[s], "tilt": min(tilt[s], 1e300), "mean": max(sizes[s] / counts[s], 1e-300)} for s in names}
    schema = "src:string,source_size:bigint,target:double,tilt:double,mean:double"
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("tilt") >= 1e300, F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0)))))
    hist = durable(_with(hist, list(info.values()), schema).withColumn("rate", rate))
    nudges, edges = _rounded(hist, info, most)
    k = F.lit(0)
    for e in edges[:-1]:
        k = k + (F.col("size") <= e).cast("int")
    cells = hist.withColumn("k", k)
    if nudges:
        by = literal_rows(docs.sparkSession, nudges, "src:string,k:int,nudge:double")
        cells = cells.join(F.broadcast(by) if len(nudges) <= _SMALL else by, ["src", "k"], "left")
    else:
        cells = cells.withColumn("nudge", F.lit(0.0))
    cells = extra_cells(cells.withColumn("nudge", F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.coalesce("nudge", F.lit(0.0)))), most)
    cells = cells.select("src", "size", "source_size", "target", "rate", "base", "f", "f0", "f1", "n")
    ranked = salted_rank(rows, ["src", "size"], ["id"], "rank").withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(16)))
    spread = cells.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(15))))  # a cell may be hot
    i = F.col("rank")
    upto = lambda j: F.floor(F.when(j == F.col("n"), F.col("f1")).otherwise(F.col("f0") + F.col("f") * j))
    copies = F.least(F.lit(int(most)), (F.col("base") + upto(i + 1) - upto(i))).cast("long")
    out = ranked.join(spread, ["src", "size", "_s"]).withColumn("copies", copies)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
