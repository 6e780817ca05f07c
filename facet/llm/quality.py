"""Quality rules by a hashed n-gram log-likelihood ratio.

Base rules count what a text is made of (words, symbols, repeated lines, words in repeated windows).
The verdict on a text that passes them comes from two multinomials over hashed n-grams: one of
trusted documents (a bounded sample of labelled rows), one of the raw corpus (every document).  A
text's score is the mean log ratio of their probabilities over its n-grams, and every document is
held to one fixed threshold: below it a text looks less like trusted ones than like the rest.

N-grams are single words as they stand, and pairs of neighbouring shapes.  A shape is a word in which runs of four letters or
more become one sign (one for capitals, one for others) and runs of digits another, so that a pair tells how a text is
built: its short function words, punctuation and marks.  (README: figures of words, shapes and both.)

The threshold is fixed, and so is the weight of the prior: with few trusted n-grams no ratio can fall below the threshold, and
nothing is rejected beyond the base rules (below some 4,650) or only what is far off.

All of it is DataFrame expressions: one pass counts the corpus (combined on the map side into a table
of a fixed number of buckets), one pass scores it against that table held as a constant array.

Defined results: a null or empty text has no words and fails; without trusted rows nothing is
rejected beyond the base rules; repeated rows get a row each; an empty table gives an empty
result; a text is held as one array of its words and one of its windows, texts of any length are read whole; further
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, literal_doubles

BUCKETS = 1 << 14
PRIOR = 16_384.0
TRUSTED = 20_000  # labelled documents used at most
THRESHOLD = -0.25  # mean log ratio an n-gram
MIN_WORDS = 20
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+", -1), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of so many words found twice or more."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))

    def covered(h: Column) -> Column:
        def near(s: Column) -> Column:
            twice = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
            at = F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(twice(x, i), F.lit(False))), lambda x: x["i"]))
            reach = lambda p: F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1), x + window) - x))
            return let(at, lambda p: F.aggregate(reach(p), F.lit(0).cast("long"), lambda a, x: a + x))

        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), near)

    distinct = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(n <= window, F.lit(0).cast("long")).otherwise(distinct)


def base(words: Column, text: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def grams(text: Column) -> Column:
    """Buckets of a text's words and of its pairs of neighbouring shapes."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\p{Lu}{4,}", "W"), r"\p{L}{4,}", "w"), r"\p{N}+", "0")
    bucket = lambda *x: F.pmod(F.xxhash64(*x), F.lit(BUCKETS)).cast("int")
    words = F.transform(words_of(text), lambda x: bucket(x))
    pairs = let(F.split(shape, SPACE + "+", -1), lambda t: F.transform(t, lambda x, i: bucket(x, F.get(t, i + 1))))
    return F.concat(words, pairs)


def ratios(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, trusted: int) -> list[float]:
    """Log ratio of each bucket: trusted against raw.

    The trusted multinomial starts from PRIOR n-grams spread as in the raw corpus, so that what a small
    sample happens not to hold counts for little."""
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("i")).distinct()
    good = good.withColumn("part", F.pmod(F.xxhash64("i"), F.lit(64)))  # rank in parts: no single task sees all labels
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64("i", F.lit(1)), "i"))
    good = good.withColumn("r", rank).where(F.col("r") <= -(-trusted // 64)).select("i", F.lit(True).alias("good"))
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.join(F.broadcast(good), "i", "left").select(F.explode(grams(F.col("t"))).alias("b"), F.coalesce("good", F.lit(False)).cast("int").alias("y"))
    counts = rows.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect()  # BUCKETS rows at most
    raw, own = [1.0] * BUCKETS, [0] * BUCKETS
    for r in counts:
        raw[r["b"]] += r["n"]
        own[r["b"]] = r["y"]
    z, y = sum(raw), sum(own)
    return [math.log((k + PRIOR * n / z) / (y + PRIOR) / (n / z)) if y else 0.0 for k, n in zip(own, raw)]


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, trusted: int = TRUSTED) -> DataFrame:
    """id_col, the base counts, base_failed, score, kept of every document."""
    table = literal_doubles([round(x, 6) for x in ratios(docs, labels, id_col, text_col, label_col, trusted)])
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    counts = let(words_of(F.col("t")), lambda w: F.struct(*[c.alias(k) for k, c in base(w, F.col("t")).items()]))
    score = let(grams(F.col("t")), lambda g: F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.size(g))
    out = rows.select("id", counts.alias("c"), score.alias("score"))
    failed = (F.col("c.n_words") < MIN_WORDS) | (100 * F.col("c.n_repeat_words") > 30 * F.col("c.n_words"))
    out = out.select(F.col("id").alias(id_col), "c.*", failed.alias("base_failed"), "score")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
