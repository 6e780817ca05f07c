"""Full-text (BM25), vector and hybrid search, composed of built-in expressions.

BM25 needs the number of documents, their mean length and each query term's document frequency: one
aggregation without a shuffle of rows.  Scoring is a projection over the same scan: nothing is
exploded, and no posting list is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

K1, B = 1.2, 0.75
_STOP = {
    "english": "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with",
    "french": "au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous",
    "german": "aber als am an auch auf aus bei bin bis bist da dadurch daher das daß dass dein deine dem den der des die dies du ein eine einem einen einer es für hatte ich ihr im in ist ja jede mein mit nach nicht noch nun nur ob oder sich sie sind so und von vor war was wenn wer wie wir zu zum zur",
    "spanish": "a al ante con de del desde donde el ella en entre es esta este la las lo los más me mi muy no o para pero por que se sin sobre su sus un una y ya yo",
}


@dataclass(frozen=True)
class Analyzer:
    """How text becomes terms; ``tokenizer`` is (standard), (whitespace), (ngram, least, most), (pattern, regex) or (keyword)."""

    tokenizer: tuple = ("standard",)
    filters: tuple[tuple, ...] = (("lowercase",),)

    def smooth(self, text: Column) -> Column:
        """The text as the tokenizer sees it."""
        c = F.coalesce(text.cast("string"), F.lit(""))
        own = {f[0] for f in self.filters}
        if "lowercase" in own:
            c = F.lower(c)
        return folded(c) if "ascii_folding" in own else c

    def may_have(self, text: Column, term: str) -> Column:
        """False only where the term is surely absent: a term is a piece of the smooth text, unless it is a stem."""
        return F.lit(True) if any(f[0] == "stemmer" for f in self.filters) else F.contains(self.smooth(text), F.lit(term))

    def terms(self, text: Column) -> Column:
        """An array of terms; null text has none."""
        c = self.smooth(text)
        own = {f[0]: f[1:] for f in self.filters}
        form = self.tokenizer[0]
        if form == "standard":
            t = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+)"), 1)
        elif form == "whitespace":
            t = F.filter(F.split(c, r"\s+"), lambda x: x != "")
        elif form == "pattern":
            t = F.filter(F.split(c, self.tokenizer[1]), lambda x: x != "")
        elif form == "keyword":
            t = F.filter(F.array(c), lambda x: x != "")
        elif form == "ngram":
            low, high = self.tokenizer[1:]

            def pieces(chars: Column) -> Column:
                some = lambda k: F.transform(F.slice(chars, F.lit(1), F.size(chars) - (k - 1)), lambda x, i: F.concat(*[F.get(chars, i + j) for j in range(k)]))
                return F.concat(*[F.when(F.size(chars) >= k, some(k)).otherwise(F.array().cast("array<string>")) for k in range(low, high + 1)])

            # characters are taken apart once: a substring by place would walk the text from its start each time
            t = F.get(F.transform(F.array(F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))), pieces), F.lit(0))
        else:
            raise ValueError(f"unknown tokenizer {form}")
        if "stopwords" in own:
            stop = _STOP.get(own["stopwords"][0], "").split()
            t = F.filter(t, lambda x: ~x.isin(stop)) if stop else t
        if "stemmer" in own and own["stemmer"][0] in STEMMED:
            t = _stem_all()(t)
        if "length" in own:
            a, z = own["length"]
            t = F.filter(t, lambda x: (F.length(x) >= a) & (F.length(x) <= z))
        return t

    def of(self, text: str) -> list[str]:
        """The terms of a constant, by the same rules (see tests: equal to ``terms``)."""
        own = {f[0]: f[1:] for f in self.filters}
        if "lowercase" in own:
            text = text.lower()
        if "ascii_folding" in own:
            text = text.translate(_FOLD)
        form = self.tokenizer[0]
        if form == "standard":
            out = ["".join(x) for x in re.findall(r"((?:[^\W_])+)", text)]
        elif form == "whitespace":
            out = text.split()
        elif form == "pattern":
            out = [x for x in re.split(self.tokenizer[1], text) if x]
        elif form == "keyword":
            out = [text] if text else []
        else:
            low, high = self.tokenizer[1:]
            out = [text[i : i + k] for k in range(low, high + 1) for i in range(len(text) - k + 1)]
        if "stopwords" in own:
            stop = set(_STOP.get(own["stopwords"][0], "").split())
            out = [x for x in out if x not in stop]
        if "stemmer" in own and own["stemmer"][0] in STEMMED:
            out = [stem(x) for x in out]
        if "length" in own:
            out = [x for x in out if own["length"][0] <= len(x) <= own["length"][1]]
        return out


_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
_FOLD = str.maketrans(_ACCENTED, _PLAIN)


def folded(c: Column) -> Column:
    return F.translate(c, _ACCENTED, _PLAIN)


STANDARD = Analyzer()
ONE_TASK = 100_000  # rows of a list that are ranked in one task
STEMMED = ("english", "porter")


# ---- an English stemmer (Porter, 1980)

_V = "[aeiouy]"
_MEASURE = re.compile(r"[aeiou]+[^aeiou]+")


def _kinds(w: str) -> str:
    """Each letter as v(owel) or c(onsonant); y after a consonant is a vowel."""
    out = ""
    for i, x in enumerate(w):
        out += "v" if x in "aeiou" or x == "y" and i and out[-1] == "c" else "c"
    return out


def _m(w: str) -> int:
    return len(re.findall("v+c+", _kinds(w)))


def _short(w: str) -> bool:
    k = _kinds(w)
    return len(w) > 2 and k[-3:] == "cvc" and w[-1] not in "wxy"


_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def stem(w: str) -> str:
    if len(w) < 3 or not w.isascii():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _m(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if "v" in _kinds(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and _kinds(w)[-1] == "c" and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _m(w) == 1 and _short(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in _kinds(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for pair in sorted(table.split(), key=len, reverse=True):
            end, new = pair.split(":")
            if w.endswith(end):
                if _m(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _m(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e") and (_m(w[:-1]) > 1 or _m(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _m(w[:-1]) > 1:
        w = w[:-1]
    return w


def _stem_all():
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}
        for s in batches:
            if len(known) > 500_000:
                known.clear()
            yield s.map(lambda ws: [known.get(w) or known.setdefault(w, stem(w)) for w in ws])

    return run


# ---- counts of terms

AT_ONCE = 1 << 18  # terms, or characters of n-grams, that are counted together; a longer text is counted alone


def term_counts(df: DataFrame, key: str, text: str, analyzer: Analyzer = STANDARD) -> DataFrame:
    """How often each term occurs in the texts of each key: (key, term, n).

    A text's terms are counted where it is read, so no terms are shuffled but those of keys that several rows
    have.  Which keys those are is found by a job of its own, over the keys alone.
    """
    low, high = analyzer.tokenizer[1:] if analyzer.tokenizer[0] == "ngram" else (0, 0)
    grams = 0 < low <= high and not {f[0] for f in analyzer.filters} - {"lowercase", "ascii_folding"}
    counted = _counted(_gram_counts(low, high) if grams else _list_counts, grams)
    cut = df.select(F.col(key), (analyzer.smooth(F.col(text)) if grams else analyzer.terms(F.col(text))).alias("__t"))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])
    again = df.groupBy(F.col(key).alias("__again")).agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1").select("__again")
    several = again.count()
    if not several:
        return cut.mapInArrow(counted, schema)
    again = F.broadcast(again) if several <= ONE_TASK else again
    same = cut[key].eqNullSafe(again["__again"])
    parts = cut.join(again, same, "left_semi").mapInArrow(counted, schema)
    return cut.join(again, same, "left_anti").mapInArrow(counted, schema).unionByName(parts.groupBy(key, "term").agg(F.sum("n").alias("n")))


#: Of rows: the row, the term and the number of each term of each row, in pieces.
_Counts = Callable[[pa.Array], Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]]


def _counted(counts: _Counts, texts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = batch.columns
            sizes = (pc.binary_length(values) if texts else pc.list_value_length(values)).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            a = 0
            while a < len(values):
                z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + AT_ONCE, "right")))
                for row, terms, n in counts(values.slice(a, z - a)):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(row + a)), terms, pa.array(n)], [batch.schema.names[0], "term", "n"])
                a = z

    return run


def _runs(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The different keys and how often each occurs, in pieces."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    n = np.diff(starts, append=len(keys))
    for a in range(0, len(starts), AT_ONCE):
        yield keys[starts[a : a + AT_ONCE]], n[a : a + AT_ONCE]


def _list_counts(lists: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    coded = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    size = max(1, len(coded.dictionary))
    for keys, n in _runs(row * size + coded.indices.to_numpy(zero_copy_only=False)):
        yield keys // size, coded.dictionary.take(pa.array(keys % size)), n


def _strings(chars: np.ndarray) -> pa.Array:
    """The rows of code points as strings."""
    widths = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
    offsets = np.concatenate([[0], np.cumsum(widths.sum(axis=1))]).astype(np.int32)
    data = chars.astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(chars), pa.py_buffer(offsets), pa.py_buffer(data))


def _gram_counts(low: int, high: int) -> _Counts:
    def run(values: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
        texts = [b.decode("utf-8", "replace") for b in values.cast(pa.binary()).to_pylist()]
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        alphabet = np.unique(chars)
        codes = np.searchsorted(alphabet, chars)
        size = max(1, len(alphabet))
        for k in range(low, high + 1):
            if len(texts) * size**k >= 1 << 63:
                yield from _long_grams(texts, k)
                continue
            last = max(0, len(chars) - k + 1)
            keys = row[:last]
            for j in range(k):
                keys = keys * size + codes[j : j + last]
            for keys, n in _runs(keys[row[:last] == row[k - 1 :]]):
                piece = np.empty((len(keys), k), np.uint32)
                for j in reversed(range(k)):
                    keys, at = np.divmod(keys, size)
                    piece[:, j] = alphabet[at]
                yield keys, _strings(piece), n

    return run


def _long_grams(texts: list[str], k: int) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """N-grams that with their row don't fit into 63 bits."""
    for i, t in enumerate(texts):
        if found := Counter(t[j : j + k] for j in range(len(t) - k + 1)):
            yield np.full(len(found), i), pa.array(found.keys(), pa.string()), np.fromiter(found.values(), np.int64, len(found))


# ---- BM25


@dataclass(frozen=True)
class Clause:
    """A term or a phrase (several terms); must: required (True), forbidden (False) or optional (None)."""

    terms: tuple[str, ...]
    must: bool | None = None
    field: str | None = None


def read_query(text: str, analyzer: Analyzer) -> list[Clause]:
    """Bare words are optional; ``+w`` and AND require, ``-w`` and NOT forbid, ``"a b"`` is a phrase, ``f:w`` names a field."""
    out: list[Clause] = []
    must: bool | None = None
    last_and = False
    for sign, name, quoted, word in re.findall(r'([+-]?)(?:(\w+):)?(?:"([^"]*)"|([^\s"]+))', text):
        if word in ("AND", "OR", "NOT") and not sign and not name:
            if word == "AND":
                last_and = True
                if out and out[-1].must is None:
                    out[-1] = Clause(out[-1].terms, True, out[-1].field)
            elif word == "NOT":
                must = False
            continue
        terms = analyzer.of(quoted or word)
        want = True if sign == "+" else False if sign == "-" else must if must is not None else True if last_and else None
        must, last_and = None, False
        if not terms:
            continue
        groups = [terms] if quoted else [[t] for t in terms]
        out += [Clause(tuple(g), want, name or None) for g in groups]
    return out


def _frequency(terms: Column, clause: Clause) -> Column:
    if len(clause.terms) == 1:
        return F.size(F.filter(terms, lambda x: x == clause.terms[0]))
    # the terms are bound once, not computed anew at each place
    follows = lambda t, i: reduce(lambda a, b: a & b, [F.coalesce(F.get(t, i + j) == w, F.lit(False)) for j, w in enumerate(clause.terms)])
    found = F.transform(F.array(terms), lambda t: F.size(F.filter(F.transform(t, lambda x, i: i), lambda i: follows(t, i))))
    return F.get(found, F.lit(0))


def text_of(df: DataFrame, field: str) -> Column:
    t = df.select(F.col(field)).schema[0].dataType
    return F.concat_ws(" ", F.col(field)) if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType) else F.col(field).cast("string") if not isinstance(t, T.BinaryType) else F.lit("")


def bm25(df: DataFrame, fields: Sequence[tuple[str, float]], query: str, analyzer: Analyzer = STANDARD, score: str = "$score", tie: float | None = None) -> DataFrame:
    """The rows that match ``query`` with their score: the boosted sum over fields, or with ``tie`` the best field plus tie times the rest."""
    clauses = read_query(query, analyzer)
    wanted = [c for c in clauses if c.must is not False]
    if not wanted:
        return df.withColumn(score, F.lit(0.0)).where(F.lit(False))
    names = [f for f, _ in fields]
    texts = [text_of(df, f) for f in names]
    tf = {(i, j): f"__f{i}_{j}" for i, f in enumerate(names) for j, c in enumerate(clauses) if c.field in (None, f)}
    surely = {(i, j): reduce(lambda a, b: a & b, [analyzer.may_have(texts[i], t) for t in clauses[j].terms]) for i, j in tf}

    def counted(d: DataFrame) -> DataFrame:
        for i in range(len(names)):
            d = d.withColumn(f"__t{i}", analyzer.terms(texts[i]))
        for i in range(len(names)):
            d = d.withColumn(f"__n{i}", F.size(f"__t{i}"))
        for (i, j), c in tf.items():
            d = d.withColumn(c, F.when(surely[i, j], _frequency(F.col(f"__t{i}"), clauses[j])).otherwise(0))
        return d

    stats = []
    for i, f in enumerate(names):
        stats += [F.count(F.col(f)).alias(f"__docs{i}"), F.avg(F.when(F.col(f).isNotNull(), F.col(f"__n{i}"))).alias(f"__avg{i}")]
    stats += [F.sum((F.col(c) > 0).cast("long")).alias(f"__df{i}_{j}") for (i, j), c in tf.items()]
    totals = counted(df).agg(*stats)
    # only rows that may match are cut into terms a second time
    base = counted(df.where(reduce(lambda a, b: a | b, [c for (i, j), c in surely.items() if clauses[j].must is not False], F.lit(False))))
    hit = lambda j: reduce(lambda a, b: a | b, [F.col(tf[i, j]) > 0 for i in range(len(names)) if (i, j) in tf], F.lit(False))
    optional = [j for j, c in enumerate(clauses) if c.must is None]
    required = [j for j, c in enumerate(clauses) if c.must is True]
    forbidden = [j for j, c in enumerate(clauses) if c.must is False]
    keep = reduce(lambda a, b: a & b, [hit(j) for j in required], F.lit(True)) if required else reduce(lambda a, b: a | b, [hit(j) for j in optional], F.lit(False))
    for j in forbidden:
        keep = keep & ~hit(j)
    own = base.where(keep).crossJoin(F.broadcast(totals))  # totals is one row
    parts = []
    for i, (_, boost) in enumerate(fields):
        s = F.lit(0.0)
        for j, c in enumerate(clauses):
            if c.must is False or (i, j) not in tf:
                continue
            n, f, size = F.col(f"__df{i}_{j}"), F.col(tf[i, j]).cast("double"), F.col(f"__n{i}")
            idf = F.log(1 + (F.col(f"__docs{i}") - n + 0.5) / (n + 0.5))
            s = s + F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * size / F.col(f"__avg{i}")))).otherwise(0.0)
        parts.append(s * float(boost))
    if tie is not None and len(parts) > 1:
        best = F.greatest(*parts)
        total = best + float(tie) * (reduce(lambda a, b: a + b, parts) - best)
    else:
        total = reduce(lambda a, b: a + b, parts)
    return own.withColumn(score, total).select(*[F.col(f"`{c}`") for c in df.columns], F.col(f"`{score}`"))


# ---- vectors


def distance(a: Column, b: Column, metric: str = "COSINE") -> Column:
    """COSINE 1 - cos, EUCLIDEAN the squared distance, DOT 1 - product; null if the dimensions differ."""
    x = F.transform(a, lambda v: v.cast("double"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    if metric == "EUCLIDEAN":
        d = total(F.zip_with(x, b, lambda p, q: (p - q) * (p - q)))
    else:
        dot = total(F.zip_with(x, b, lambda p, q: p * q))
        if metric == "DOT":
            d = 1 - dot
        else:
            norm = lambda c: F.sqrt(total(F.transform(c, lambda v: v * v)))
            d = 1 - dot / F.nullif(norm(x) * norm(b), F.lit(0.0))
    return F.when(F.size(a) == F.size(b), d)


def nearest(df: DataFrame, field: str, vector: Sequence[float] | Column, k: int, metric: str = "COSINE", out: str = "$distance", key: str = "id") -> DataFrame:
    """The k rows nearest to a vector, exactly, ties by ``key``: a per-partition top-k, then a merge of those."""
    v = vector if isinstance(vector, Column) else F.from_json(F.lit(str([float(x) for x in vector])), "array<double>")
    d = df.withColumn(out, distance(F.col(field), v, metric)).where(F.col(f"`{out}`").isNotNull())
    return d.orderBy(F.col(f"`{out}`").asc(), *([F.col(key).asc()] if key in df.columns else [])).limit(k)


# ---- fusion


def _ranked(d: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``d`` with ``__r``, its rank from 1: in one task where the plan itself bounds the rows, else over sorted ranges."""
    bound = d._jdf.queryExecution().optimizedPlan().maxRows()
    if bound.isDefined() and bound.get() <= ONE_TASK:
        return d.withColumn("__r", F.row_number().over(Window.orderBy(*order)))
    from ..catalog import settled

    parts = settled(d.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()}))
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__m").alias("__a"))  # a row a partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__p", "__a", before.alias("__b"))
    return parts.join(F.broadcast(starts), "__p").withColumn("__r", F.col("__b") + F.col("__m") - F.col("__a") + 1).drop("__p", "__m", "__a", "__b")


def rrf(lists: Sequence[tuple[DataFrame, Sequence[Column]]], limit: int, k: float = 60, key: str = "id") -> DataFrame:
    """Reciprocal-rank fusion of ranked lists, each with the order of its ranks.

    An item's score sums 1 / (k + rank) over the lists, with ranks from 1; it keeps the fields that all lists
    have, as the first list that holds it gives them.  Lists may be of any length.
    """
    shared = [c for c in lists[0][0].columns if all(c in d.columns for d, _ in lists)]
    ranked = [
        _ranked(d.where(F.col(key).isNotNull()), order).select(*[F.col(f"`{c}`") for c in shared], "__r", F.lit(i).alias("__l"))
        for i, (d, order) in enumerate(lists)
    ]
    rows = reduce(DataFrame.unionByName, ranked)
    rest = [c for c in shared if c != key]
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct("__l", "__r")) if rest else F.lit(None)
    fused = rows.groupBy(key).agg(F.sum(1 / (F.lit(float(k)) + F.col("__r"))).alias("_rrf_score"), first.alias("__f"))
    out = fused.select(key, *[F.col("__f").getField(c).alias(c) for c in rest], "_rrf_score")
    return out.orderBy(F.desc("_rrf_score"), key).limit(limit)
