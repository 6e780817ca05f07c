"""Repeated-substring dedup by blockwise suffix sorting with a difference cover.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier in the corpus (in a
document with a smaller id, or earlier in the same one).  Matches never cross documents.

Only the first LENGTH bytes of suffixes ("windows") need sorting, and only against windows that can
equal them.  The bucket of a window is the least hash of its ``GRAM``-byte strings: equal windows have
equal buckets, and neighbouring windows mostly share one, so a run of windows travels as one piece.
1. Pieces: one pass over the texts cuts each document into runs of windows of one bucket and sends a
   row of fixed size for each run (bucket, hash of its bytes, place).  Runs that are byte for byte the
   same collapse to the earliest, first within each batch, so that a passage which a third of
   all documents share sends a row a batch, then in the bucket; the later ones go as they are.
2. Buckets with different runs (or a run that repeats its bucket's string inside) are sorted: their bytes are
   fetched, and each task sorts one block of buckets at a time.  Unrelated texts share a bucket by chance, the more
   the larger the table is, so a run is left out if it can't have a window in common with another: windows of one
   bucket are equal only if its string lies at the same place in them, and all that have it in the same third of
   the places hold the same CORE bytes around it.  A run's row bears a hash for each third that it has windows in,
   and a run that shares none of these with another run of its bucket has no repeated window.
   The windows of a bucket that very many different runs share (the edges of a passage in a third of
   all documents) travel one by one in finer buckets instead, equal ones of a batch collapsed.
3. Sorting a block: windows are ordered by their first ``PERIOD`` bytes, a range of first words at a
   time, so that memory is bounded by a block.  Ties beyond are resolved by ranks of the cover sample:
   the suffixes at places whose residue modulo PERIOD lies in a difference cover, sorted beforehand
   with their common prefix lengths by doubling.  For any two windows some shift below PERIOD takes both into the
   sample, where one comparison of ranks tells whether they agree to the end.
4. Each document's repeated windows are merged into spans, and its bytes outside are kept.

Defined results: a null text has no bytes; ids are of any type that can be ordered, null after all others; rows that
repeat an id count in the order of their texts' SHA-256, each compared to those before it, so that a rerun removes
the same; texts below LENGTH bytes lose nothing, and those of any length are read whole, _SLICE windows at a time; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable

LENGTH = 100
GRAM = 24
PERIOD = 31
COVER = np.array([1, 5, 11, 24, 25, 27])  # a perfect difference set: every residue is a difference
_RUN = 4096  # windows of a run at most
_SLICE = 1 << 18  # windows looked at together: some 100 bytes of work space each
_BLOCK = 1 << 21  # bytes of runs sorted together
_PASS = 1 << 20  # windows sorted together
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PLACE = 22  # bits of a place in a slice
_THIRDS = 3
_WIDE = -(-(LENGTH - GRAM + 1) // _THIRDS)  # places of a bucket's string in a window that count as one third
CORE = LENGTH - _WIDE + 1
_BITS = 21  # of a core's hash
_ALL, _SORT, _HOT = 1, 2, 3
_HELD = 1 << 18  # rows of runs looked at together
_CROWD = 20_000  # different runs of a bucket from which its windows travel one by one


# ---- 1. runs of windows


def _powers(b: np.ndarray) -> list[tuple[np.ndarray, np.uint64]]:
    """By k, up to the highest bit of CORE: by place a raw hash of the 2**k bytes from there on, and the factor that a hash is moved up by before one of them is added."""
    base = 0x100000001B3
    out = [(b.astype(np.uint64) + np.uint64(1), np.uint64(base))]
    while 2 << len(out) - 1 <= CORE:
        h, width = out[-1][0], 1 << len(out) - 1
        h = h[:-width] * np.uint64(base) + h[width:]
        base = base * base & 0xFFFFFFFFFFFFFFFF
        out.append((h, np.uint64(base)))
    return out


def _hashes(powers: list[tuple[np.ndarray, np.uint64]], size: int, places: np.ndarray | None = None) -> np.ndarray:
    """A hash of the ``size`` bytes from each of ``places`` on, or from every place."""
    out, at = None, 0
    for k in range(size.bit_length()):
        if size >> k & 1:
            h, base = powers[k]
            part = h[at : at + len(powers[0][0]) - size + 1] if places is None else h[places + at]
            out = part if out is None else out * base + part
            at += 1 << k
    out = (out ^ (out >> np.uint64(29))) * _ODD
    return (out ^ (out >> np.uint64(32))) * _ODD


def _cores(powers: list[tuple[np.ndarray, np.uint64]], m: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For runs of the windows ``first`` to ``end`` with their bucket's string at ``m``: _BITS bits for each third, 0 where they have no window in it."""
    out = np.zeros(len(m), np.int64)
    for j in range(_THIRDS):
        a = j * _WIDE
        z = min(a + _WIDE, LENGTH - GRAM + 1) - 1
        has = np.flatnonzero((m - first >= a) & (m - end <= z))
        core = _hashes(powers, CORE, m[has] - a)
        out[has] |= np.maximum((core >> np.uint64(64 - _BITS)).astype(np.int64), 1) << j * _BITS
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """By place: the least of the ``width`` values from there on."""
    done = 1
    out = x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def runs(texts: list[bytes], ords: np.ndarray) -> tuple[np.ndarray, ...]:
    """(bucket, hash, ord, start, windows, repeats, cores) of all runs of windows; repeats: its bucket's string occurs in it twice or more."""
    found: list[list[np.ndarray]] = [[] for _ in range(7)]
    held: list[tuple[int, int, bytes]] = []
    room = 0

    def flush() -> None:
        nonlocal room
        data = b"".join(x[2] for x in held)
        if held and len(data) >= LENGTH:
            b = np.frombuffer(data, np.uint8)
            powers = _powers(b)
            g = _hashes(powers, GRAM) & ~np.uint64((1 << _PLACE) - 1)
            place = np.arange(len(g), dtype=np.uint64)
            low = _least(g | place, LENGTH - GRAM + 1)
            last = np.uint64((1 << _PLACE) - 1)
            high = _least(g | (last - place), LENGTH - GRAM + 1)
            sizes = np.array([len(x[2]) for x in held])
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            n = np.maximum(sizes - LENGTH + 1, 0)
            doc = np.repeat(np.arange(len(held)), n)
            p = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + begins[doc]
            if len(p):
                bucket = low[p] >> np.uint64(_PLACE)
                new = np.append(True, (p[1:] != p[:-1] + 1) | (bucket[1:] != bucket[:-1]))
                at = np.flatnonzero(new)
                since = np.arange(len(p)) - np.repeat(at, np.diff(np.append(at, len(p))))
                new |= since % _RUN == 0
                at = np.flatnonzero(new)
                count = np.diff(np.append(at, len(p)))
                first, end = p[at], p[at] + count - 1
                m = (low[first] & last).astype(np.int64)
                twice = m != (last - (high[end] & last)).astype(np.int64)
                view, h = memoryview(data), xxhash.xxh3_64_intdigest
                digest = np.array([h(view[a : z + LENGTH]) for a, z in zip(first.tolist(), end.tolist())], np.uint64)
                own = np.array([x[0] for x in held])[doc[at]]
                start = first - begins[doc[at]] + np.array([x[1] for x in held])[doc[at]]
                for f, v in zip(found, (bucket[at].astype(np.int64), digest.view(np.int64), own, start, count, twice, _cores(powers, m, first, end))):
                    f.append(v)
        held.clear()
        room = 0

    for t, o in zip(texts, ords.tolist()):
        if len(t) < LENGTH:
            continue
        for a in range(0, len(t) - LENGTH + 1, _SLICE):
            piece = t[a : a + _SLICE + LENGTH - 1] if len(t) > _SLICE else t
            if room and room + len(piece) > 2 * _SLICE:
                flush()
            held.append((o, a, piece))
            room += len(piece)
    flush()
    kinds = (np.int64, np.int64, np.int64, np.int64, np.int64, bool, np.int64)
    return tuple(np.concatenate(f) if f else np.zeros(0, k) for f, k in zip(found, kinds))


def _pack(start: np.ndarray, count: np.ndarray, flags: np.ndarray) -> np.ndarray:
    return start << 16 | count << 2 | flags


def _run_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for lo in range(0, len(b), 2048):
            part = b.iloc[lo : lo + 2048]
            bucket, digest, own, start, count, twice, cores = runs([x or b"" for x in part["t"]], part["ord"].to_numpy(np.int64))
            by = np.lexsort((start, own, digest, bucket))
            later = np.zeros(len(by), bool)
            later[1:] = (bucket[by[1:]] == bucket[by[:-1]]) & (digest[by[1:]] == digest[by[:-1]])
            late = np.zeros(len(by), bool)
            late[by] = later
            # a later run is decided; it only passes through, spread evenly
            yield pd.DataFrame({"h": np.where(late, own ^ start, bucket), "d": digest, "ord": own, "at": _pack(start, count, np.where(late, _ALL, np.where(twice, _SORT, 0))), "c": np.where(late, 0, cores)})


def _shared(bucket: np.ndarray, cores: np.ndarray) -> np.ndarray:
    """For each run: does another one of its bucket (a number below 2**40) have one of its cores?"""
    out = np.zeros(len(bucket), bool)
    for j in range(_THIRDS):
        core = cores >> j * _BITS & (1 << _BITS) - 1
        has = np.flatnonzero(core)
        key = bucket[has] << _BITS | core[has]
        by = np.argsort(key, kind="stable")
        same = key[by[1:]] == key[by[:-1]]
        out[has[by[1:][same]]] = True
        out[has[by[:-1][same]]] = True
    return out


def _decided(x: np.ndarray, crowded: int | None) -> pd.DataFrame:
    """Whole buckets of runs (h, d, ord, at, c), sorted: later copies of a run go whole (_ALL), the rest is sorted where it must be (_SORT, _HOT)."""
    h, d, _, at, c = x.T
    new_bucket = np.append(True, h[1:] != h[:-1])
    new_run = np.append(True, d[1:] != d[:-1]) | new_bucket
    begins = np.flatnonzero(new_bucket)
    bucket = np.cumsum(new_bucket) - 1
    kinds = np.add.reduceat(new_run.astype(np.int64), begins)
    # where a run has the bucket's string twice, its windows have it at several places, and cores tell nothing
    anyhow = np.logical_or.reduceat(at & 3 == _SORT, begins)
    if crowded is not None:
        anyhow |= h[begins] == crowded
    sort = new_run & anyhow[bucket]
    ask = np.flatnonzero(new_run & ((kinds > 1) & ~anyhow)[bucket])
    sort[ask] = _shared(bucket[ask], c[ask])
    kinds = np.add.reduceat(sort.astype(np.int64), begins)
    if crowded is not None:
        kinds[h[begins] == crowded] = _CROWD + 2
    kinds = kinds[bucket]
    out = sort | ~new_run
    x, sort, kinds = x[out], sort[out], kinds[out]
    return _frame(x, np.where(sort, np.where(kinds > _CROWD, _HOT, _SORT), _ALL))


def _frame(x: np.ndarray, flags: np.ndarray | int) -> pd.DataFrame:
    return pd.DataFrame({"h": x[:, 0], "ord": x[:, 2], "at": x[:, 3] & ~np.int64(3) | flags})


def _sifted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (h, d, ord, at, c) in that order to what is to be done with them; at most _HELD rows are held, whatever a bucket's size."""
    rest = np.zeros((0, 5), np.int64)
    crowded = None
    for b in itertools.chain(batches, [None]):
        if b is not None:
            x = np.column_stack([b[c].to_numpy(np.int64) for c in ("h", "d", "ord", "at", "c")])
            whole = x[:, 3] & 3 == _ALL
            if whole.any():
                yield _frame(x[whole], _ALL)
            rest = np.concatenate([rest, x[~whole]])
            if len(rest) < _HELD:
                continue
        end = len(rest) if b is None else int(np.searchsorted(rest[:, 0], rest[-1, 0])) if len(rest) else 0
        if end:
            yield _decided(rest[:end], crowded)
            rest = rest[end:]
        if len(rest) >= _HELD:  # one bucket: the later copies of its runs are decided, and if many runs are left it is a crowd
            new = np.append(True, rest[1:, 1] != rest[:-1, 1])
            yield _frame(rest[~new], _ALL)
            rest = rest[new]
            if len(rest) > _CROWD:
                crowded = int(rest[0, 0])
                yield _frame(rest[:-1], _HOT)
                rest = rest[-1:]


def _sift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``_sifted`` for rows in any order that fit in memory."""
    got = list(batches)
    return _sifted(iter([pd.concat(got).sort_values(["h", "d", "ord", "at"])] if got else []))


# ---- 3. sorting a block


def _words(text: np.ndarray) -> np.ndarray:
    """By place: the next eight bytes as a number, so that numbers compare as bytes do.  ``text`` is padded."""
    return np.ndarray(len(text) - 8, ">u8", text, strides=(1,))


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows by the given keys, the first one leading; equal rows share a rank."""
    by = np.lexsort(keys[::-1])
    new = np.zeros(len(by), np.int64)
    for k in keys:
        new[1:] |= k[by[1:]] != k[by[:-1]]
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(new)
    return out


class CoverSample:
    """Ranks of the suffixes at cover places, by at least LENGTH bytes, and common prefixes of neighbours in that order."""

    def __init__(self, text: np.ndarray, size: int):
        """``text``: ``size`` bytes and at least LENGTH + 2 * PERIOD of padding."""
        w = _words(text)
        residue = np.zeros(PERIOD, bool)
        residue[COVER] = True
        self.places = np.flatnonzero(np.resize(residue, size))
        at = np.full(size + 1, -1, np.int64)
        at[self.places] = np.arange(len(self.places))
        mask = np.uint64(0xFFFFFFFFFFFFFF00)
        rank = _dense(*(w[self.places + 8 * k].astype(np.uint64) & (mask if k == 3 else ~np.uint64(0)) for k in range(4)))
        reach = PERIOD
        while reach < LENGTH:  # a place and the one ``reach`` on are both in the sample
            nxt = at[np.minimum(self.places + reach, size)]
            rank = _dense(rank, np.where(nxt >= 0, rank[nxt], -1))
            reach *= 2
        order = np.argsort(rank, kind="stable")
        self.rank = np.empty(len(order), np.int64)  # of its own for each place: its row in ``common``
        self.rank[order] = np.arange(len(order))
        a, z = self.places[order[:-1]], self.places[order[1:]]
        common = np.full(len(a), LENGTH + 4, np.int64)
        live = np.arange(len(a))
        for k in range(0, LENGTH, 8):
            x = w[a[live] + k].astype(np.uint64) ^ w[z[live] + k].astype(np.uint64)
            differ = np.flatnonzero(x)
            common[live[differ]] = k + (63 - np.floor(np.log2(x[differ].astype(np.float64))).clip(0, 63)).astype(np.int64) // 8
            live = live[x == 0]
        self.common = np.append(0, common)  # of a row with the row before
        self.at = at

    def classes(self, depth: int) -> np.ndarray:
        """By row: a number that rows share if their suffixes agree in the first ``depth`` bytes."""
        return np.cumsum(self.common < depth)


def repeated(text: bytes, windows: np.ndarray) -> np.ndarray:
    """For each window (its place in ``text``, increasing): does an earlier one among them start the same LENGTH bytes?"""
    size = len(text)
    padded = np.zeros(size + LENGTH + 2 * PERIOD + 16, np.uint8)
    padded[:size] = np.frombuffer(text, np.uint8)
    out = np.zeros(len(windows), bool)
    w = _words(padded)
    first = w[windows].astype(np.uint64)
    sample = None
    bounds = [0, 1 << 64]
    if len(windows) > _PASS:  # a range of first words at a time
        few = np.sort(first[:: max(1, len(first) // 4096)])
        parts = -(-len(windows) // _PASS)
        bounds = [0, *sorted({int(few[len(few) * k // parts]) for k in range(1, parts)} - {0}), 1 << 64]
    for a, z in zip(bounds, bounds[1:]):
        own = np.arange(len(windows)) if len(bounds) == 2 else np.flatnonzero((first >= np.uint64(a)) & (first <= np.uint64(z - 1)))
        group = np.zeros(len(own), np.int64)
        for k in range(4):  # by the first PERIOD bytes; windows alone with theirs are done
            word = w[windows[own] + 8 * k].astype(np.uint64)
            if k == 3:
                word &= np.uint64(0xFFFFFFFFFFFFFF00)
            by = np.argsort(word, kind="stable") if k == 0 else np.lexsort((word, group))
            g, x = group[by], word[by]
            new = np.append(True, (g[1:] != g[:-1]) | (x[1:] != x[:-1])) if len(by) else np.zeros(0, bool)
            tied = ~new
            tied[:-1] |= ~new[1:]
            number = np.cumsum(new)
            by, number = by[tied], number[tied]
            back = np.argsort(by, kind="stable")
            own, group = own[by[back]], number[back]
        if not len(own):
            continue
        sample = sample or CoverSample(padded, size)
        p = windows[own]
        residue = p % PERIOD
        for shift in range(PERIOD):
            here = np.flatnonzero(np.isin((residue + shift) % PERIOD, COVER))
            if not len(here):
                continue
            cls = sample.classes(LENGTH - shift)[sample.rank[sample.at[p[here] + shift]]]
            key = group[here] << np.int64(32) | cls
            by = np.argsort(key, kind="stable")
            same = key[by[1:]] == key[by[:-1]]
            out[own[here[by[1:][same]]]] = True  # places increase, so the first of a key is the earliest
    return out


def _fetched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (ord, t, places) to a row (h, ord, start, b) a run with its bytes.

    Of a crowded bucket each window goes by itself, in a finer bucket made of both its ends, once for all
    equal ones of the batch; the later ones of those are decided and go without bytes."""
    names = ["h", "ord", "start", "b"]
    for b in batches:
        rows: list[tuple] = []
        size = 0
        hot: dict[bytes, tuple[int, int]] = {}

        def put(o: int, start: int, w: bytes) -> None:
            other = hot.get(w)
            if other is not None:
                late = max(other, (o, start))
                rows.append((late[0] ^ late[1], *late, None))
            hot[w] = (o, start) if other is None else min(other, (o, start))

        for o, t, places in zip(b["ord"].tolist(), b["t"], b["places"]):
            for x in places:
                at = int(x["at"])
                start, count = at >> 16, (at >> 2) & 0x3FFF
                size += count + LENGTH
                if at & 3 == _HOT:
                    for k in range(start, start + count):
                        put(o, k, bytes(t[k : k + LENGTH]))
                    size += count * LENGTH
                else:
                    rows.append((int(x["h"]), o, start, bytes(t[start : start + count - 1 + LENGTH])))
                if size > 1 << 22:
                    rows += [(xxhash.xxh3_64_intdigest(w[:GRAM] + w[-GRAM:]) >> 1, *p, w) for w, p in hot.items()]
                    hot.clear()
                    yield pd.DataFrame(rows, columns=names)
                    rows.clear()
                    size = 0
        rows += [(xxhash.xxh3_64_intdigest(w[:GRAM] + w[-GRAM:]) >> 1, *p, w) for w, p in hot.items()]
        if rows:
            yield pd.DataFrame(rows, columns=names)


def _sort_block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["ord", "start"], kind="stable")
    sizes = rows["b"].str.len().to_numpy(np.int64)
    begins = np.cumsum(sizes) - sizes
    n = sizes - LENGTH + 1
    row = np.repeat(np.arange(len(rows)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    hit = np.flatnonzero(repeated(b"".join(rows["b"]), begins[row] + place))
    if not len(hit):
        return pd.DataFrame({"ord": np.zeros(0, np.int64), "start": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
    new = np.append(True, (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]]))
    a = np.flatnonzero(new)
    h = hit[a]
    return pd.DataFrame({"ord": rows["ord"].to_numpy(np.int64)[row[h]], "start": rows["start"].to_numpy(np.int64)[row[h]] + place[h], "n": np.diff(np.append(a, len(hit)))})


def _sorted_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs ordered by bucket to stretches of repeated windows, one block of whole buckets at a time."""
    held: list[pd.DataFrame] = []
    size = 0
    for b in batches:
        done = b["b"].isna()
        if done.any():
            yield b.loc[done, ["ord", "start"]].assign(n=1)
            b = b[~done]
            if not len(b):
                continue
        h = b["h"].to_numpy()
        ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
        total = np.cumsum(b["b"].str.len().to_numpy(np.int64))
        lo = 0
        for z in ends.tolist():
            if held and lo == 0 and held[-1]["h"].iloc[-1] != h[0] and size >= _BLOCK:
                yield _sort_block(pd.concat(held))
                held, size = [], 0
            before = total[lo - 1] if lo else 0
            if z < len(h) and size + total[z - 1] - before >= _BLOCK:  # the bucket ends here
                held.append(b.iloc[lo:z])
                yield _sort_block(pd.concat(held))
                held, size, lo = [], 0, z
        if lo < len(h):
            held.append(b.iloc[lo:])
            size += int(total[-1] - (total[lo - 1] if lo else 0))
    if held:
        yield _sort_block(pd.concat(held))


# ---- 4. spans


def merged(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, windows) of repeated windows to the spans (start, end) of bytes they cover."""
    out: list[list[int]] = []
    for start, n in sorted(places):
        end = start + n - 1 + LENGTH
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


_RESULT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, t, places) to (id, _RESULT); the id stays as it is."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            rows = []
            for t, places in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                t = t or b""
                spans = merged([(x["start"], x["n"]) for x in places or ()])
                digest, at = hashlib.sha256(), 0
                for a, z in spans:
                    digest.update(t[at:a])
                    at = z
                digest.update(t[at:])
                rows.append((len(t), sum(z - a for a, z in spans), len(spans), digest.hexdigest(), [{"start": a, "end": z} for a, z in spans]))
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, k) for x, k in zip(zip(*rows), kinds)]], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ord, t): ord is the id where ids are integers, unique and not null, else a rank by id, null last, and text hash."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    if isinstance(rows.schema["id"].dataType, T.IntegralType):
        odd = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").limit(1).count()
        if not odd:
            return rows.select("id", F.col("id").cast("long").alias("ord"), "t")
    rows = durable(rows.withColumn("rid", F.monotonically_increasing_id()))
    keys = [F.col("id").isNull(), F.col("id"), F.col("sha"), F.col("rid")]
    parts = rows.select("rid", "id", F.sha2(F.coalesce("t", F.lit(b"")), 256).alias("sha")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    parts = durable(parts.withColumn("m", F.monotonically_increasing_id()))  # increases with the range, then in it
    return rows.join(parts.select("rid", F.col("m").alias("ord")), "rid").select("id", "ord", "t")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, n_bytes, n_removed, n_spans, kept_sha256, spans (the bytes to remove, end exclusive)."""
    rows = ordered(docs, id_col, text_col)
    made = rows.select("ord", "t").mapInPandas(_run_rows, "h bigint, d bigint, ord bigint, at bigint, c bigint")
    sifted = durable(made.repartition("h").sortWithinPartitions("h", "d", "ord", "at").mapInPandas(_sifted, "h bigint, ord bigint, at bigint"))
    kind = F.col("at").bitwiseAND(3)
    # Both joins below read the same columns of the same rows, so that the texts are shuffled once.
    texts = rows.where(F.col("ord").isNotNull()).select("ord", "id", "t")
    wanted = sifted.where(kind != _ALL).groupBy("ord").agg(F.collect_list(F.struct("h", "at")).alias("places"))  # at most a document's own
    pieces = texts.join(wanted, "ord").select("ord", "id", "t", "places").mapInPandas(_fetched, "h bigint, ord bigint, start bigint, b binary")
    found = pieces.repartition("h").sortWithinPartitions("h").mapInPandas(_sorted_runs, "ord bigint, start bigint, n bigint")
    whole = sifted.where(kind == _ALL).select("ord", F.shiftright("at", 16).alias("start"), F.shiftright("at", 2).bitwiseAND(0x3FFF).alias("n"))
    spans = whole.unionByName(found).groupBy("ord").agg(F.collect_list(F.struct("start", "n")).alias("places"))
    out = texts.join(spans, "ord", "left").select("id", "t", "places")
    return out.mapInArrow(_kept, T.StructType([out.schema["id"], *T.StructType.fromDDL(_RESULT).fields])).withColumnRenamed("id", id_col)
