"""SentencePiece encoding and decoding by a streaming Viterbi search.

The vocabulary (pieces and scores of a .model file) is used as a unigram model: of all ways to cut a
text into pieces, the one with the highest sum of scores; on ties, the one whose last piece is the
longest.  A character that no piece covers scores ten
below the least piece and becomes its UTF-8 bytes' pieces, or the unknown piece without those.

The search holds a window of a few times the longest piece.  Each position points back to where its last piece
starts; whenever the paths back from all positions that can still be extended meet in one boundary, the ids up to it are
committed and forgotten, and the window moves there (where they don't meet, it grows).  Where no piece of the
vocabulary can reach across (before a word's mark, around a character that no piece has) all paths
meet by construction, so a text is fed to the search in those segments, and the ids that it gave for short ones are remembered.

Decoding joins the pieces, bytes included, and turns marks into spaces; it gives the text back
exactly unless the text holds the mark character itself (U+2581), which decodes as a space.

Defined results: null has no ids (null) and decodes to null; the empty text has none (empty) and decodes
to the empty text; texts of any length are encoded whole; repeated rows give a row each; further columns pass through where ``keep`` names them.
"""

from __future__ import annotations

import re
from array import array
from bisect import insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
REMEMBERED = 130_000  # segments a generation, of which there are two a process
_SHORT = 48  # characters of a segment that is remembered


@dataclass
class Vocabulary:
    pieces: dict[str, tuple[int, float]]
    unknown: int
    bytes_: list[int] | None
    text: list[bytes]  # by id: what it decodes to, marks as spaces
    floor: float
    longest: int = field(init=False)
    room: int = field(init=False)  # characters of a window
    cut: re.Pattern = field(init=False)
    young: dict[str, bytes] = field(default_factory=dict)  # ids of segments seen lately
    old: dict[str, bytes] = field(default_factory=dict)  # and of those before
    trie: dict = field(init=False)  # by character; at None the (id, score) of the piece that ends there

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.pieces), default=1)
        self.room = 5 * self.longest
        self.trie = {}
        for p, own in self.pieces.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[None] = own
        known = {c for p in self.pieces for c in p}
        lost = "".join(c for c in map(chr, range(128)) if c not in known)
        lost = re.escape(lost)
        free = not any(MARK in p.lstrip(MARK) for p in self.pieces)  # no piece reaches from a word into a mark
        alone = f"[{lost}]|" if lost else ""
        self.cut = re.compile(f"{alone}{MARK}*[^{MARK}{lost}]+|{MARK}+" if free else (f"{alone}[^{lost}]+" if lost else "(?s:.+)"))

    @classmethod
    def load(cls, model: str | bytes = MODEL) -> Vocabulary:
        """A vocabulary, of the path or the bytes of a .model file."""
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_proto=model if isinstance(model, bytes) else Path(model).read_bytes())
        pieces, text, by_byte = {}, [], {}
        for i in range(m.get_piece_size()):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                by_byte[int(p[1:-1], 16)] = i
                text.append(bytes([int(p[1:-1], 16)]))
            elif m.is_control(i):
                text.append(b"")
            elif m.is_unknown(i):
                text.append(" ⁇ ".encode())
            else:
                text.append(p.replace(MARK, " ").encode())
                if not m.is_unused(i):
                    pieces[p] = (i, m.get_score(i))
        floor = min((s for _, s in pieces.values()), default=0.0) - 10
        return cls(pieces, m.unk_id(), [by_byte[b] for b in range(256)] if len(by_byte) == 256 else None, text, floor)

    def search(self, chars: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a stream of characters, in committed runs."""
        feed = iter(chars)
        text, room = "", self.room
        while True:
            text += "".join(islice(feed, room - len(text)))
            ended = len(text) < room
            ids, end = self._window(text, ended)
            if end:
                yield ids
            if ended:
                return
            text, room = text[end:], self.room if end else 2 * room

    def search_text(self, text: str) -> list[int]:
        """``search`` for a text that is at hand."""
        out: list[int] = []
        at, room = 0, self.room
        while True:
            part = text[at : at + room]
            ended = len(part) < room
            ids, end = self._window(part, ended)
            out += ids
            if ended:
                return out
            at, room = at + end, self.room if end else 2 * room

    def _window(self, text: str, ended: bool) -> tuple[list[int], int]:
        """The ids that a window commits, and the boundary up to which it does: its end where the stream has ended, else
        where the paths back from all positions that can still be extended meet (0: they don't).

        All that can still win goes through that boundary, so the next window starts there, its scores counting from 0."""
        n, trie, floor, bottom = len(text), self.trie, self.floor, float("-inf")
        # score[k], back[k], last[k]: of the best path to k, its last piece's start and its id (-1: no piece)
        score, back, last = [bottom] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        score[0] = 0.0
        done = n if ended else n - self.longest + 1  # from the positions before, every piece is in sight
        for i in range(done):
            node, here, j = trie.get(text[i]), score[i], i + 1
            if node is None or None not in node:
                if here + floor > score[j]:
                    score[j], back[j], last[j] = here + floor, i, -1
            while node is not None:
                own = node.get(None)
                if own is not None and here + own[1] > score[j]:
                    score[j], back[j], last[j] = here + own[1], i, own[0]
                if j == n:
                    break
                node = node.get(text[j])
                j += 1
        if ended:
            return self._ids(text, back, last, n), n
        live = [k for k in range(done, n + 1) if score[k] > bottom]
        while len(live) > 1:  # always the farthest moves back, until they meet
            far = back[live.pop()]
            if far not in live:
                insort(live, far)
        return self._ids(text, back, last, live[0]), live[0]

    def _ids(self, text: str, back: list[int], last: list[int], end: int) -> list[int]:
        out: list[int] = []
        while end:
            start, i = back[end], last[end]
            if i >= 0:
                out.append(i)
            elif self.bytes_ is None:
                out.append(self.unknown)
            else:
                out.extend(self.bytes_[b] for b in reversed(text[start:end].encode("utf-8", "surrogatepass")))
            end = start
        out.reverse()
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text (int32)."""
        if not text:
            return np.zeros(0, np.int32)
        young, old, out = self.young, self.old, []
        for s in self.cut.findall(MARK + text.replace(" ", MARK)):
            b = young.get(s)
            if b is None:
                b = old.get(s) or array("i", self.search_text(s)).tobytes()
                if len(s) <= _SHORT:
                    young[s] = b
                    if len(young) >= REMEMBERED:
                        old.clear()
                        old.update(young)
                        young.clear()
            out.append(b)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        out = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


def _shared(df: DataFrame, model: str | bytes) -> Broadcast[bytes]:
    """The vocabulary file (below a megabyte), read by the driver: executors need no path."""
    return df.sparkSession.sparkContext.broadcast(model if isinstance(model, bytes) else Path(model).read_bytes())


def encode(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), model: str | bytes = MODEL, ids: str = "ids") -> DataFrame:
    """The columns ``keep`` and ``ids`` (array<int>), for every row."""
    kept = [F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]
    d = docs.select(*kept, F.col(text_col).cast("string").alias("_t"))
    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.load(shared.value)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            for lo in range(0, b.num_rows, 512):
                part = texts.slice(lo, 512).to_pylist()
                rows = [None if t is None else v.encode(t) for t in part]
                sizes = [0 if r is None else len(r) for r in rows]
                offsets = pa.array([None if r is None else o for r, o in zip(rows, np.cumsum([0, *sizes[:-1]]).tolist())] + [sum(sizes)], pa.int32())
                values = pa.array(np.concatenate([r for r in rows if r is not None] or [np.zeros(0, np.int32)]), pa.int32())
                own = [b.column(i).slice(lo, 512) for i in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(offsets, values)], [*b.schema.names[:-1], "ids"])

    fields = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields[:-1]), "ids array<int>"])
    return d.mapInArrow(run, fields).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("ids").alias(ids))


def decode(tokens: DataFrame, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), model: str | bytes = MODEL, text: str = "text") -> DataFrame:
    """The columns ``keep`` and the text that the ids stand for, for every row."""
    kept = [F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]
    d = tokens.select(*kept, F.col(ids_col).alias("_i"))
    shared = _shared(tokens, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.load(shared.value)
        for b in batches:
            last = b.column(b.num_columns - 1)
            for lo in range(0, b.num_rows, 512):
                part = last.slice(lo, 512)
                ends, flat = part.offsets.to_numpy(), part.values.to_numpy(zero_copy_only=False)
                out = pa.array([v.decode(flat[a:z].tolist()) if good else None for a, z, good in zip(ends[:-1].tolist(), ends[1:].tolist(), part.is_valid().to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, 512) for i in range(b.num_columns - 1)), out], [*b.schema.names[:-1], "t"])

    fields = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields[:-1]), "t string"])
    return d.mapInArrow(run, fields).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("t").alias(text))
