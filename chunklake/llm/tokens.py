"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 6), by dynamic programming over byte prefixes.

Merging is deterministic, so every prefix of a piece of text has exactly one encoding, and that has exactly one last token: the
only token that ends there, whose remainder is a prefix with a last token of its own, and that may stand after that token. It is
enough to store this last token of each prefix. The encoding is read off backwards; more bytes are appended without
touching what is stored; after an edit only the prefixes from the edit on are filled in again, until the table agrees with the
old one for as many bytes as the longest token has.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public vocabulary's pattern: text is cut by it before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_KEPT_PIECES = 200_000
_KEPT_BYTES = 64


class PrefixEncoder:
    """Encodes pieces of bytes with a rank file's vocabulary."""

    def __init__(self, rank_file: bytes, pattern: str = PATTERN):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.token = {r: t for t, r in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.find = regex.compile(pattern).findall
        self._split: dict[int, tuple[int, int] | None] = {}
        self._edges: dict[tuple[int, int], list[tuple[int, float]] | None] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._done: dict[str, list[int]] = {}

    def halves(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes t last; None for a single byte, (-1, -1) where merging t's bytes never makes t."""
        if t not in self._split:
            parts = [self.rank[bytes([b])] for b in self.token[t]]
            while len(parts) > 2:
                ranks = [self.rank.get(self.token[a] + self.token[b], 1 << 60) for a, b in zip(parts, parts[1:])]
                low = min(ranks)
                if low == 1 << 60:
                    break
                i = ranks.index(low)
                parts[i : i + 2] = [low]
            made = len(parts) == 2 and self.rank.get(self.token[parts[0]] + self.token[parts[1]]) == t
            self._split[t] = None if len(parts) == 1 and parts[0] == t else ((parts[0], parts[1]) if made else (-1, -1))
        return self._split[t]

    def edge(self, t: int, side: int) -> list[tuple[int, float]] | None:
        """The tokens that lie at t's left (0) or right (1) end while t is merged, each with the rank of the merge that takes it
        up; t itself stays for ever. None where t is never made."""
        if (t, side) not in self._edges:
            out, at, until = [], t, float("inf")
            while True:
                out.append((at, until))
                half = self.halves(at)
                if half is None:
                    break
                if half[0] < 0:
                    out = None
                    break
                at, until = half[side], at
            self._edges[t, side] = out
        return self._edges[t, side]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether a and b, side by side, encode themselves: no merge over their seam comes before the merges that make them.

        Such a merge would join a token at a's right end with one at b's left end while both are there; of equal merges the
        left one comes first.
        """
        got = self._pairs.get((a, b))
        if got is None:
            left, right = self.edge(a, 1), self.edge(b, 0)
            got = left is not None and right is not None
            if got:
                for x, x_until in left:
                    for y, y_until in right:
                        z = self.rank.get(self.token[x] + self.token[y])
                        if z is not None and z < x_until and z <= y_until:
                            got = False
                            break
                    if not got:
                        break
            self._pairs[a, b] = got
            if len(self._pairs) > 4_000_000:
                self._pairs.clear()
        return got

    def fill(self, piece: bytes, last: list[int], stop: int | None = None) -> None:
        """Appends the last tokens of the prefixes of len(last) + 1 bytes and more; last[i] is that of the prefix of i + 1 bytes."""
        rank, may, longest = self.rank, self.may_follow, self.longest
        for end in range(len(last) + 1, (len(piece) if stop is None else stop) + 1):
            for start in range(end - 1, max(-1, end - 1 - longest), -1):
                t = rank.get(piece[start:end])
                if t is not None and ((start == 0 and self.edge(t, 0) is not None) or (start and may(last[start - 1], t))):
                    last.append(t)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def refill(self, piece: bytes, last: list[int], at: int, old_end: int, new_end: int) -> list[int]:
        """The table of `piece`, made from an old piece with the table `last` by replacing its bytes at..old_end by those now at
        at..new_end. Stops computing where the old table holds again."""
        out = last[:at]
        same = 0
        shift = old_end - new_end
        while len(out) < len(piece):
            self.fill(piece, out, len(out) + 1)
            i = len(out) - 1 + shift
            same = same + 1 if len(out) > new_end and i < len(last) and last[i] == out[-1] else 0
            if same >= self.longest:
                return out + last[i + 1 :]
        return out

    def read(self, last: list[int]) -> list[int]:
        """The encoding that a table of last tokens holds."""
        out, end = [], len(last)
        while end:
            t = last[end - 1]
            out.append(t)
            end -= len(self.token[t])
        return out[::-1]

    def piece(self, text: str) -> list[int]:
        ids = self._done.get(text)
        if ids is None:
            raw = text.encode("utf-8", "replace")
            t = self.rank.get(raw)
            if t is not None and self.edge(t, 0) is not None:
                ids = [t]
            else:
                last: list[int] = []
                self.fill(raw, last)
                ids = self.read(last)
            if len(raw) <= _KEPT_BYTES:
                if len(self._done) >= _KEPT_PIECES:
                    self._done.clear()
                self._done[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text without special tokens; none for an empty or null text."""
        return list(chain.from_iterable(self._pieces(text)))

    def count(self, text: str | None) -> int:
        """How many ids encode() gives."""
        return sum(map(len, self._pieces(text)))

    def _pieces(self, text: str | None) -> list[list[int]]:
        """The ids of each of a text's pieces; most pieces have been met before."""
        if not text:
            return []
        found = self.find(text)
        try:
            return list(map(self._done.__getitem__, found))
        except KeyError:
            return list(map(self.piece, found))


class EditableText:
    """A text with its pieces and their tables: appends and edits re-encode only what they can change."""

    def __init__(self, encoder: PrefixEncoder, text: str = ""):
        self.encoder, self.text = encoder, text
        self.pieces = encoder.find(text)
        self.tables = [self._table(p) for p in self.pieces]
        self.filled = 0

    def _table(self, piece: str, near: tuple[str, list[int]] | None = None) -> list[int]:
        raw, last = piece.encode("utf-8", "replace"), []
        if near:
            old = near[0].encode("utf-8", "replace")
            n, m = min(len(old), len(raw)), 0
            while m < n and old[m] == raw[m]:
                m += 1
            k = 0
            while k < n - m and old[-1 - k] == raw[-1 - k]:
                k += 1
            return self.encoder.refill(raw, near[1], m, len(old) - k, len(raw) - k)
        self.encoder.fill(raw, last)
        return last

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replaces the characters start..stop. Pieces that end before the edit stay, but the last (what follows may lengthen
        it or change a run of blanks); from the first old piece border behind the edit that is a border again, all stay."""
        at, keep = 0, 0
        while keep < len(self.pieces) and at + len(self.pieces[keep]) < start:
            at += len(self.pieces[keep])
            keep += 1
        if keep:
            keep -= 1
            at -= len(self.pieces[keep])
        text = self.text[:start] + new + self.text[stop:]
        borders, pos = {}, 0
        for i, p in enumerate(self.pieces):
            if pos >= stop:
                borders[pos - stop + start + len(new)] = i
            pos += len(p)
        fresh, resume = [], len(self.pieces)
        # A piece can look one character ahead but never back, so that a border is a fresh start.
        for m in regex.finditer(PATTERN, text, pos=at):
            if m.start() in borders and m.start() >= start + len(new):
                resume = borders[m.start()]
                break
            fresh.append(m.group())
        gone = list(zip(self.pieces[keep:resume], self.tables[keep:resume]))
        tables = [self._table(p, gone[i] if i < len(gone) else None) for i, p in enumerate(fresh)]
        self.filled = len(fresh)
        self.pieces[keep:resume], self.tables[keep:resume], self.text = fresh, tables, text

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def ids(self) -> list[int]:
        return [t for last in self.tables for t in self.encoder.read(last)]


_HERE: dict[int, PrefixEncoder] = {}


def _encoder(rank_file: bytes, key: int) -> PrefixEncoder:
    if key not in _HERE:
        _HERE[key] = PrefixEncoder(rank_file)
    return _HERE[key]


def _vocabulary(df: DataFrame, path: str):
    """The rank file (under 1 MB), read once and sent to the executors; they need no tokenizer files."""
    with open(path, "rb") as f:
        raw = f.read()
    return df.sparkSession.sparkContext.broadcast(raw), hash(raw)


def encoded(documents: DataFrame, ident: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): each row's text as token ids, without special tokens. Empty and null texts give an empty list; no row is
    dropped, repeated rows and null ids are kept. No shuffle."""
    shared, key = _vocabulary(documents, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value, key)
        for rb in batches:
            for a in range(0, rb.num_rows, 1000):
                part = rb.slice(a, 1000)
                flat: list[np.ndarray] = []
                ends = [0]
                for ids in map(enc.encode, part.column(1).to_pylist()):
                    flat.append(np.array(ids, dtype=np.int32))
                    ends.append(ends[-1] + len(ids))
                lists = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.concatenate(flat)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    return documents.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, ident: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of each row, 0 for empty and null texts; the ids stay in the workers."""
    shared, key = _vocabulary(documents, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value, key)
        for rb in batches:
            n = list(map(enc.count, rb.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(n, pa.int32())], names=["doc_id", "tokens"])

    return documents.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, tokens int")
