"""Byte-level BPE by dynamic programming over prefixes.

The BPE encoding of every prefix of a piece ends in one token, and a sequence of tokens is an encoding
when each neighbouring pair is the encoding of its own bytes.  So one array, the last token of each
prefix, holds the encodings of all prefixes: reading it backwards gives the tokens, appending bytes only
adds entries, and after an edit entries are recomputed until they agree with the old ones again.

Text is first cut by the tokenizer's pattern; pieces that are tokens themselves are taken whole.  Tables
come from a rank file whose path is a parameter; nothing is trained.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as t

CACHED_PIECES = 200_000
CACHED_PAIRS = 300_000
LONG = 64
PIECE = 1 << 20  # bytes of text turned into ids at once


class Vocabulary:
    """Ranks of a tiktoken-format file, and the pair test that prefixes rest on."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        self.finder = ahocorasick.Automaton()
        for raw, rank in self.ranks.items():
            self.bytes[rank] = raw
            self.finder.add_word(raw.decode("latin-1"), (rank, len(raw)))
        self.finder.make_automaton()
        self.longest = max(map(len, self.ranks))
        self.split = regex.compile(pattern).findall
        self.one = [i.to_bytes(4, "little") for i in range(len(self.bytes))]
        self.halves = [self._halves(raw) for raw in self.bytes]
        self.made = [len(raw) < 2 or half is not None for raw, half in zip(self.bytes, self.halves)]
        self.sizes = list(map(len, self.bytes))
        self._pairs: list[dict[int, bool]] = [{} for _ in self.bytes]  # for each token, which may follow it
        self._tested = 0
        self._pieces: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _halves(self, raw: bytes) -> tuple[int, int] | None:
        """The two tokens of a token's last merge; None for single bytes and tokens that merging never makes."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        if any(x not in self.ranks for x in parts):
            return None
        while len(parts) > 2:
            rank, at = min((self.ranks.get(x + y, 1 << 60), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def fits(self, before: int, token: int) -> bool:
        """Whether token may follow before (-1: begin) in an encoding: see _apart."""
        if not self.made[token]:
            return False
        if before < 0:
            return True
        known = self._pairs[before].get(token)
        if known is None:
            if self._tested >= CACHED_PAIRS:
                self._forget_pairs()
            self._tested += 1
            known = self._pairs[before][token] = self._apart(before, token)
        return known

    def _forget_pairs(self) -> None:
        for own in self._pairs:
            own.clear()
        self._tested = 0

    def _apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens keeps them apart.

        Undoes the merges next to the border, the latest first.  Before each of them was made, the parts
        beside the border were these; had their own merge a lower rank, it would have come first and
        joined the tokens (at equal rank the leftmost comes first).
        """
        ranks, raw, halves = self.ranks, self.bytes, self.halves
        bound = 1 << 60
        while True:
            joined = ranks.get(raw[left] + raw[right])
            if joined is not None and joined < bound:
                return False
            a, b = halves[left], halves[right]
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                bound, left = left, a[1]  # made on the left: an equal rank at the border is further right
            else:
                bound, right = right + 1, b[0]  # made on the right: an equal rank at the border is further left

    def _tokens(self, raw: bytes) -> list[int]:
        """Prefixes(self, raw).tokens() for pieces that take no edits: the same array, filled in one loop."""
        pairs, fits, made, sizes = self._pairs, self.fits, self.made, self.sizes
        last: list[int] = []
        add, reach = last.append, 0
        for end, (token, size) in self.finder.iter(raw.decode("latin-1")):
            if end < reach:
                continue
            if end > reach:
                break
            if end >= size:
                before = last[end - size]
                known = pairs[before].get(token)
                if not (fits(before, token) if known is None else known):
                    continue
            elif not made[token]:
                continue
            add(token)
            reach = end + 1
        if reach < len(raw):
            raise ValueError("a byte has no token")
        out = []
        while reach:
            token = last[reach - 1]
            out.append(token)
            reach -= sizes[token]
        out.reverse()
        return out

    def piece(self, text: str) -> bytes:
        """The piece's ids as little-endian unsigned 32-bit integers; short pieces are remembered, the latest longest."""
        ids = self._older.get(text)
        if ids is None:
            raw = text.encode()
            whole = self.ranks.get(raw)
            ids = self.one[whole] if whole is not None else b"".join(map(self.one.__getitem__, self._tokens(raw)))
        if len(text) <= LONG:
            if len(self._pieces) >= CACHED_PIECES // 2:
                self._pieces, self._older = {}, self._pieces
            self._pieces[text] = ids
        return ids

    def encode(self, text: str) -> bytes:
        make = self.piece
        return b"".join([self._pieces.get(x) or make(x) for x in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def forget(self) -> None:
        self._pieces, self._older = {}, {}
        self._forget_pairs()


class Prefixes:
    """The last token of every prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, raw: bytes = b""):
        self.vocabulary, self.raw, self.last = vocabulary, b"", []
        if raw:
            self.append(raw)

    def _extend(self, begin: int, settled=None) -> int:
        """Fill entries from begin on; stop early at the first place where settled(i) holds."""
        fits, last = self.vocabulary.fits, self.last
        text = self.raw.decode("latin-1")
        reach = 0
        lo = max(0, begin - self.vocabulary.longest)
        for end, (token, size) in self.vocabulary.finder.iter(text, lo):
            if end < begin or end < reach or size > end + 1:
                continue
            before = last[end - size] if end >= size else -1
            if fits(before, token):
                if end == len(last):
                    last.append(token)
                else:
                    last[end] = token
                reach = end + 1
                if settled is not None and settled(end):
                    return end
        if reach < len(self.raw) and begin < len(self.raw):
            raise ValueError("a byte has no token")
        return len(self.raw) - 1

    def append(self, more: bytes) -> None:
        """Exact: earlier prefixes keep their tokens."""
        begin = len(self.raw)
        self.raw += more
        if more:
            self._extend(begin)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Replace raw[start:end]; returns how many prefixes were computed anew.

        Entries after the edit are kept from where every token that could follow sees the same
        entries as before: as many agreeing entries in a row as the longest token has bytes.
        """
        old_tail, shift = self.last[end:], start + len(new)
        self.raw = self.raw[:start] + new + self.raw[end:]
        del self.last[start:]
        longest, run = self.vocabulary.longest, 0

        def settled(i: int) -> bool:
            nonlocal run
            run = run + 1 if i >= shift and self.last[i] == old_tail[i - shift] else 0
            return run >= longest

        if not self.raw[start:]:
            return 0
        done = self._extend(start, settled)
        if done + 1 < len(self.raw):
            self.last[done + 1 :] = old_tail[done + 1 - shift :]
        assert len(self.last) == len(self.raw)
        return done + 1 - start

    def tokens(self) -> list[int]:
        out, at, sizes = [], len(self.last), self.vocabulary.bytes
        while at:
            out.append(self.last[at - 1])
            at -= len(sizes[out[-1]])
        return out[::-1]


class Document:
    """An encoded text that takes appends: only its last piece is cut and encoded anew."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.pieces = vocabulary, []
        self.append(text)

    def append(self, more: str) -> None:
        tail = (self.pieces.pop() if self.pieces else "") + more
        self.pieces += self.vocabulary.split(tail)

    def ids(self) -> bytes:
        return b"".join(self.vocabulary.encode(x) if len(x) > LONG else self.vocabulary._pieces.get(x) or self.vocabulary.piece(x) for x in self.pieces)


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def _coded(path: str, pattern: str, both: bool):
    def run(batches):
        v = vocabulary(path, pattern)
        try:
            for batch in batches:
                for part in t.pieces(batch, limit=PIECE):
                    ids = [v.encode(x) if x else b"" for x in part.column("text").to_pylist()]
                    columns = [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                    if both:
                        columns.append(pa.array([v.decode(x) for x in ids], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "token_ids", "decoded"][: len(columns)])
        finally:
            v.forget()

    return t.trimmed(run)


def encode(docs: DataFrame, path: str, pattern: str, column: str = "text", decoded: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, token_ids (binary, little-endian unsigned 32-bit).

    With ``decoded`` also the bytes that the ids decode to, made where the ids are, so that they do not travel to a
    second worker.  Null and empty texts have no tokens; very long texts are encoded whole, piece by piece of the
    pattern.  A worker remembers at most CACHED_PIECES pieces, and none after its task.  Other columns are ignored,
    repeated rows give repeated results, an empty table an empty one.
    """
    types = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, token_ids binary" + ", decoded binary" * decoded
    return docs.select("doc_id", F.col(column).cast("string").alias("text")).mapInArrow(_coded(path, pattern, decoded), types)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """encoded (with token_ids) and its decoded bytes in ``decoded``; null ids decode to no bytes."""

    def run(batches):
        decode = vocabulary(path, pattern).decode
        for batch in batches:
            for part in t.pieces(batch, "token_ids", PIECE):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([decode(x or b"") for x in part.column("token_ids").to_pylist()], pa.binary())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(t.trimmed(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded binary")
