"""Exact removal of repeated passages by fixed-block anchors.

A window of ``size`` words always holds one whole block of ``block = (size + 1) // 2`` words that starts
at a multiple of ``block`` in the document it is taken from.  So:

1. every document's non-overlapping blocks are indexed and all its rolling windows of ``block`` words
   probe that index (an anchor is a block that two documents share);
2. only windows of ``size`` words that hold an anchor go on: the hits are extended to whole windows, and
   the smallest doc_id of every such window is found;
3. each document joins its repeated windows to maximal runs and loses the words they cover.

Hashes travel packed: one sorted array per (group of documents, range of hashes), answered by one bit per
hash, so a document's text moves once and a passage that a third of all rows share is one entry per group.
Anchors compare 32 + log2(ranges) bits (a wrong hit only costs time), whole windows compare 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _session
from . import _text as t

U64 = np.uint64
ASK = "pid int, bucket int, payload binary"
ANSWER = "pid int, bucket int, bits binary"


def _cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of the equal ranges of the hash space begins in the sorted hashes."""
    edges = (np.arange(buckets + 1, dtype=object) * (1 << 64) // buckets).tolist()
    at = np.searchsorted(hashes, np.array(edges[:-1], U64))
    return np.append(at, len(hashes))


def _packed(pid: int, hashes: np.ndarray, buckets: int, pack) -> pa.Table:
    cuts = _cuts(hashes, buckets)
    full = np.flatnonzero(np.diff(cuts))
    return pa.table({"pid": pa.array(np.full(len(full), pid, np.int32)), "bucket": pa.array(full.astype(np.int32)), "payload": pa.array([pack(cuts[b], cuts[b + 1]) for b in full], pa.binary())})


def _unpacked(answers: pa.Table, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The answers' bits in the order of the sorted hashes."""
    cuts, out = _cuts(hashes, buckets), np.zeros(len(hashes), bool)
    for b, bits in zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist()):
        lo, hi = cuts[b], cuts[b + 1]
        out[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).view(bool)
    return out


def _answer(rows: list[tuple[int, np.ndarray]], bucket: int) -> pa.Table:
    rows = [(p, b) for p, b in rows if b.any()]
    return pa.table({"pid": pa.array([p for p, _ in rows], pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "bits": pa.array([np.packbits(b).tobytes() for _, b in rows], pa.binary())})


class _Group:
    """One group of documents: sorted ids, words and hashes.  The same rows give the same arrays."""

    def __init__(self, table: pa.Table, size: int, block: int, deep: bool):
        self.table = table = table.sort_by([("doc_id", "ascending"), ("tie", "ascending")])
        self.data, offsets = t.buffers(table["text"])
        self.start, self.end, self.first = t.words(self.data, offsets)
        ids = table["doc_id"].combine_chunks() if table["doc_id"].num_chunks else pa.array([], pa.int64())
        self.known = ~np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(0), np.int64)
        word = t.hashes(self.data, self.start, self.end, 11)
        self.near, at = t.windows(word, self.first, block, 12)
        self.doc = t.doc_of(at, self.first)
        keep = self.known[self.doc] if len(at) else np.zeros(0, bool)
        self.near, self.at, self.doc = self.near[keep], at[keep], self.doc[keep]
        self.block = block
        if deep:
            self.far, far_at = t.windows(word, self.first, size, 13)
            far_doc = t.doc_of(far_at, self.first)
            second = t.windows(t.hashes(self.data, self.start, self.end, 14), self.first, size, 15)[0]
            keep = self.known[far_doc] if len(far_at) else np.zeros(0, bool)
            self.far, self.far_at, self.far_doc, self.second = self.far[keep], far_at[keep], far_doc[keep], second[keep]

    def anchors(self):
        """(sorted distinct window hashes, bit 0: indexed as a block here, bit 1: in two documents here)."""
        order = np.argsort(self.near, kind="stable")
        h, d = self.near[order], self.ids[self.doc[order]]
        begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        if not len(begin):
            return h, np.zeros(0, np.uint8)
        indexed = ((self.at - self.first[self.doc]) % self.block == 0)[order]
        flags = np.bitwise_or.reduceat(indexed.astype(np.uint8), begin)
        flags |= (np.minimum.reduceat(d, begin) != np.maximum.reduceat(d, begin)).astype(np.uint8) << 1
        return h[begin], flags

    def candidates(self, hit: np.ndarray, hashes: np.ndarray, size: int):
        """The windows of ``size`` words that hold an anchor: hash, second hash, smallest id, and which they are."""
        hot = np.zeros(len(self.start) + 1, np.int64)
        if len(self.near):
            hot[self.at[hit[np.searchsorted(hashes, self.near)]]] = 1
        run = np.r_[0, np.cumsum(hot)]
        some = run[self.far_at + size - self.block + 1] > run[self.far_at] if len(self.far_at) else np.zeros(0, bool)
        which = np.flatnonzero(some)
        order = which[np.lexsort((self.second[which], self.far[which]))]
        a, b = self.far[order], self.second[order]
        begin = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
        d = self.ids[self.far_doc[order]]
        low = np.minimum.reduceat(d, begin) if len(begin) else d
        kind = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(a)]))
        return a[begin], b[begin], low, order, kind


def _ask_anchors(size: int, block: int, buckets: int):
    def run(key, table):
        hashes, flags = _Group(table, size, block, False).anchors()
        low = hashes.astype(np.uint32)
        return _packed(key[0].as_py(), hashes, buckets, lambda i, j: low[i:j].tobytes() + flags[i:j].tobytes())

    return run


def _answer_anchors(key, table):
    raws, pids = table["payload"].to_pylist(), table["pid"].to_pylist()
    sizes = [len(x) // 5 for x in raws]
    low = np.concatenate([np.frombuffer(x, np.uint32, n) for x, n in zip(raws, sizes)])
    flags = np.concatenate([np.frombuffer(x, np.uint8, offset=4 * n) for x, n in zip(raws, sizes)])
    kinds, back, counts = np.unique(low, return_inverse=True, return_counts=True)
    indexed = np.bincount(back, flags & 1, len(kinds)) > 0
    shared = (np.bincount(back, flags >> 1, len(kinds)) > 0) | (counts > 1)
    hit = (indexed & shared)[back]
    return _answer(list(zip(pids, np.split(hit, np.cumsum(sizes)[:-1]))), key[0].as_py())


def _ask_windows(size: int, block: int, buckets: int):
    def run(key, left, right):
        group = _Group(left, size, block, True)
        hashes, _ = group.anchors()
        hit = _unpacked(right, hashes, buckets)
        a, b, low, _, _ = group.candidates(hit, hashes, size)
        pid = key[0].as_py()
        asked = _packed(pid, a, buckets, lambda i, j: a[i:j].tobytes() + low[i:j].tobytes() + b[i:j].tobytes())
        # the group's own anchors go along under a bucket of their own, so that they are not looked up twice
        own = pa.table({"pid": pa.array([pid], pa.int32()), "bucket": pa.array([-1 - pid], pa.int32()), "payload": pa.array([np.packbits(hit).tobytes()], pa.binary())})
        return pa.concat_tables([asked, own])

    return run


def _answer_windows(key, table):
    if key[0].as_py() < 0:
        return pa.table({"pid": table["pid"], "bucket": pa.array([-1] * len(table), pa.int32()), "bits": table["payload"]})
    raws, pids = table["payload"].to_pylist(), table["pid"].to_pylist()
    sizes = [len(x) // 24 for x in raws]
    a = np.concatenate([np.frombuffer(x, U64, n) for x, n in zip(raws, sizes)])
    low = np.concatenate([np.frombuffer(x, np.int64, n, 8 * n) for x, n in zip(raws, sizes)])
    b = np.concatenate([np.frombuffer(x, U64, n, 16 * n) for x, n in zip(raws, sizes)])
    order = np.lexsort((b, a))
    begin = np.flatnonzero(np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
    least = np.minimum.reduceat(low[order], begin)
    smaller, sizes_of = np.zeros(len(a), bool), np.diff(np.r_[begin, len(a)])
    smaller[order] = np.repeat(least, sizes_of) < low[order]
    return _answer(list(zip(pids, np.split(smaller, np.cumsum(sizes)[:-1]))), key[0].as_py())


OUT = "doc_id long, n_words long, n_removed long, kept_text string, repeats array<struct<start:long,end:long>>"


def _strip(size: int, block: int, buckets: int):
    def run(key, left, answers):
        own = answers.filter(pc.equal(answers["bucket"], -1))
        group = _Group(left, size, block, True)
        hashes, _ = group.anchors()
        hit = np.unpackbits(np.frombuffer(own["bits"][0].as_buffer(), np.uint8), count=len(hashes)).view(bool) if len(own) else np.zeros(len(hashes), bool)
        a, _, low, order, kind = group.candidates(hit, hashes, size)
        smaller = _unpacked(answers.filter(pc.greater_equal(answers["bucket"], 0)), a, buckets)
        gone = np.zeros(len(group.start) + 1, np.int64)
        if len(order):
            bad = smaller[kind] | (group.ids[group.far_doc[order]] > low[kind])
            at = group.far_at[order[bad]]
            np.add.at(gone, at, 1)
            np.add.at(gone, at + size, -1)
        covered = np.cumsum(gone[:-1]) > 0
        raw, texts, removed, spans = group.data.tobytes(), [], [], []
        for lo, hi in zip(group.first[:-1], group.first[1:]):
            mask = covered[lo:hi]
            n = int(mask.sum())
            removed.append(n)
            at = zip(group.start[lo:hi][~mask].tolist(), group.end[lo:hi][~mask].tolist())
            if n:
                turn = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2])])
                texts.append(b" ".join([raw[i:j] for i, j in at]))
            else:
                spans.append([])
                texts.append(b" ".join(raw[group.start[lo] : group.end[hi - 1]].split()) if hi > lo else b"")
        return pa.table({
            "doc_id": group.table["doc_id"], "n_words": pa.array(np.diff(group.first), pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "kept_text": pa.array(texts, pa.binary()).cast(pa.string()), "repeats": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        })

    return run


def remove_repeats(docs: DataFrame, size: int = 13) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_text, repeats (maximal runs of removed words).

    A word goes when a window of ``size`` words covers it whose sequence also starts in a document with a
    smaller doc_id; all windows are judged on the input.  Null texts are empty.  Rows with a null doc_id
    neither lose words nor count as a source; rows that share a doc_id do not remove one another's words.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    groups, block = _session.fan(spark, _session.text_bytes(docs)), (size + 1) // 2
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("pid", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(groups)).cast("int"))
    buckets = groups
    asked = rows.groupBy("pid").applyInArrow(_ask_anchors(size, block, buckets), ASK)
    anchors = asked.groupBy("bucket").applyInArrow(_answer_anchors, ANSWER)
    asked = rows.groupBy("pid").cogroup(anchors.groupBy("pid")).applyInArrow(_ask_windows(size, block, buckets), ASK)
    answers = asked.groupBy("bucket").applyInArrow(_answer_windows, ANSWER)
    return rows.groupBy("pid").cogroup(answers.groupBy("pid")).applyInArrow(_strip(size, block, buckets), OUT)
