"""Token-id files: documents in id order, their ids coded in blocks that are reset and checksummed one by one.

write() deals whole texts by ranges of doc_id, encodes them and cuts each part's stream of ids into blocks.  A block is a row of
a Parquet table in the shared folder: its part and place, the number and CRC-32 of its ids, which documents it holds pieces
of, and the code (see id_coder).  Every block can be read alone, so a read splits into tasks anywhere; documents() joins the
pieces of a document by their lengths and checksums, without its ids.

Texts are encoded by the tokenizers library.  Where a tokenizer's pre-tokens never run over white space that follows a
character (byte-level BPE), texts are cut before such white space, and
where ASCII letters, digits and marks meet; each distinct piece is encoded once
and remembered.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _session, id_coder
from . import _text as t

BLOCK = 4096
PART = 32 << 20  # bytes of text in a part
BATCH = 6 << 20  # bytes of text encoded at once
KNOWN = 1 << 20  # pieces whose ids are remembered
#: last bytes of the UTF-8 forms of white space beyond ASCII, and what else counts as white space somewhere
_NOT_BEFORE = np.zeros(256, bool)
_NOT_BEFORE[[*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = True
#: ASCII letters, digits and marks but for the apostrophe, which may go with what follows it
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[39] = 0


def cuts_are_safe(spec: dict) -> bool:
    """Whether the tokenizer encodes the pieces of a text as it encodes the text."""
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not (a.get("lstrip") or a.get("rstrip") or a.get("single_word")) and not any(c.isspace() for c in a["content"]) for a in spec.get("added_tokens", []))
    whole = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    return bool(whole and plain and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding"))


class Encoder:
    """A tokenizer of the tokenizers library, over Arrow columns of texts."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer)
        self.tokenizer, self.cut = Tokenizer.from_str(tokenizer), cuts_are_safe(spec)
        self.added = [a["content"].encode() for a in spec.get("added_tokens", [])]
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.ends = pa.array([], pa.large_binary()), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, pieces: pa.Array) -> None:
        made = [e.ids for e in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in pieces.to_pylist()], add_special_tokens=False)]
        ends = np.cumsum(np.fromiter(map(len, made), np.int64, len(made)))
        self.ids = np.r_[self.ids, np.fromiter(chain.from_iterable(made), np.int32, int(ends[-1]))]
        self.known, self.ends = pa.concat_arrays([self.known, pieces]), np.r_[self.ends, self.ends[-1] + ends]

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where each of distinct pieces is among the known ones; new ones are encoded."""
        if len(self.known) > KNOWN:
            self._forget()
        found = pc.index_in(pieces, self.known)
        at, new = np.asarray(found.fill_null(0)), np.asarray(found.is_null())
        if new.any():
            at = np.where(new, len(self.known) + np.cumsum(new) - 1, at)
            self._learn(pieces.filter(pa.array(new)))
        return at

    def _begins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the pieces of the texts begin."""
        at = np.zeros(len(data), bool)
        at[offsets[:-1][np.diff(offsets) > 0]] = True
        if self.cut:
            at[1:] |= t.SPACE[data[1:]] & ~_NOT_BEFORE[data[:-1]]
            raw = data.tobytes() if self.added else b""
            if not any(x in raw for x in self.added):  # else an added token might be cut in two
                kind = _KIND[data]
                at[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        return np.flatnonzero(at)

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after the other, how many each has); null is the empty text."""
        data, offsets = t.buffers(column)
        begins = self._begins(data, offsets)
        cuts = pa.py_buffer(np.r_[begins, len(data)].astype(np.int64))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, cuts, pa.py_buffer(data)]).dictionary_encode()
        which = self._places(coded.dictionary)[np.asarray(coded.indices)]
        many = np.diff(self.ends)[which]
        total = np.r_[0, np.cumsum(many)]
        at = np.repeat((self.ends[which] - total[:-1]).astype(np.int32), many)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids[at], np.diff(total[np.searchsorted(begins, offsets)])


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    key = zlib.crc32(shared.value.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value)
    return _ENCODERS[key]


class _Stream:
    """A part's ids as they come; places count from the part's beginning."""

    def __init__(self, key: pa.DataType):
        self.ids, self.begins, self.ends, self.names = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], key)
        self.done = self.used = self.doc = 0  # blocks and ids that have been written, documents that are no longer at hand

    def add(self, names: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        ends = self.used + len(self.ids) + np.cumsum(sizes)
        self.begins, self.ends = np.r_[self.begins, ends - sizes], np.r_[self.ends, ends]
        self.ids, self.names = np.r_[self.ids, ids], pa.concat_arrays([self.names, names])

    def blocks(self, part: int, prior: id_coder.Prior, block: int, last: bool = False):
        """Rows of the full blocks at hand, or of all that is left."""
        n = -(-len(self.ids) // block) if last else len(self.ids) // block
        cuts = np.minimum(np.arange(n + 1) * block, len(self.ids))
        for lo in range(0, n, id_coder.ENCODED):
            some = cuts[lo : lo + id_coder.ENCODED + 1]
            yield self._rows(part, [self.ids[i:j] for i, j in zip(some, some[1:])], self.used + some, prior)
            self.done += len(some) - 1
        self.used += int(cuts[-1])
        self.ids = self.ids[cuts[-1] :]
        gone = int(np.searchsorted(self.ends, self.used, "right"))
        self.doc += gone
        self.begins, self.ends, self.names = self.begins[gone:], self.ends[gone:], self.names.slice(gone)

    def _rows(self, part: int, ids: list[np.ndarray], at: np.ndarray, prior: id_coder.Prior) -> pa.RecordBatch:
        n = len(ids)
        first, last = np.searchsorted(self.ends, at[:-1], "right"), np.searchsorted(self.ends, at[1:], "left")
        sizes = [np.minimum(self.ends[a : b + 1], hi) - np.maximum(self.begins[a : b + 1], lo) for a, b, lo, hi in zip(first, last, at, at[1:])]
        offsets = pa.array(np.r_[0, np.cumsum(last - first + 1)].astype(np.int32))
        names = self.names.take(pa.array(np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])))
        columns = {
            "part": pa.array([part] * n, pa.int32()), "block": pa.array(self.done + np.arange(n)), "first": pa.array(at[:-1]), "n": pa.array(np.diff(at).astype(np.int32)),
            "crc": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), "code": pa.array(id_coder.encode(ids, prior), pa.binary()),
            "doc": pa.array(self.doc + first), "names": pa.ListArray.from_arrays(offsets, names), "sizes": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sizes), pa.int64())),
            "begins": pa.array(self.begins[first] >= at[:-1]), "ends": pa.array(self.ends[last] <= at[1:]),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _schema(key: str) -> str:
    return f"part int, block long, first long, n int, crc long, code binary, doc long, names array<{key}>, sizes array<long>, begins boolean, ends boolean"


def _written(shared, end: int, size: int, block: int):
    def run(batches):
        stream, part = None, 0
        for batch in batches:
            for piece in t.pieces(batch, limit=BATCH):
                if not piece.num_rows:
                    continue
                if stream is None:
                    stream, part, prior, encoder = _Stream(piece.column("doc_id").type), piece.column("part")[0].as_py(), id_coder.Prior(size), _encoder(shared)
                ids, sizes = encoder.encode(piece.column("text"))
                stream.add(piece.column("doc_id"), np.insert(ids, np.cumsum(sizes), end), sizes + 1)
                if len(stream.ids) >= id_coder.ENCODED * block:
                    yield from stream.blocks(part, prior, block)
        if stream is not None:
            yield from stream.blocks(part, prior, block, last=True)

    return t.trimmed(run)


def write(docs: DataFrame, tokenizer: str, path: str, end: int = 0, block: int = BLOCK, part_bytes: int = PART) -> None:
    """Write the ids of all texts, each with the end id after it, in ascending doc_id order.

    ``tokenizer``: the JSON text of a tokenizer.  Null and empty texts have the end id alone.  Null doc_ids come first; rows
    that share a doc_id are ordered by their text and all kept; other columns are ignored; an empty table has no blocks.
    A part is a range of rows, so it holds about ``part_bytes`` of text, and whole documents.
    """
    from tokenizers import Tokenizer

    if not 1 <= block <= id_coder.LONGEST:
        raise ValueError(f"a block has 1 to {id_coder.LONGEST} ids")
    spark = docs.sparkSession
    shared, size = spark.sparkContext.broadcast(tokenizer), Tokenizer.from_str(tokenizer).get_vocab_size(with_added_tokens=True)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    parts = max(1, -(-_session.text_bytes(rows) // part_bytes))
    key = rows.schema["doc_id"].dataType.simpleString()
    ordered = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select(F.spark_partition_id().alias("part"), "doc_id", "text")
    ordered.mapInArrow(_written(shared, end, max(size, end + 1), block), _schema(key)).withColumn("vocabulary", F.lit(max(size, end + 1))).write.parquet(path)


def _decoded(batches, wanted):
    """(row, ids) of each block, whose checksum is right."""
    for batch in batches:
        for lo in range(0, batch.num_rows, id_coder.DECODED):
            some = batch.slice(lo, id_coder.DECODED)
            if not some.num_rows:
                continue
            prior = id_coder.Prior(some.column("vocabulary")[0].as_py())
            ids = id_coder.decode(some.column("code").to_pylist(), some.column("n").to_numpy(), prior)
            for row, crc, x in zip(some.select(wanted).to_pylist(), some.column("crc").to_pylist(), ids):
                raw = x.astype("<u4").tobytes()
                if zlib.crc32(raw) != crc:
                    raise ValueError(f"block {row['block']} of part {row['part']} is damaged")
                yield row, raw


def _pieces(key: pa.DataType, with_ids: bool):
    def run(batches):
        names, numbers, raws = [], [], []

        def made():
            part, doc, at, n, crc, whole = (pa.array(x) for x in zip(*numbers))
            columns = {"part": part.cast(pa.int32()), "doc": doc, "doc_id": pa.array(names, key), "at": at, "n": n, "crc": crc, "whole": whole} | ({"ids": pa.array(raws, pa.binary())} if with_ids else {})
            return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        for row, raw in _decoded(batches, ["part", "block", "first", "doc", "names", "sizes", "begins", "ends"]):
            at, last = 0, len(row["sizes"]) - 1
            for i, (name, n) in enumerate(zip(row["names"], row["sizes"])):
                own = raw[4 * at : 4 * (at + n)]
                names.append(name)
                raws += [own] if with_ids else []
                numbers.append((row["part"], row["doc"] + i, row["first"] + at, n, zlib.crc32(own), (i > 0 or row["begins"]) and (i < last or row["ends"])))
                at += n
            if len(names) >= (256 if with_ids else 10_000):
                yield made()
                names, numbers, raws = [], [], []
        if names:
            yield made()

    return t.trimmed(run)


def pieces(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(part, doc, doc_id, at, n, crc, whole) of the part of each document in each block, read and decoded; ids on request."""
    files = spark.read.parquet(path)
    kind = files.schema["names"].dataType.elementType
    made = f"part int, doc long, doc_id {kind.simpleString()}, at long, n long, crc long, whole boolean" + ", ids binary" * with_ids
    return files.mapInArrow(_pieces(_arrow(kind), with_ids), made)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC's, whose highest bit is the constant term."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ _POLYNOMIAL * (b & 1)
    return out


@lru_cache(1 << 14)
def _power(length: int) -> int:
    """x to the 8 * length."""
    power, square, bits = 0x80000000, 0x00800000, length
    while bits:
        if bits & 1:
            power = _times(power, square)
        square, bits = _times(square, square), bits >> 1
    return power


def joined_crc(crc: int, more: int, length: int) -> int:
    """CRC-32 of two byte strings one after the other; ``length``: bytes of the second one."""
    return _times(_power(length), crc) ^ more


def _joined(batches):
    for batch in batches:
        out = []
        for own in batch.column("own").to_pylist():
            crc = 0
            for x in own:
                crc = joined_crc(crc, x["crc"], 4 * x["n"])
            out.append(crc)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "doc_id", "at", "n")), pa.array(out, pa.int64())], ["part", "doc_id", "at", "n", "crc"])


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, its end id included; start: ids of all before it.

    Only documents that lie in several blocks are grouped; a group has one small row for each block of its document.
    """
    found = _session.table(pieces(spark, path), "pieces")
    kind = found.schema["doc_id"].dataType.simpleString()
    split = found.where("not whole").groupBy("part", "doc").agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("own"))
    docs = found.where("whole").select("part", "doc_id", "at", "n", "crc").union(split.mapInArrow(_joined, f"part int, doc_id {kind}, at long, n long, crc long"))
    sums = found.groupBy("part").agg(F.sum("n").alias("n")).withColumn("many", F.floor(F.col("part") / 1024))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = sums.groupBy("many").agg(F.sum("n").alias("n")).select("many", before(Window.orderBy("many")).alias("base"))  # one row for 1024 parts
    first = sums.select("many", "part", before(Window.partitionBy("many").orderBy("part")).alias("own")).join(whole, "many").select("part", (F.col("base") + F.col("own")).alias("first"))
    return docs.join(first, "part").select("doc_id", (F.col("first") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
