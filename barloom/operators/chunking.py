"""Splitters whose next cut depends on the one before: one Arrow-batched pass over texts."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: separators from the coarsest to the finest
LADDER = ["\n\n\n", "\n\n", "\n", "。\n", "。", "！", "？", "；", "，", " ", ""]
#: fixed values: what ends a sentence
ENDS = "[。！？\\n.?!]"


def _pieces(text: str, separator: str) -> list[str]:
    """text cut before every occurrence of the separator, which stays with what follows it."""
    cuts = [0, *(m.start() for m in re.finditer(re.escape(separator), text)), len(text)]
    return [text[i:j] for i, j in zip(cuts, cuts[1:]) if i < j]


def _packed(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Pieces joined while they fit; the next pack begins with the last pieces of the one before, at most ``overlap`` characters."""
    out, held, length = [], [], 0
    for piece in pieces:
        if length + len(piece) > size:
            if held:
                out.append("".join(held))
            while length > overlap or (length and length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
    return [*out, "".join(held)] if held else out


def recursive_chunks(text: str, size: int = 2048, overlap: int = 100, ladder: list[str] = LADDER) -> list[str]:
    """Chunks of at most ``size`` characters, cut before the coarsest separator of the ladder that the text holds.

    Pieces of ``size`` characters or more are cut by the separators after it, at last into characters.  Neighbouring
    chunks share whole pieces of at most ``overlap`` characters; blanks at the ends of chunks go, and so do blank chunks.
    """
    at = next(i for i, s in enumerate(ladder) if s in text)
    if not ladder[at]:
        begins = range(0, max(1, len(text) - overlap), max(1, size - overlap))
        found = [text[i : i + size] for i in begins]
    else:
        found, small = [], []
        for piece in [*_pieces(text, ladder[at]), None]:
            if piece is not None and len(piece) < size:
                small.append(piece)
                continue
            found += _packed(small, size, overlap)
            small = []
            if piece is not None:
                found += recursive_chunks(piece, size, overlap, ladder[at + 1 :])
    return [x.strip() for x in found if x.strip()]


def sentence_chunks(text: str, size: int = 450, overlap: int = 50) -> list[str]:
    """Sentences (a newline ends one too) packed up to ``size``, a blank between them.

    The next chunk begins with the last ``overlap`` characters of the one before, or with what follows the first
    sentence end in them.  Chunks of over 1.2 ``size`` are cut in strides of size - overlap.
    """
    out, held, length = [], "", 0
    for s in filter(None, re.split(f"(?<={ENDS})\\s*", text)):
        if held and length + len(s) > size:
            out.append(held)
            tail = held[max(0, len(held) - overlap) :]
            end = re.search(ENDS, tail)
            # without an end in a chunk shorter than the overlap its last overlap - length characters
            tail = (tail[end.end() :] if end else held[len(held) - overlap :]).lstrip()
            held = f"{tail} {s}" if tail else s
            length = len(held)
        elif held:
            held, length = f"{held} {s}", length + len(s) + 1
        else:
            held, length = s, len(s)
    cut = []
    for x in [*out, held] if held else out:
        cut += [x] if len(x) <= 1.2 * size else [x[i : i + size] for i in range(0, len(x), size - overlap)]
    return cut


def paragraph_packs(text: str, size: int = 10_000) -> list[str]:
    """Lines packed while a pack and the line have fewer than ``size`` characters, each after a newline; a longer one stands alone."""
    out, held = [], ""
    for p in text.split("\n"):
        if len(held) + len(p) + 1 > size:
            out += [held] if held else []
            held = p
        else:
            held = f"{held}\n{p}"
    return [*out, held] if held else out


HELD = 4 << 20  # characters whose chunks are held before they are passed on
SPLITTERS = {"recursive": recursive_chunks, "sentence": sentence_chunks, "paragraph": paragraph_packs}


def chunks(docs: DataFrame, splitter: str, key: str = "id", column: str = "raw_content", **options) -> DataFrame:
    """(key, chunk_order, chunk_text) of every document; null and blank texts have no chunks."""
    split = SPLITTERS[splitter]

    def run(batches):
        for batch in batches:
            kind, rows, size = batch.schema.field(0).type, [], 0

            def made():
                keys, order, text = zip(*rows)
                return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(order, pa.int32()), pa.array(text, pa.string())], [key, "chunk_order", "chunk_text"])

            for k, x in zip(batch.column(0), batch.column(1)):
                text = x.as_py()
                if text and text.strip():
                    rows += [(k.as_py(), i, c) for i, c in enumerate(split(text, **options))]
                    size += len(text)
                if size > HELD:
                    yield made()
                    rows, size = [], 0
            if rows:
                yield made()

    return docs.select(key, F.col(column).cast("string").alias("text")).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, chunk_order int, chunk_text string")
