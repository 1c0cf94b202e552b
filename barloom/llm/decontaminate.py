"""Benchmark decontamination by templates.

Words are folded (letters and digits only, lower case) and canonicalised: numbers (1,500 is one), runs of names
and units (5km is a number and a unit) become typed placeholders, one token each.  Windows of WINDOW tokens are
hashed and joined with the benchmark's; a second set of windows has one placeholder a word, and a third keeps
every folded word, so changes of punctuation or case do not matter.  Hits of one document and item on one diagonal, and then on neighbouring ones (inserted or deleted
words, placeholders of other lengths), are checked for slot consistency: a placeholder's benchmark value must
always meet the same document value and the other way round, so values may change but not fall together.  A pair is reported when consistent hits cover at least ``cover`` of the
item's words, or when a whole window of folded words is the same in both, whatever its share of the item.

The benchmark's windows are broadcast while they fit WINDOW_LIMIT; a larger benchmark is joined by hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _session
from . import _text as t

WINDOW = 10
PLAIN = 4  # words of a template window that are no placeholders (of a folded window: no numbers), at least
COVER = 0.6
STEADY = 0.7
WINDOW_LIMIT = 200_000  # rows of two arrays, about 200 bytes each: 40 MB
PIECE = 1 << 20  # bytes of text searched at once
U64 = np.uint64
#: fixed values
UNITS = ["mm", "cm", "m", "km", "in", "inch", "inches", "ft", "foot", "feet", "yd", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams", "ton", "tons", "lb", "lbs", "oz", "pound", "pounds", "ml", "l", "liter", "liters", "litre", "litres", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "hz", "khz", "mhz", "w", "kw", "kwh", "v", "a", "j", "kj", "n", "pa", "bar", "k", "percent", "dollar", "dollars", "euro", "euros", "cent", "cents", "usd", "eur", "mph", "kmh", "degree", "degrees", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilogram", "kilograms", "rupee", "rupees", "yen", "yuan", "peso", "pesos", "franc", "francs", "rouble", "roubles", "krona", "kronor"]
#: fixed values
NUMBERS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million"]

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = _SMALL[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_POINT = np.zeros(256, bool)
_POINT[[44, 46, 47, 58]] = True
KIND_NUMBER, KIND_NAME, KIND_UNIT = 1, 2, 3
FOLDED, SHAPED, TOKENS = 0, 1, 2  # streams of windows


def _runs(mask: np.ndarray, edge: np.ndarray):
    begins, ends = mask.copy(), mask.copy()
    begins[1:] &= ~mask[:-1] | edge[1:-1]
    ends[:-1] &= ~mask[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _hashed(words: list[str]) -> np.ndarray:
    raw = [x.encode() for x in words]
    cut = np.r_[0, np.cumsum([len(x) for x in raw])]
    return np.sort(t.hashes(np.frombuffer(b"".join(raw), np.uint8), cut[:-1], cut[1:], 51))


def _among(folded: np.ndarray, words: list[str]) -> np.ndarray:
    known = _hashed(words)
    return known[np.minimum(np.searchsorted(known, folded), len(known) - 1)] == folded


class Words:
    """The words of letters and digits of a column's texts, and the tokens of their templates.

    Words: first (by document), folded (hashes), kinds.  Tokens: starts (by document), values (folded hashes),
    shapes (hashes, placeholders by kind), types (kinds), and the words lo to hi (past the last) that each stands for.

    A number is a run of words of digits with one of . , : / in between, or of NUMBERS with spaces or a hyphen; a name is a run of words that begin with a
    capital A-Z before a small letter, with spaces or a hyphen in between; units are those of UNITS straight after
    a number, in the same word or the next.
    """

    def __init__(self, column):
        data, offsets = t.buffers(column)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        start, end = _runs(_LETTER[data], edge) if len(data) else (np.zeros(0, np.int64),) * 2
        self.first = first = np.searchsorted(start, offsets)
        n = len(start)
        if not n:
            self.folded = self.values = self.shapes = np.zeros(0, U64)
            self.kinds = self.types = np.zeros(0, np.int8)
            self.starts, self.lo, self.hi = first, start, start
            return
        lower = t.LOWER[data]
        self.folded = t.hashes(lower, start, end, 51)
        digits = np.r_[0, np.cumsum(_DIGIT[data], dtype=np.int64)]
        kinds = np.zeros(n, np.int8)
        second = data[np.minimum(start + 1, len(data) - 1)]
        kinds[_UPPER[data[start]] & (end - start > 1) & _SMALL[second]] = KIND_NAME
        many = digits[end] - digits[start]
        number = many == end - start
        spelled = _among(self.folded, NUMBERS)
        kinds[number | spelled] = KIND_NUMBER
        # words of digits and a unit: all their digits come first
        both = np.flatnonzero((many > 0) & ~number & _DIGIT[data[start]])
        both = both[digits[start[both] + many[both]] - digits[start[both]] == many[both]]
        both = both[_among(t.hashes(lower, start[both] + many[both], end[both], 51), UNITS)]
        opens = np.zeros(n, bool)
        opens[first[:-1][first[:-1] < n]] = True
        after = np.zeros(n, bool)
        after[1:] = (number | spelled)[:-1]
        kinds[_among(self.folded, UNITS) & after & ~opens] = KIND_UNIT
        self.kinds = kinds
        parts = np.ones(n, np.int64)
        parts[both] = 2
        word = np.repeat(np.arange(n), parts)
        begin, close, kind = start[word], end[word], kinds[word]
        at = both + np.arange(len(both))  # the number's part; the unit's follows
        close[at] = begin[at + 1] = start[both] + many[both]
        kind[at], kind[at + 1] = KIND_NUMBER, KIND_UNIT
        # parts that join the one before
        join = np.zeros(len(word), bool)
        gap, mark = begin[1:] - close[:-1], data[np.minimum(close[:-1], len(data) - 1)]
        solid = np.r_[0, np.cumsum(~t.SPACE[data], dtype=np.int64)]
        spaces = solid[begin[1:]] == solid[close[:-1]]
        same = (kind[1:] == kind[:-1]) & ~(opens[word[1:]] & (word[1:] != word[:-1]))
        said = spelled[word]
        figures = ~said[1:] & ~said[:-1] & (gap == 1) & _POINT[mark]
        spoken = said[1:] & said[:-1] & (spaces & (gap > 0) | (gap == 1) & (mark == 45))
        join[1:] = same & ((kind[1:] == KIND_NUMBER) & (figures | spoken) | (kind[1:] == KIND_NAME) & (spaces & (gap > 0) | (gap == 1) & (mark == 45)))
        heads = np.flatnonzero(~join)
        tails = np.r_[heads[1:], len(word)] - 1
        self.lo, self.hi, self.types = word[heads], word[tails] + 1, kind[heads]
        self.starts = np.searchsorted(self.lo, first)
        self.values = self.folded[self.lo]
        own = np.flatnonzero((heads < tails) | (parts[self.lo] > 1))
        self.values[own] = t.hashes(lower, begin[heads[own]], close[tails[own]], 51)
        self.shapes = np.where(self.types > 0, t.stream(52, 4)[self.types], self.values)

    def part(self, stream: int):
        """(begin by document, hashes, values, kinds, first word, end word) of a stream of windows."""
        if stream == TOKENS:
            return self.starts, self.shapes, self.values, self.types, self.lo, self.hi
        at = np.arange(len(self.folded))
        shapes = self.folded if stream == FOLDED else np.where(self.kinds > 0, t.stream(52, 4)[self.kinds], self.folded)
        return self.first, shapes, self.folded, self.kinds, at, at + 1

    def windows(self, stream: int, size: int):
        """(hashes, index of the first word or token) of all windows of a stream; of templates with some plain words."""
        starts, hashed, _, kinds, _, _ = self.part(stream)
        h, at = t.windows(hashed, starts, size, 53 + stream)
        if stream == FOLDED or not len(at):
            return h, at
        plain = np.r_[0, np.cumsum(kinds == 0)]
        plain = plain[at + size] - plain[at]
        keep = (plain >= PLAIN) & (plain < size)
        return h[keep], at[keep]


WINDOWS = "id long, tie long, hash long, at int, end int, stream int, size int, words int, folded array<long>, kinds array<byte>"


def _rows(batch, words: Words, h, at, stream: int, size: int) -> pa.RecordBatch:
    _, _, values, kinds, first, end = words.part(stream)
    lo, hi = first[at], end[at + size - 1]
    doc = t.doc_of(lo, words.first)
    spread = at[:, None] + np.arange(size)
    cut = pa.array(np.arange(len(at) + 1) * size, pa.int32())
    return pa.RecordBatch.from_arrays([
        batch.column("id").take(pa.array(doc)), batch.column("tie").take(pa.array(doc)), pa.array(h.view(np.int64)), pa.array((lo - words.first[doc]).astype(np.int32)),
        pa.array((hi - words.first[doc]).astype(np.int32)), pa.array(np.full(len(h), stream, np.int32)), pa.array(np.full(len(h), size, np.int32)), pa.array(np.diff(words.first)[doc].astype(np.int32)),
        pa.ListArray.from_arrays(cut, pa.array(values[spread].ravel().view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(kinds[spread].ravel())),
    ], ["id", "tie", "hash", "at", "end", "stream", "size", "words", "folded", "kinds"])


def _index(size: int):
    """Windows of items; an item of fewer words (or tokens) than a window is one window of its own length."""

    def run(batches):
        for batch in batches:
            for part in t.pieces(batch):
                words = Words(part.column("text"))
                for stream in (FOLDED, SHAPED, TOKENS):
                    starts = words.part(stream)[0]
                    own = np.minimum(np.diff(starts), size)
                    for n in sorted(set(own.tolist()) - {0}):
                        h, at = words.windows(stream, n)
                        good = own[t.doc_of(at, starts)] == n if len(at) else np.zeros(0, bool)
                        if good.any():
                            yield _rows(part, words, h[good], at[good], stream, n)

    return run


def _probe(sizes: list[tuple[int, int]], shared):
    """The windows of documents that the filter lets through."""

    def run(batches):
        table, known = shared.value
        low = U64(len(table) - 1)
        for batch in batches:
            for part in t.pieces(batch, limit=PIECE):
                words = Words(part.column("text"))
                for stream, n in sizes:
                    h, at = words.windows(stream, n)
                    good = np.flatnonzero(table[(h & low).astype(np.int64)])
                    if known is not None:
                        good = good[known[np.minimum(np.searchsorted(known, h[good]), len(known) - 1)] == h[good]]
                    if len(good):
                        yield _rows(part, words, h[good], at[good], stream, n)

    return t.trimmed(run)


def _filter(hashes: DataFrame, log2: int = 24) -> np.ndarray:
    """Which of the 2**log2 values of the low bits occur: a table of a fixed size (16 MB) for any benchmark."""
    low = F.col("hash").bitwiseAND(F.lit((1 << log2) - 1))
    rows = hashes.select(F.shiftright(low, 6).alias("i"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("m")).groupBy("i").agg(F.bit_or("m").alias("m")).toArrow()
    words = np.zeros(1 << (log2 - 6), np.int64)
    words[np.asarray(rows["i"], np.int64)] = np.asarray(rows["m"], np.int64)
    return np.unpackbits(words.view(np.uint8), bitorder="little").view(bool)


def _texts(table: DataFrame, key: str) -> DataFrame:
    text = F.col("text").cast("string")
    return table.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, cover: float = COVER, steady: float = STEADY, limit: int = WINDOW_LIMIT) -> DataFrame:
    """Pairs (doc_id, item_id, covered, words): documents that hold an item or a whole window of it, and how many of its words.

    docs has doc_id and text, benchmark item_id and text.  Rows with a null in either column take no part,
    empty texts hold nothing, very long ones are searched whole, repeated rows report once, items without words are
    never found.  Other columns are ignored.  Empty tables give no pairs.
    """
    spark = docs.sparkSession
    items = _session.cut(_texts(benchmark, "item_id").mapInArrow(_index(size), WINDOWS).withColumnsRenamed({"id": "item_id", "folded": "item_folded", "kinds": "item_kinds", "at": "item_at", "end": "item_end"}))
    small = items.count() <= limit
    sizes = sorted(tuple(r) for r in items.select("stream", "size").distinct().collect())  # at most 3 * ``size`` pairs
    known = np.sort(np.asarray(items.select("hash").distinct().toArrow()["hash"], np.int64).view(U64)) if small else None
    shared = spark.sparkContext.broadcast((_filter(items.select("hash")), known if small and len(known) else None))
    hits = _texts(docs, "doc_id").mapInArrow(_probe(sizes, shared), WINDOWS).drop("words", "stream")
    items = items.withColumnRenamed("tie", "item_tie")
    met = hits.join(F.broadcast(items) if small else items, ["hash", "size"])
    # one diagonal (document word minus item word) is one alignment
    pair = F.expr("filter(transform(sequence(0, size - 1), i -> struct(element_at(item_kinds, i + 1) as kind, element_at(item_folded, i + 1) as item, element_at(folded, i + 1) as doc)), x -> x.kind > 0)")
    run = F.expr("sequence(item_at, item_end - 1)")
    verbatim = F.expr(f"stream = {FOLDED} and size >= {size} and size(filter(item_kinds, x -> x <> {KIND_NUMBER})) >= {PLAIN}")
    keys = ["id", "tie", "item_id", "item_tie", "words"]
    met = met.withColumn("line", F.col("at") - F.col("item_at")).select(*keys, "line", (F.col("stream") == TOKENS).alias("tokens"), run.alias("run"), pair.alias("slots"), verbatim.alias("verbatim"))
    # an item's windows meet a line once or, beside placeholders, a few times, so these sets are bounded by the item
    lines = met.groupBy(*keys, "line", "tokens").agg(F.array_distinct(F.flatten(F.collect_set("run"))).alias("run"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"), F.max("verbatim").alias("verbatim"))
    # blocks of diagonals overlap by half: lines up to half an item apart share one
    near = lines.withColumn("block", F.expr("explode(transform(array(0, 1), x -> cast(floor(line / (words div 2 + 1)) as int) - x))"))
    near = near.groupBy(*keys, "block").agg(F.collect_list(F.struct(F.size("run").alias("covered"), "line", "tokens", "run", "slots")).alias("lines"), F.max("verbatim").alias("verbatim"))

    def steady_slots(slots):
        values = lambda side: F.size(F.array_distinct(F.transform(slots, lambda x: x[side])))
        return F.least(values("item"), values("doc")) >= steady * F.size(slots)

    def add(held, line):
        both = F.struct(F.array_union(held["run"], line["run"]).alias("run"), F.array_union(held["slots"], line["slots"]).alias("slots"))
        return F.when((F.size(F.array_except(line["run"], held["run"])) > 0) & steady_slots(both["slots"]), both).otherwise(held)

    # the longest lines first; one that contradicts those before it is left out
    none = F.struct(F.expr("cast(array() as array<int>)").alias("run"), F.expr("cast(array() as array<struct<kind: tinyint, item: bigint, doc: bigint>>)").alias("slots"))
    near = near.withColumn("covered", F.aggregate(F.sort_array("lines", asc=False), none, add, lambda x: F.size(x["run"])))
    good = near.where(F.col("verbatim") | (F.col("covered") >= cover * F.col("words")))
    return good.groupBy(F.col("id").alias("doc_id"), "item_id").agg(F.max("covered").alias("covered"), F.max_by("words", "covered").alias("words"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs, with all their columns, without the documents that hold a benchmark item; rows with a null doc_id or text stay.

    Of rows that share a doc_id all go if one of them holds an item.
    """
    bad = find(docs, benchmark, **options).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
